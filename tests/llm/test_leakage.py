from __future__ import annotations

import random

import pytest
from test_words import tokens

from setaccio.llm import leakage


def brute(corpus, passages, n=12):
    def grams(text):
        t = tokens(leakage.plain(text or ""))
        return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}

    sets = [(i, grams(t)) for i, t in corpus if i is not None]
    return {(i, j) for j, t in passages if j is not None for i, s in sets if s & grams(t)}


def found(corpus, passages):
    df = leakage.overlaps(corpus, "row", "text", passages, "probe", "text").where("longest_run >= 12")
    return {(r.id, r.passage_id) for r in df.collect()}


def cases(words):
    p = {k: words(90, k) for k in range(8)}
    passages = [(k, " ".join(v)) for k, v in p.items()] + [(20, None), (21, ""), (None, "x"), (22, " ".join(words(11, 3))), (23, " ".join(p[0]))]
    w = lambda n, s: " ".join(words(n, 100 + s))
    cut = lambda k, a, b: " ".join(p[k][a:b])
    corpus = [
        (1, w(50, 1)), (2, f"{w(20, 2)} {cut(0, 10, 22)} {w(20, 3)}"), (3, f"{w(20, 4)} {cut(0, 10, 21)} {w(20, 5)}"), (4, cut(1, 0, 90)), (5, cut(2, 78, 90)), (6, cut(2, 79, 90)),
        (7, None), (8, ""), (9, cut(3, 0, 12).upper().replace(" ", ",\n")), (10, cut(3, 0, 30).replace(" ", "</b>\xa0<i>")), (11, cut(4, 5, 20).replace("a", "a\xad")), (12, f"{cut(5, 0, 14)} {cut(6, 3, 17)} {cut(5, 20, 33)}"),
        (13, " ".join(x if i % 9 else "zzz" for i, x in enumerate(p[7]))), (14, cut(1, 0, 20)[:-3] + "-\n" + cut(1, 0, 20)[-3:]), (14, cut(1, 0, 20)), (None, cut(1, 0, 20)), (15, w(60_000, 9) + " " + cut(6, 0, 12)),
    ]
    return corpus, passages


@pytest.mark.parametrize("block", [leakage.PASSAGE_CHARS, 900])
def test_matches_brute_force(clashing, words, monkeypatch, block):
    monkeypatch.setattr(leakage, "PASSAGE_CHARS", block)
    corpus, passages = cases(words)
    assert found(clashing(corpus, "row long, text string"), clashing(passages, "probe long, text string")) == brute(corpus, passages)


def test_substitutions_are_tolerated(spark, words):
    corpus, passages = cases(words)
    df = leakage.overlaps(spark.createDataFrame(corpus, "row long, text string"), "row", "text", spark.createDataFrame(passages, "probe long, text string"), "probe", "text")
    r = df.where("id = 13 and passage_id = 7").first()
    assert r.n_words >= 80 and r.n_words - r.n_same == 9 and r.longest_run == 8 and r.first_word == r.passage_word


def test_plain():
    assert tokens(leakage.plain("<b>Uno</b> '''due''' [[tre|quat­tro]] cin-\nque &amp; [[sei]]​ 3-\n4")) == ["uno", "due", "quattro", "cinque", "sei", "3", "4"]


def test_nothing(spark):
    none, one = spark.createDataFrame([], "i long, t string"), spark.createDataFrame([(1, "a " * 30)], "i long, t string")
    for c, p in ((none, one), (one, none), (none, none)):
        assert leakage.overlaps(c, "i", "t", p, "i", "t").count() == 0


def test_query_matches_brute_force(spark, sf):
    corpus = [(r.row_id, r.text) for r in spark.read.parquet(f"{sf}/wiki_it.parquet").collect()]
    passages = [(r.probe_id, r.text) for r in spark.read.parquet(f"{sf}/wiki_probe.parquet").collect()]
    got = [tuple(r) for r in leakage.p4_found(spark, sf).select("row_id", "probe_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(corpus, passages)
    assert leakage.p4_items(spark, sf).count() == len({j for _, j in got})
    assert leakage.p4_overlaps(spark, sf).count() >= len(got)


def test_long_and_broken_tags(clashing, words):
    own = words(12, 3)
    long, broken = f'<a href="https://example.org/{"x" * 300}" title="una voce con un titolo lungo">', '<a href="x"\n  title="una voce">'
    corpus = [(k, " ".join([*own[:6], tag + own[6] + "</a>", *own[7:]])) for k, tag in enumerate((long, broken))] + [(2, " ".join([*own[:6], "a < b", *own[6:], ">"]))]
    assert found(clashing(corpus, "row long, text string"), clashing([(9, " ".join(own))], "probe long, text string")) == {(0, 9), (1, 9)}


@pytest.mark.parametrize(("rate", "recall"), [(0.05, 0.99), (0.1, 0.97), (0.2, 0.85)])
def test_recall_of_substituted_passages(rate, recall):
    """Passages of 20 to 60 words of which a share is replaced, between other words."""
    r = random.Random(1)
    pool = [f"w{k}" for k in range(3000)]
    some = lambda n: [r.choice(pool) for _ in range(n)]
    passages = [some(r.randint(20, 60)) for _ in range(300)]
    texts = [" ".join([*some(30), *(r.choice(pool) if r.random() < rate else w for w in p), *some(30)]) for p in passages]
    got = leakage._overlaps(list(range(300)), texts, leakage.Passages([(k, " ".join(p)) for k, p in enumerate(passages)]))
    found = {(x[0], x[1]) for x in got if x[4] >= 12 and 4 * x[5] >= 3 * x[4]}
    assert all(a == b for a, b in found) and len(found) >= recall * 300
