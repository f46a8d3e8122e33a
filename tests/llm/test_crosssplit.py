from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setaccio.llm import crosssplit
from setaccio.llm.requests import canonical, same_but_for_slip, same_request

BASE = "Segna in agenda la revisione del contratto con Ada Neri il 16 novembre alle 13:00."
SAME = [
    BASE.upper(), BASE.replace("con Ada Neri il 16 novembre", "il 16 novembre con Ada Neri"), BASE.replace("16 novembre", "16/11"), BASE.replace("il 16 novembre", "il 16.11."), BASE.replace("novembre", "nov."), BASE.replace("13:00", "13.00"),
    BASE.replace("13:00", "13h00"), BASE.replace("13:00", "13 e 00"), BASE.replace("alle", "alle ore"), BASE.replace("il 16", "il giorno 16"), "Per favore, " + BASE[0].lower() + BASE[1:], BASE[:-1] + ", grazie mille!", f'"{BASE}"', BASE.replace(" ", "\xa0\xa0"),
    BASE.replace("contratto", "conrtatto"), BASE.replace("revisione", "revvisione"), BASE.replace("agenda", "agnda"), BASE.replace("novembre", "nvoembre"), "Ciao, " + BASE.replace("revisione", "reviisione")[:-1] + " per corteesia",
]
OTHER = [
    BASE.replace("16", "17"), BASE.replace("13:00", "13:15"), BASE.replace("novembre", "ottobre"), BASE.replace("Ada Neri", "Ida Neri"), BASE.replace("la revisione", "la firma"), BASE.replace("Segna in agenda", "Togli dall'agenda"), BASE.replace("con Ada Neri ", ""), "", "   ", "!!!",
]


@pytest.mark.parametrize("other", SAME)
def test_same(other):
    assert same_request(canonical(BASE), canonical(other))


@pytest.mark.parametrize("other", OTHER)
def test_other(other):
    assert not same_request(canonical(BASE), canonical(other))


@pytest.mark.parametrize(("a", "b", "same"), [("fornitori", "fronitori", True), ("settembre", "settttembre", True), ("calendario", "calendrio", True), ("ada", "ida", False), ("1234", "1243", False), ("insieme", "iseme", True), ("il", "la", False), ("bapintesi", "gapintesi", False), ("a", "a", True)])
def test_slips(a, b, same):
    assert same_but_for_slip(a, b) == same == same_but_for_slip(b, a)


def test_numbers():
    assert canonical("tel. 0124 3867812") == canonical("Tel. 01243867812!") == canonical("tel. 0124-3867812")
    assert canonical(None) == ([], []) == canonical("")


def brute(rows):
    forms = [(i, s, canonical(p)) for i, p, s, _ in rows if i is not None and p and s in ("train", "val", "test")]
    forms = [f for f in forms if f[2] != ([], [])]
    return {(min(a, b), max(a, b)) for a, s, x in forms if s == "train" for b, t, y in forms if t != "train" and (x == y or same_request(x, y))}


def corpus():
    r = random.Random(2)
    titles, names, months = ["la revisione del contratto", "il corso di nuoto", "la prova di coro", "l'esame di guida"], ["Ada Neri", "Bruno Conti", "Vespeposta Tracosametti"], ["marzo", "giugno", "novembre"]
    rows = []
    for k in range(400):
        t = f"Segna {r.choice(titles)} con {r.choice(names)} il {r.randint(1, 12)} {r.choice(months)} alle {r.randint(8, 10)}:00"
        if r.random() < 0.3:
            t = f"Che tempo farà a {r.choice(['Comepo', 'Ripapi', 'Sicapa'])} {r.choice(['Nagere', 'Trarona'])} Vecchia?"
        if r.random() < 0.4:
            at = r.randrange(3, len(t) - 1)
            t = r.choice([t[:at] + t[at] + t[at:], t[:at] + t[at + 1] + t[at] + t[at + 2 :]]) if t[at].isalpha() and t[at + 1 : at + 2].isalpha() else t
        rows.append((k, t, r.choice(["train", "train", "val", "test", None, "dev"]), r.choice(["x", None])))
    return rows + [(1000, None, "train", "x"), (1001, "", "val", "x"), (1002, "...", "test", "x"), rows[0], (None, rows[0][1], "train", "x"), (1003, BASE + " parola" * 4000, "train", "x"), (1004, BASE + " parola" * 4000 + ".", "val", "x")]


def pairs(df, **parameters):
    members, links = crosssplit.cross_split(df, "rec", "ask", "part", "origin", **parameters)
    by = {}
    for r in members.collect():
        by.setdefault(r.cls, set()).add((r.id, r.side))
    sides = [(a, b) for r in links.collect() for a, b in ((r.a, r.b), (r.b, r.a))] + [(c, c) for c in by]
    return {(min(x, y), max(x, y)) for a, b in sides for x, s in by[a] for y, t in by[b] if s == 1 and t == 2}


@pytest.mark.parametrize(("part", "sent"), [(2, 10**6), (7, 0), (crosssplit.PART, 10**6)])
def test_matches_brute_force(clashing, part, sent):
    """Whatever the size of parts, and however the words' groups get to the texts."""
    rows = corpus()
    got = pairs(clashing(rows, "rec long, ask string, part string, origin string"), part=part, most_sent=sent)
    assert got == brute(rows) and len(got) > 50


def some_texts(r):
    texts = [[r.randrange(r.choice([2, 4])) for _ in range(r.randint(1, r.choice([9, 40])))] for _ in range(r.randint(1, 8))]
    texts += texts[: r.randint(0, 2)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return texts, crosssplit.SuffixArray(np.array([t for own in texts for t in own], dtype=np.uint64), offsets)


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_array():
    r = random.Random(1)
    for _ in range(100):
        texts, array = some_texts(r)
        suffixes = [tuple(t[i:]) for t in texts for i in range(len(t))]
        assert [suffixes[i] for i in array.order] == sorted(suffixes)
        i, j = (np.array([r.randrange(len(suffixes)) for _ in range(30)]) for _ in range(2))
        assert array.common_prefix(i, j).tolist() == [common(suffixes[x], suffixes[y]) for x, y in zip(i, j)]
        sides = np.array([r.choice([1, 2, 3]) for _ in texts])
        across = lambda x, y: array.text[x] != array.text[y] and sides[array.text[x]] | sides[array.text[y]] == 3  # noqa: B023, E731
        want = [max([common(s, t) for k, t in enumerate(suffixes) if across(i, k)], default=0) for i, s in enumerate(suffixes)]
        got = crosssplit.spans(array, sides)
        assert got.tolist() == want
        for least in (1, 3):
            covered = [{k for i, n in zip(range(a, b), want[a:b]) if n >= least for k in range(i, i + n)} for a, b in zip(array.offsets, array.offsets[1:])]
            assert crosssplit.coverage(array, got, least).tolist() == [len(c) / len(t) for c, t in zip(covered, texts)]


def test_nothing(clashing):
    assert pairs(clashing([], "rec long, ask string, part string, origin string")) == set()


def test_queries(spark, sf):
    rows = [(r.pair_id, r.prompt, r.split, r.source) for r in spark.read.parquet(f"{sf}/sft_calendar_v2.parquet").collect()]
    found = [tuple(r) for r in crosssplit.p2_found(spark, sf).select("pair_id_a", "pair_id_b").collect()]
    assert set(found) == brute(rows) and len(set(found)) == len(found)
    assert crosssplit.p2_counts(spark, sf).agg(F.sum("n_pairs")).first()[0] == len(found)


def test_hot_beginning_in_any_order(clashing):
    """Many requests with the same values and beginning, and the same ones with their phrases in another order."""
    r = random.Random(4)
    own = sorted({"".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(2)) for _ in range(90)})
    rows = [(2 * k, f"Segna la revisione del contratto in agenda {w} il 15/11 alle 10:30", "train", "x") for k, w in enumerate(own)]
    rows += [(2 * k + 1, f"Segna in agenda la revisione del contratto {w} il 15/11 alle 10:30", "val", "x") for k, w in enumerate(own)]
    want = brute(rows)
    assert len(want) >= len(own) > 60
    assert pairs(clashing(rows, "rec long, ask string, part string, origin string")) == want


def test_slips_in_many_words(clashing):
    """Slips spread so evenly that no stretch of the two requests is long, without values and with them."""
    rows = [
        (1, "Che tmpo fara a Comepo Nagere Vecchia?", "train", "x"), (2, "Che tempo fara a Comepo Ngere Vecchia?", "val", "x"), (3, "Che tempo fara a Comepo Nagero Vecchia?", "val", "x"),
        (4, "Segn in agnda la revsione del conratto di Brno Cnti il 3 marzo alle 9:00", "train", "x"), (5, "Segna in agenda la revisione del contratto di Bruno Conti il 3/3 alle 9:00", "test", "x"),
        (6, "Segna in agenda la revisione del contratto di Bruno Conti il 4/3 alle 9:00", "test", "x"), (7, "Chi ha fodato Sicpa", "train", None), (8, "Chi ha fondato Sicapa", "val", None),
    ]
    assert brute(rows) == {(1, 2), (4, 5), (7, 8)}
    assert pairs(clashing(rows, "rec long, ask string, part string, origin string")) == {(1, 2), (4, 5), (7, 8)}


def test_one_request_in_many_writings(clashing):
    """More writings of one request than a part holds, which no key splits; a class of copies on both sides among them."""
    r = random.Random(6)
    words = "segna in agenda la revisione del contratto di fornitura".split()
    rows = []
    for k in range(120):
        r.shuffle(words)
        rows.append((k, " ".join(words) + " il 3 marzo alle 9:00" + "!" * (k % 3), ("train", "val", "test")[k % 3], "x"))
    rows += [(200, rows[0][1], "val", None), (201, rows[0][1], "train", None), (202, rows[0][1].replace("marzo", "aprile"), "val", None)]
    assert pairs(clashing(rows, "rec long, ask string, part string, origin string"), part=8) == brute(rows)


def test_phrases_shared_by_hundreds(clashing):
    """Fillers with the same phrases as a true pair, whose last two phrases are exchanged: found however many there are."""
    pair = [(0, "Segna la revisione del contratto con Ada Neri per la sede di Trarona", "train", "x"), (1, "Segna la revisione del contratto per la sede di Trarona con Ada Neri", "val", "x")]
    fillers = [(10 + k, f"Segna la revisione del contratto con Ada Neri per la sede di {chr(97 + k % 26)}{chr(97 + k // 26)}opo", ("train", "val")[k % 2], "x") for k in range(400)]
    rows = pair + fillers
    got = pairs(clashing(rows, "rec long, ask string, part string, origin string"), part=32)
    assert (0, 1) in got and got == brute(rows)


def test_hashes_are_sparks(spark):
    words = ["", "a", "perch\u00e9", "@d3/4", "x" * 100]
    got = [x.h for x in spark.createDataFrame(list(enumerate(words)), "k int, w string").orderBy("k").select(F.xxhash64("w").alias("h")).collect()]
    assert got == np.array([crosssplit._hash(w) for w in words], dtype=np.uint64).view(np.int64).tolist()


def test_counts_from_class_sizes(spark, sf):
    rows = {r.pair_id: r for r in spark.read.parquet(f"{sf}/sft_calendar_v2.parquet").collect()}
    want = {}
    for r in crosssplit.p2_found(spark, sf).collect():
        t, h = sorted((rows[r.pair_id_a], rows[r.pair_id_b]), key=lambda x: x.split != "train")
        n, held, train = want.setdefault((h.split, h.source, t.source), (0, set(), set()))
        want[h.split, h.source, t.source] = (n + 1, held | {h.pair_id}, train | {t.pair_id})
    got = {(r.split, r.source, r.train_source): (r.n_pairs, r.n_held_out, r.n_train) for r in crosssplit.p2_counts(spark, sf).collect()}
    assert got == {k: (n, len(a), len(b)) for k, (n, a, b) in want.items()}
