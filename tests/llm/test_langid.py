from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from setaccio.llm import langid, quality


@pytest.fixture(scope="module")
def models(spark, sf):
    return langid.Languages(langid._samples(spark, sf)), quality.known_language(spark, sf)


TEXTS = {
    "it": "Il sindaco silenzioso non ha organizzato il comitato discreto: fra due colline la guida ripara la tempesta.",
    "en": "There are about forty people in the village who know why the crowded market ignored the old harbour.",
    "fr": "En 1836, le port sombre suivait la couverture, qui ouvrait le peintre rare après le long hiver.",
    "es": "El huerto vacío olvidó el jardín hermoso sin ningún aviso, y la cosecha rota cruzaba la linterna lejana.",
    "de": "Im Jahr 1370 malte ein Kapitän eine Laterne hinter der Kirche, doch niemand weiß, ob die Reise den Sturm hörte.",
    "pt": "Quando o carpinteiro pequeno levou o jardim verde, ficou claro que o capitão vazio não consertou a janela.",
}


def found(texts, models):
    return [langid.languages_of(r) for r in langid.segments(texts, models[0])]


def test_one_language(models):
    assert found(list(TEXTS.values()), models) == [[k] for k in TEXTS]
    assert found([t.upper() for t in TEXTS.values()], models) == [[k] for k in TEXTS]


def test_two_languages(models):
    pairs = [(a, b) for a in TEXTS for b in TEXTS if a < b]
    assert found([f"{TEXTS[a]} {TEXTS[b]}" for a, b in pairs], models) == [sorted(p) for p in pairs]
    assert found([f"{TEXTS[a][:-1]} {TEXTS[b][:-1]}" for a, b in pairs], models) == [sorted(p) for p in pairs]  # without stops


def test_foreign_words_dont_mix(models):
    assert found([TEXTS["it"].replace("non ha", "à la carte non smart working ha")], models) == [["it"]]


def test_segments_have_places(models):
    text = f"{TEXTS['it']}\n{TEXTS['en']}"
    rows = langid.segments(["x", text, ""], models[0])
    assert rows[2] == [] and [r[0] for r in rows[1]] == ["it", "en"]
    assert text[rows[1][1][1] : rows[1][1][2]] == TEXTS["en"][:-1] and all(0 < r[6] <= 1 for r in rows[1])


def test_blocks_dont_matter(models):
    texts = [*TEXTS.values(), "", "é così", " ".join(TEXTS.values()), "x" * 700, "123 ..."]
    assert langid.segments(texts, models[0]) == [langid.segments([t], models[0])[0] for t in texts]


def test_counts_match_a_plain_count(models):
    known, _ = models
    words = langid.Words(["casá the x " + "y" * 301])
    hits, total = known.counts(words)
    assert total.tolist() == [9, 6, 1, 0] and hits[1, known.names.index("en")] == 6 and (hits <= total[:, None]).all()


@pytest.mark.parametrize(
    ("label", "code"),
    [("it", "it"), ("IT", "it"), ("it-IT", "it"), ("it_IT", "it"), ("ita", "it"), ("eng", "en"), ("en-GB", "en"), ("deu", "de"), ("ger", "de"), (" fr ", "fr"), ("Italiano", "it"), ("", None), (None, None), ("-", None), ("??", None), ("und", None), ("unknown", None), ("nl", None)],
)
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(langid.label_language(F.col("l")).alias("c")).first().c == code


def test_table(clashing, models):
    rows = [(1, TEXTS["en"], "it"), (2, None, "it"), (3, "", None), (1, TEXTS["en"], "it"), (None, TEXTS["it"], "it"), (4, TEXTS["it"] * 2000, None), (5, "42", "x")]
    df = langid.identify(clashing(rows, "rec long, text string, lang string"), "rec", "text", *models, "lang")
    got = sorted((r.id, tuple(r.langs)) for r in df.collect())
    assert got == [(1, ("en",)), (1, ("en",)), (2, ()), (3, ()), (4, ("it",)), (5, ())]
    assert langid.identify(clashing([], "rec long, text string"), "rec", "text", *models).count() == 0


def test_samples_are_told_apart(spark, sf):
    """Held-out accuracy: each sample by a filter of the others."""
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/lang_samples.parquet").collect()]
    words = [(r.lang, r.word) for r in spark.read.parquet(f"{sf}/common_words.parquet").collect()]
    right = 0
    for part in range(4):
        known = langid.Languages([r for k, r in enumerate(rows) if k % 4 != part] + words)
        own = [r for k, r in enumerate(rows) if k % 4 == part]
        right += sum(langid.languages_of(s) == [lang] for (lang, _), s in zip(own, langid.segments([t for _, t in own], known)))
    assert right >= 0.95 * len(rows)


def test_queries(spark, sf):
    found = langid.p3_found(spark, sf).collect()
    assert len({tuple(r) for r in found}) == len(found)
    records = {r.rec_id: r for r in langid.p3_records(spark, sf).collect()}
    for r in found:
        own = records[r.rec_id]
        assert own.kind in ("prose", "list") and r.lang in own.langs.split() and (own.missing or own.mixed or own.wrong)
    assert langid.p3_segments(spark, sf).where("begin >= end or confidence < 0 or confidence > 1").count() == 0


def slowly_joined(label):
    label = list(label)
    while len(label) > langid.LEAST_WORDS:
        runs = [(k, len(list(g))) for k, g in itertools.groupby(label)]
        k = min((i for i in range(len(runs)) if runs[i][1] < langid.LEAST_WORDS), key=lambda i: (runs[i][1], i), default=None)
        if k is None or len(runs) == 1:
            break
        beside = [runs[j] for j in (k - 1, k + 1) if 0 <= j < len(runs)]
        runs[k] = (max(beside, key=lambda r: r[1])[0], runs[k][1])
        label = [v for v, n in runs for _ in range(n)]
    return label


def test_short_runs_join():
    r = random.Random(3)
    for _ in range(500):
        label = [v for _ in range(r.randint(1, 12)) for v in [r.randrange(3)] * r.choice([1, 1, 2, 3, 5])]
        assert langid._joined(np.array(label)).tolist() == slowly_joined(label)


def test_a_million_words_in_short_runs():
    label = np.tile([0, 0, 1, 2, 2], 200_000)
    began = time.process_time()
    assert len(langid._joined(label)) == 1_000_000 and time.process_time() - began < 60
