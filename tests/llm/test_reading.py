from __future__ import annotations

import numpy as np
import pytest

from setaccio.llm import reading
from setaccio.llm.gbt import Boosted
from setaccio.llm.leakage import plain
from setaccio.llm.quality import known_language


@pytest.fixture(scope="module")
def models(spark, sf):
    return reading._models(spark, sf)


@pytest.fixture(scope="module")
def samples(spark, sf):
    return [(r.text, r.reading_level) for r in spark.read.parquet(f"{sf}/reading_samples.parquet").collect()]


def test_trees_learn_a_function():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + x[:, 1]
    model = Boosted(trees=120).fit(x[:2000], y[:2000])
    assert np.abs(model.predict(x[2000:]) - y[2000:]).mean() < 0.1
    assert np.allclose(Boosted(trees=3).fit(x[:, :1] * 0, y).predict(x[:, :1] * 0), y.mean(), atol=0.2)


def test_cross_validation(models, spark, sf):
    g = models[0]
    assert (g.level(g.grades) == g.levels).mean() >= 0.95
    rows = reading.p8_validation(spark, sf).collect()
    assert sum(r.n_samples for r in rows) == len(g.levels) and sum(r.n_right for r in rows) >= 0.95 * len(g.levels)


def test_held_out_samples_and_their_variants(spark, sf, samples):
    """Accuracy on samples that took no part in the training, changed in ways that don't change the level."""
    train, held = [s for k, s in enumerate(samples) if k % 3], [s for k, s in enumerate(samples) if not k % 3]
    g = reading.Grader(train, known_language(spark, sf))
    easy = next(t for t, k in held if k == 1)
    for change in (str, str.upper, lambda t: t.replace(".", ""), lambda t: t.replace(". ", " e poi "), lambda t: f"<p>{t}</p>".replace("\n", "</p>\n<p>"), lambda t: t + " " + easy.split(".")[0] + "."):
        got = g.level(g.grade([plain(change(t)) for t, _ in held]))
        assert (got == [k for _, k in held]).mean() >= 0.95


def test_windows(models, samples):
    g = models[0]
    texts = [plain(t) for t, _ in samples[:9]]
    together, at = reading.windows(texts, g.vocabulary, g.language)
    for k, t in enumerate(texts):
        alone, _ = reading.windows([t], g.vocabulary, g.language)
        assert np.allclose(alone, together[at[k] : at[k + 1]])
    assert reading.windows(["", "!"], g.vocabulary, g.language)[1].tolist() == [0, 0, 0]


def test_table(clashing, models, samples):
    text, level = samples[0]
    rows = [(1, text, "s"), (2, None, "s"), (3, "", None), (1, text, "s"), (None, text, "s"), (4, " ".join(text.split()[:59]), "s"), (5, text * 300, None), (6, "The crowded market ignored the old harbour and nobody knows whether it was the wind. " * 6, "s"), (7, "\n".join(f"- mela {k}" for k in range(80)), "s")]
    got = reading.reading_levels(clashing(rows, "doc long, text string, origin string"), "doc", "text", *models, "origin").collect()
    assert sorted((r.id, r.reading_level) for r in got if r.id != 5) == [(1, level), (1, level)]
    assert reading.reading_levels(clashing([], "doc long, text string"), "doc", "text", *models).count() == 0


def test_samples_of_every_level_are_needed(spark, sf):
    with pytest.raises(ValueError, match="every level"):
        reading.Grader([("uno due", 1)], known_language(spark, sf))


def test_queries(spark, sf):
    found = {r.doc_id: r.reading_level for r in reading.p8_found(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert found and all(v in (1, 2, 3) and len(texts[k].split()) >= 60 for k, v in found.items())
    assert sum(r.n_documents for r in reading.p8_profile(spark, sf).collect()) == len(found)
    sources = reading.p8_sources(spark, sf).collect()
    assert sum(r.n_documents for r in sources) == len(found) and all(r.same_level > 0.9 and r.mean_difference < 0.2 for r in sources if r.n_documents >= 5)


def test_one_phrase_over_and_over_has_no_level(clashing, models):
    rows = [(1, "la mamma prepara la cena per tutti " * 12)]
    assert reading.reading_levels(clashing(rows, "doc long, text string"), "doc", "text", *models).count() == 0
