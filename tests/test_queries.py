"""Every query of the core against its SQL on the smallest tables; those without SQL by a test of their own."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from setaccio.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_, int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return str(v)


def table_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table_of(got) == table_of(want)


def column(con, sql):
    return [r[0] for r in con.execute(sql).fetchall()]


def test_html_query(spark, sf, con):
    got = {r.doc_id: r.text for r in QUERIES["html_to_text"](spark, sf).collect()}
    texts = dict(con.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall())
    assert set(got) == set(texts) and all(got[k] == t for k, t in texts.items() if "<" not in t and "&" not in t)
    assert not any("</p>" in t for t in got.values())


def test_probe_windows_query(spark, sf, con):
    rows = QUERIES["probe_windows"](spark, sf).collect()
    n = dict(con.execute("SELECT doc_id, n_chars FROM documents WHERE n_chars - 65 > 0").fetchall())
    assert len(rows) == 50 * len(n) and all(0 <= r.start < n[r.id] - 65 for r in rows)


def test_probe_ppl_query(spark, sf, con):
    rows = {r.id: r for r in QUERIES["probe_ppl"](spark, sf).collect()}
    n = dict(con.execute("SELECT doc_id, length(text) FROM documents WHERE text IS NOT NULL").fetchall())
    assert set(rows) == set(n) and all((rows[k].ppl is not None) == (m > 65) for k, m in n.items())
    assert all(2 < r.ppl < 300 for r in rows.values() if r.ppl)


def test_random_batch_query(spark, sf, con):
    rows = QUERIES["random_batch"](spark, sf).collect()
    n = dict(con.execute("SELECT doc_id, length(text) FROM documents WHERE text IS NOT NULL").fetchall())
    assert sorted(r.draw for r in rows) == list(range(500)) and all(r.n_x == r.n_y == 64 and 0 <= r.start < n[r.id] - 65 for r in rows)


def test_encoding_queries(spark, sf, con):
    import sentencepiece

    texts = dict(con.execute("SELECT row_id, text FROM wiki_it").fetchall())
    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert {r.row_id: r.n_ids for r in QUERIES["spm_encode"](spark, sf).collect()} == {k: len(model.encode(t)) if t else 0 for k, t in texts.items()}
    ranks = {r.row_id: r.n_ids for r in QUERIES["rank_encode"](spark, sf).collect()}
    assert set(ranks) == set(texts) and all((ranks[k] > 0) == bool(t) for k, t in texts.items())


def test_language_queries(spark, sf, con):
    langs = {r.doc_id: (r.lang, r.score) for r in QUERIES["lang_classifier"](spark, sf).collect()}
    kept = {r.doc_id for r in QUERIES["lang_filter"](spark, sf).collect()}
    assert kept and kept <= {k for k, (lang, _) in langs.items() if lang == "it"} and {lang for lang, _ in langs.values()} <= set(column(con, "SELECT lang FROM lang_samples"))


def test_shuffle_query(spark, sf, con):
    rows = QUERIES["seeded_shuffle"](spark, sf).collect()
    ids = column(con, "SELECT pair_id FROM sft_calendar_v2 ORDER BY pair_id")
    assert sorted(r.pair_id for r in rows) == ids and sorted(r.place for r in rows) == list(range(len(ids)))
    assert [r.pair_id for r in sorted(rows, key=lambda r: r.place)] != ids


def test_synthetic_queries(spark, sf):
    assert [QUERIES[q](spark, sf).count() for q in ("synth_static", "synth_v1", "synth_v2")] == [140, 1060, 4200]
    assert {r.missing for r in QUERIES["synth_shortfall"](spark, sf).collect()} == {0}


def test_judged_query(spark, sf, con):
    rows = QUERIES["ppl_judged"](spark, sf).collect()
    assert len(rows) == column(con, "SELECT count(*) FROM wiki_probe WHERE text IS NOT NULL")[0]
    assert all((r.ppl is None) == (r.label is None) and (r.ppl is None or r.ppl >= 1) for r in rows)


#: Queries that SQL cannot express; each has a test above.
TESTED = {"html_to_text", "probe_windows", "probe_ppl", "random_batch", "spm_encode", "rank_encode", "lang_classifier", "lang_filter", "seeded_shuffle", "synth_static", "synth_v1", "synth_v2", "synth_shortfall", "ppl_judged"}


def test_every_query_is_checked():
    assert set(QUERIES) - set(SQL) == TESTED


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, sf):
    df = registry.entry(spark, sf)
    assert df.columns == ["doc_id", "text"] and df.count() > 0
