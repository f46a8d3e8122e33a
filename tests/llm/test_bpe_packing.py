from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from setaccio.llm import bpe, packing

PATH = bpe.vocabulary("byte_bpe_50k")
pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


TEXTS = ["", " ", "\n\n  \t", "<|endoftext|>", "Perché l'uovo, è così?", "日本語 🇮🇹‍", "a" * 400, "zq" * 700, "\x00\x07", "12345 67.8", "don't we'll", "x   y  ", " ".join(["parola"] * 5000)]


def test_known_texts(encoder, reference):
    for t in TEXTS:
        assert encoder.encode(t) == reference.encode_ordinary(t) and encoder.count(t) == len(encoder.encode(t))
    assert encoder.encode(None) == [] and encoder.count(None) == 0


def test_round_trip(encoder):
    pieces = {v: k for k, v in bpe.load_ranks(PATH).items()}
    for t in TEXTS:
        assert b"".join(pieces[i] for i in encoder.encode(t)).decode() == t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, text):
    if text.encode("utf-8", "ignore").decode() == text:
        assert encoder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_scan_and_heap_agree(encoder, raw):
    assert bpe.merge_short(raw, encoder.ids.ranks) == bpe.merge_long(raw, encoder.ids.ranks)


def test_memory_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Encoder(PATH)
    text = "uno due tre quattro cinque sei uno due"
    assert own.encode(text) == reference.encode_ordinary(text) and len(own.ids) <= 3


def test_long_texts_word_by_word(monkeypatch, encoder, reference):
    monkeypatch.setattr(bpe, "AT_ONCE", 5)
    assert encoder.encode(TEXTS[4]) == reference.encode_ordinary(TEXTS[4])


def test_table(clashing, reference):
    rows = [*enumerate(TEXTS), (99, None), (0, "again"), (None, "no id")]
    got = bpe.encode(clashing(rows, "doc long, text string").drop("ids"), "doc", "text", PATH).collect()
    assert sorted((str(r.doc), list(r.ids)) for r in got) == sorted((str(i), reference.encode_ordinary(t) if t else []) for i, t in rows)
    assert bpe.encode(clashing([], "doc long, text string"), "doc", "text", PATH).count() == 0


def slow_best_fit(sizes, capacity):
    left, where = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [x for x in left if x >= sizes[k]]
        if fits:
            left[left.index(min(fits))] -= sizes[k]
        else:
            left.append(capacity - sizes[k])
        where[k] = 1
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.lists(st.integers(1, 70), max_size=60))
def test_best_fit(capacity, sizes):
    sizes = [s for s in sizes if s <= capacity]
    where, bins = packing.best_fit_decreasing(np.array(sizes, dtype=np.int64), capacity)
    used = np.bincount(where, weights=sizes, minlength=bins) if sizes else np.zeros(0)
    assert (used <= capacity).all() and (used > 0).all()
    assert sorted((capacity - used).astype(int).tolist()) == slow_best_fit(sizes, capacity)


def check_bins(rows, texts, windows, encoder):
    for window, capacity in windows:
        own = [r for r in rows if r.window_id == window]
        fill = {}
        for r in own:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
        assert max(fill.values(), default=0) <= capacity
        by = {}
        for r in own:
            by.setdefault(r.doc, []).append((r.first_token, r.n_tokens))
        want = {}
        for k, t in texts:
            if n := encoder.count(t):
                want.setdefault(k, []).append(n)
        assert set(by) == set(want)
        for k, pieces in by.items():
            assert sum(n for _, n in pieces) == sum(want[k])
            if len(want[k]) == 1:
                assert len(pieces) == -(-want[k][0] // capacity)
                assert sorted(pieces) == [(a, min(capacity, want[k][0] - a)) for a in range(0, want[k][0], capacity)]


@pytest.mark.parametrize("share", [7, 50_000])
def test_packing(clashing, encoder, words, share):
    texts = [(k, " ".join(words(random.Random(k).randint(0, 60), k))) for k in range(80)] + [(900, None), (901, ""), (902, " ".join(words(3000, 1))), (3, "again the same id"), (None, "no id at all")]
    windows = [(1, 64), (2, 333)]
    rows = packing.pack(clashing(texts, "doc long, text string"), "doc", "text", windows, PATH, share).collect()
    check_bins(rows, texts, windows, encoder)


def test_packing_ignores_the_layout(clashing, words):
    texts = [(k, " ".join(words(random.Random(k).randint(0, 60), k))) for k in range(120)] + [(5, "again the same id"), (None, "no id"), (None, "no id")]
    df = clashing(texts, "doc long, text string")
    one, other = (sorted(map(tuple, packing.pack(df.repartition(n), "doc", "text", [(1, 64), (2, 333)], PATH, 20).collect()), key=repr) for n in (1, 9))
    assert one == other and len({r[5] >> 33 for r in one}) > 2


def test_equal_rows_beyond_a_share(clashing, encoder):
    texts = [(None, "una frase uguale")] * 100
    rows = packing.pack(clashing(texts, "doc long, text string"), "doc", "text", [(1, 16)], PATH, 4).collect()
    check_bins(rows, texts, [(1, 16)], encoder)
    assert len(rows) == 100


def test_packing_edges(spark):
    df = spark.createDataFrame([], "doc long, text string")
    assert packing.pack(df, "doc", "text", [(1, 8)], PATH).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.pack(df, "doc", "text", [(1, 0)], PATH)


def test_fill_query(spark, sf):
    rows = packing.p7_fill(spark, sf).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.fewest_bins <= r.n_bins and r.fullest <= r.capacity_tokens and r.fill > 0.85


def test_ids_query(spark, sf, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: list(r.ids) for r in bpe.p6_ids(spark, sf).collect()}
    assert got == {k: reference.encode_ordinary(t) if t else [] for k, t in texts.items()}
