from __future__ import annotations

import re
import unicodedata

import numpy as np
from hypothesis import given, settings, strategies as st

from setaccio.llm import wordhash as w

TEXTS = ["", " ", "L'uovo è freddo, il libro_perde 12 cose.", "PERCHÉ perché perche", "a\0b", "😀 x".encode("utf-16", "surrogatepass").decode("utf-16"), "x" * 3000, "²½ ﬁne"]


def tokens(text):
    t = unicodedata.normalize("NFKD", text.casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in t if not unicodedata.combining(c)))


def check(texts):
    hashes, at = w.word_hashes([w.decompose(t) for t in texts])
    by = {}
    for k, t in enumerate(texts):
        own = tokens(t)
        assert at[k + 1] - at[k] == len(own)
        for word, h in zip(own, hashes[at[k] : at[k + 1]].tolist()):
            assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_words_are_runs_of_letters_and_digits():
    check(TEXTS)
    check([])
    check(["́", "́a"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aàbÈ1 _-.\ń’ßﬁ"), max_size=40), max_size=6))
def test_any_texts(texts):
    check(texts)


def test_shingles_stay_inside_their_text():
    hashes, at = w.word_hashes(["a b c d", "a b", "b c d e"])
    s, to = w.shingle_hashes(hashes, at, 3)
    assert to.tolist() == [0, 2, 2, 4] and s[1] == s[2] and len(np.unique(s)) == 3


def test_blocks_cover_all():
    texts = ["x" * n for n in (5, 50, 1, 0, 200, 3)]
    got = list(w.blocks(texts, 60))
    assert [i for a, b in got for i in range(a, b)] == list(range(6)) and list(w.blocks([])) == []


def test_every_letter_of_a_word_counts():
    """Words that differ in one place, however far from the beginning, have different hashes."""
    words = ["giallo", "gialla", "affollato", "affollata", "restauro", "restauor"] + ["a" * k + c + "a" * (70 - k) for k in range(71) for c in "bcdefgh"]
    assert len(set(w.word_hashes(words)[0].tolist())) == len(set(words))
