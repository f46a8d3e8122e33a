from __future__ import annotations

import itertools
import random

import pytest
from test_words import tokens

from setaccio.llm import components, neardup


def shingles(text, n):
    t = tokens(text)
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}


def brute(docs, n, threshold):
    sets = {i: s for i, t in docs if i is not None and t and (s := shingles(t, n))}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(words):
    r = random.Random(1)
    docs = []
    for k in range(60):
        own = words(r.randint(3, 120), k)
        docs.append(" ".join(own))
        for _ in range(r.randint(0, 3)):
            edited = list(own)
            for _ in range(r.randint(0, max(1, len(own) // 12))):
                at = r.randrange(len(edited))
                edited[at : at + r.randint(0, 1)] = words(r.randint(0, 2), r.randrange(999))
            docs.append(" ".join(edited))
    docs += [docs[0].upper(), docs[0] + "!", None, "", "  ", "due parole", "è così davvero", "E cosi' DAVVERO", " ".join(words(20_000, 5))]
    docs = list(enumerate(docs))
    return [*docs, docs[0], (None, docs[1][1])]


def pairs(members, links):
    by = {}
    for r in members.collect():
        by.setdefault(r.class_id, set()).add(r.id)
    out = {(min(x, y), max(x, y)) for r in links.collect() for x in by[r.a] for y in by[r.b]}
    return out | {p for own in by.values() for p in itertools.combinations(sorted(own), 2)}


def test_matches_brute_force(clashing, words):
    docs = corpus(words)
    df = clashing(docs, "rec long, text string")
    for n, threshold in ((3, 0.6), (5, 0.8)):
        assert pairs(*neardup.near_duplicates(df, "rec", "text", n, threshold)) == brute(docs, n, threshold)


def test_similarity_is_exact(spark):
    a, b = "a b c d e f g h", "a b c d e f g x"
    _, links = neardup.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "i long, t string"), "i", "t", 3, 0.6)
    assert [(r.a, r.b, r.similarity) for r in links.collect()] == [(1, 2, 5 / 7)]


def test_nothing(spark):
    df = spark.createDataFrame([], "i long, t string")
    members, links = neardup.near_duplicates(df, "i", "t")
    assert members.count() == links.count() == 0
    members, links = neardup.near_duplicates(spark.createDataFrame([(1, None), (2, "a b")], "i long, t string"), "i", "t")
    assert members.count() == links.count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(7, None), (None, 7), (300, 300)]
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def components_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [3, neardup.HOT])
def test_groups_match_brute_force(clashing, words, monkeypatch, hot):
    """Whether or not keys are dealt to several tasks."""
    monkeypatch.setattr(neardup, "HOT", hot)
    docs = corpus(words)
    df = clashing(docs, "rec long, text string")
    for n, threshold in ((3, 0.6), (5, 0.8)):
        got = {r.id: r.group_id for r in neardup.near_groups(df, "rec", "text", n, threshold).collect()}
        ids = {i for i, t in docs if i is not None and t and shingles(t, n)}
        assert got == components_of(brute(docs, n, threshold), ids)
    assert neardup.near_groups(clashing([], "rec long, text string"), "rec", "text").count() == 0


def family(words, n, length=200):
    own = words(length, 1)
    return [(k, " ".join([*own[: k % length], f"parola{k}", *own[k % length + 1 :]])) for k in range(n)]


def test_a_family_of_edited_copies_makes_no_pairs(spark, words, monkeypatch):
    """One row a member and bucket is compared, and nothing more, since all are in one group by then."""
    compared = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame(family(words, 400), "rec long, text string")
    groups = neardup.near_groups(df, "rec", "text", 3, 0.6).collect()
    assert {r.group_id for r in groups} == {0} and len(groups) == 400 and compared[0] <= 40 * 400 and compared[1] == 0


def test_groups_query(spark, sf):
    found, groups = neardup.p5_found(spark, sf), neardup.p5_groups(spark, sf)
    of = {r.rec_id: r.group_id for r in groups.collect()}
    assert all(of[r.rec_id_a] == of[r.rec_id_b] and r.rec_id_a < r.rec_id_b for r in found.collect())
    assert groups.count() == len(of)


def test_found_matches_brute_force_on_the_table(spark, sf):
    docs = [(r.rec_id, r.text) for r in spark.read.parquet(f"{sf}/culturax_it_ppl95.parquet").collect()]
    assert {tuple(r) for r in neardup.p5_found(spark, sf).collect()} == brute(docs, 3, 0.6)
