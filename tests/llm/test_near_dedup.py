"""Near-duplicates against brute force, with groups large enough for every branch of the join."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import near_dedup
from waybill.llm.components import components
from waybill.llm.near_dedup import DedupParams
from waybill.llm.workspace import Workspace


def shingles(text, k):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, params):
    sets = [(i, shingles(t, params.shingle)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[a + 1 :]:
            both = len(s & r)
            if s and r and 100 * both >= params.percent * len(s | r):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def check(spark, rows, params):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    want = brute(rows, params)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("params", [DedupParams(3, 85), DedupParams(5, 80)])
def test_like_brute_force(spark, params):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one", "two words", "TWO  words", "É", "é", "x y z", "x y z x y z", "a " * 40_000, "a " * 40_001]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 160))]
        texts += [edited(rng, base, rng.randrange(0, 6)) for _ in range(rng.randrange(1, 12))]
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**5)}" for _ in range(60)) for _ in range(40)]
    rng.shuffle(texts)
    check(spark, [(i * 3 + 1, t) for i, t in enumerate(texts)], params)


def test_large_nodes_and_second_round(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = [edited(rng, base, rng.randrange(0, 12)) for _ in range(260)]
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "SMALL_WIDE", 48)
    check(spark, list(enumerate(texts)), DedupParams(3, 85))
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)  # nodes that stay large
    monkeypatch.setattr(near_dedup, "UNIT_HASHES", 4000)  # and units of some thirty sets
    check(spark, list(enumerate(texts)), DedupParams(3, 85))


def test_links_inside_a_unit_are_a_spanning_forest():
    rng = random.Random(8)
    for _ in range(20):
        n = rng.randrange(1, 60)
        sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 60))], np.uint64)) for _ in range(n)]
        labels = np.array([rng.randrange(n) for _ in range(n)])
        top = {int(x): int(x) for x in labels}

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        u, v = near_dedup.links_inside(np.arange(n), labels, [s.tobytes() for s in sets], 70)
        for a, b in zip(u, v, strict=True):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both)
            assert find(labels[a]) != find(labels[b])
            top[find(labels[a])] = find(labels[b])
        for a in range(n):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                    assert find(labels[a]) == find(labels[b])


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, kept string, n_shingles int")
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = near_dedup.keep_one(docs.withColumn("_gone", F.lit(1)).withColumn("gone", F.lit(2)))
    assert kept.columns == [*docs.columns, "_gone", "gone"] and kept.count() == 4
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{k: 100 for k in range(101, 160)}, 301: 300}


def test_sketches_estimate_likeness(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    pairs = [(edited(rng, base, 3), edited(rng, base, 3)) for _ in range(30)]
    for a, b in pairs:
        s, t = (next(near_dedup.shingle_sets([x], 3)) for x in (a, b))
        true = len(set(s) & set(t)) / len(set(s) | set(t))
        like = (near_dedup.tokens_of(s, 1, 512) == near_dedup.tokens_of(t, 1, 512)).mean()
        assert abs(true - like) < 0.1
