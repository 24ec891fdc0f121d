"""The prefix trie against a plain one, on both ways through families."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waybill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + ts[h:])
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
        ends[ts].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)

    def saved(n):
        return (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(saved(k) for k in kids[n])

    def leaves(n):
        return sum(leaves(k) for k in kids[n]) if kids[n] else 1

    out = []
    for n, members in nodes.items():
        ids = ",".join(map(str, sorted(ends[n])))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), leaves(n), saved(n), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        kind = rng.randrange(4)
        for t in range(rng.randrange(1, 14)):
            text = f"t{t}" if kind < 2 else rng.choice(["a", "b", None, "", "é"])
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None]) if kind == 3 else "user", text))
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]
    return rows


@pytest.mark.parametrize("params", [prefix_trie.TrieParams(), prefix_trie.TrieParams(family_turns=5, segment=3, block=2), prefix_trie.TrieParams(family_turns=0, block=3)])
def test_trie_equals_plain_trie(spark, params):
    rows = made(60, 7)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), params).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_long_conversations_come_by_segments(spark):
    rows = [(c, t, "user", f"x{t % 7 if t < 900 or c == 0 else c}") for c in (0, 1, 7) for t in range(1000)] + [(2, 5, None, None)]
    params = prefix_trie.TrieParams(family_turns=500, segment=64, block=32)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), params).select(*COLUMNS).collect()
    want = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and max(r.depth for r in got) == 1000


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (5, None, None, None), (5, None, None, None), (6, 0, "user", "y" * 1_000_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("base", "conv", "depth", "k1", "members", "size")})
    got = prefix_trie.trie(frame).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert prefix_trie.trie(frame.limit(0)).count() == 0
