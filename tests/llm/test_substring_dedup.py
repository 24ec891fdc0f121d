"""Repeated passages against plain windows, on one cell and on many."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import substring_dedup as sd

SHAPE = "doc_id long, text string"


def plain(rows, k):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for p in range(len(words) - k + 1):
            if i is not None:
                key = tuple(words[p : p + k])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, words in split:
        gone = {q for p in range(len(words) - k + 1) if i is not None and first[tuple(words[p : p + k])] < i for q in range(p, p + k)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "c" * 30, "😀"])
    passages = [[f"p{j}{rng.randrange(99)}" for _ in range(rng.randrange(3, 30))] for j in range(6)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 9))]
        for _ in range(rng.randrange(0, 4)):
            passage = rng.choice(passages)
            cut = rng.randrange(len(passage))
            words += passage[cut:] if rng.random() < 0.5 else passage
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 6))]
        rows.append((i if rng.random() < 0.9 else None, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [rows[3], rows[3], (7, rows[5][1]), (500, rows[4][1]), (None, None), (501, None), (502, ""), (503, " \n ")]
    rows += [(600 + i, "one hot passage that many documents have word for word in just this way " + f"v{i % 3}") for i in range(40)]
    rng.shuffle(rows)
    return rows


def got(frame):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize(("params", "parts"), [(sd.SubstringParams(), 1), (sd.SubstringParams(4, 2, 200, 1), 3), (sd.SubstringParams(6, 3, 1000, 2), 4), (sd.SubstringParams(3, 3, 1, 1), 2)])
def test_removed_words_equal_plain_windows(spark, params, parts):
    rows = made(params.window)
    docs = spark.createDataFrame(rows, SHAPE).repartition(parts).withColumns({c: F.lit("mine") for c in ("cell", "payload", "part", "row")})
    assert got(sd.repeated_passages(docs, params)) == plain(rows, params.window)


def test_spans_are_the_same_words_at_their_source(spark):
    params = sd.SubstringParams(5, 3, 2000, 4)
    rows = [(i, t) for i, (_, t) in enumerate(made(9))]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    judged = sd.repeated_passages(docs, params)
    found = sd.with_both_texts(sd.spans(judged, params), docs).collect()
    assert found and all(r.text == r.source_text and r.source_doc < r.doc_id and r.text.count(" ") == r.words - 1 for r in found)
    assert len(found) == judged.agg(F.sum(F.size("spans"))).first()[0]
    covered = {(r.doc_id, p) for r in found for p in range(r.start, r.start + r.words)}
    assert len(covered) == judged.agg(F.sum("n_removed")).first()[0]


def test_a_path_ends_where_several_edges_leave_its_node(spark):
    """In document 2 the passage goes on as in document 0, but document 1 leaves the same node for another word."""
    stem = " ".join(f"w{i}" for i in range(20))
    rows = [(0, f"{stem} x y z"), (1, f"{stem} q r s"), (2, f"{stem} x y z"), (3, f"{stem} q r s")]
    params = sd.SubstringParams(5, 2, 10**6, 4)
    judged = sd.repeated_passages(spark.createDataFrame(rows, SHAPE), params)
    spans = {(r.doc_id, r.start, r.words, r.source_doc, r.source_start) for r in sd.spans(judged, params).collect()}
    assert {s for s in spans if s[0] == 2} == {(2, 0, 20, 0, 0), (2, 16, 7, 0, 16)}
    assert {s for s in spans if s[0] == 3} == {(3, 0, 20, 0, 0), (3, 16, 7, 1, 16)}


def test_no_rows_and_very_long_texts(spark):
    docs = spark.createDataFrame([(2, "long " * 200_000), (1, "long " * 13), (3, "x" * 1_000_000)], SHAPE)
    assert got(sd.repeated_passages(docs)) == plain([(2, "long " * 200_000), (1, "long " * 13), (3, "x" * 1_000_000)], 13)
    assert sd.repeated_passages(docs.limit(0)).count() == 0


def test_word_hashes_depend_on_words_alone():
    one, other = sd.word_hashes(b" ab\tb a b\nab "), sd.word_hashes(b"ab b a b ab")
    assert one.tolist() == other.tolist() and len(set(one.tolist())) == 3 and one[0] == one[4]
    assert len(sd.word_hashes(b"")) == len(sd.word_hashes(b" \n")) == 0


def test_columns_come_back_from_planes():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 2**64, 500, np.uint64)), rng.integers(-9, 2**40, 500), rng.integers(0, 9, 500).astype("u1")]
    back = sd.spread(True, sd.squeezed(True, columns), ("<u8", "<i8", "u1"))
    assert all((a == b).all() for a, b in zip(columns, back, strict=True))
