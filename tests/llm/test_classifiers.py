"""Toxicity and compression quality: held-out accuracy, and the defined cases."""

import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from waybill.llm import quality_compress, toxicity
from waybill.llm.labelled import known_labels

SCHEMA = "doc_id long, text string, extra string, score string"


def corpus(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = [f"word{(i * 7 + k) % 50}" for k in range(30)]
        rows.append((i, " ".join(words + (["rotten", "idiot"] if bad else ["kind"])), "x", "clash"))
        labels.append((i, int(bad), int(not bad)))
    rows += [(1000, None, "x", "c"), (1001, "", "x", "c"), (1002, "rotten idiot " * 20_000, "x", "c"), (1003, "kind", "x", "c"), (1003, "kind", "x", "c")]
    labels += [(5, None, None), (7, 0, 1), (7, 0, 1), (None, 1, 1), (9999, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_finds_held_out_words(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, known_labels(labels, "toxic", F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))))
    out = toxicity.score(docs, model, 0.7)
    assert out.columns.count("score") == 1 and "extra" in out.columns
    held = out.where("doc_id < 240 and doc_id % 3 = 1").select("doc_id", "predicted").collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    rest = {r.doc_id: r for r in out.where("doc_id >= 1000").collect()}
    assert rest[1000].score == rest[1001].score and 0 <= rest[1000].score < 0.7
    assert rest[1002].predicted == 1 and rest[1003].predicted == 0
    assert out.count() == 245


def test_quality_separates_held_out_styles(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 2 == 0
        text = " ".join(f"%%{(i * 13 + k * 7) % 97}$$&&" if bad else f"plain sentence number {(i * 11 + k) % 89} goes on." for k in range(40))
        rows.append((i, text, "x", "c"))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame([*rows, (1000, None, "x", "c"), (1001, "", "x", "c"), (1002, " ".join(f"%%{k * 31 % 97}$$&&" for k in range(30_000)), "x", "c")], SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_compress.train(docs, known_labels(labels, "quality", F.col("doc_id") % 5 != 0))
    out = quality_compress.score(docs, model, 0.3)
    held = out.where("doc_id < 400 and doc_id % 5 = 0").select("doc_id", "predicted").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    rest = {r.doc_id: r for r in out.where("doc_id >= 1000").collect()}
    assert rest[1000].score == rest[1001].score and rest[1002].predicted == 0


def test_quality_scores_equal_plain_zstandard(spark):
    """Dictionaries and scores rebuilt from the labelled texts, without the operator's own functions."""
    params = quality_compress.QualityParams(few_bytes=20_000, dictionary=4_000)
    texts = {i: " ".join(f"{'bad' if i % 3 == 0 else 'fine'}{(i * 7 + k * k) % 61} é" for k in range(10 + i % 90)) for i in range(300)} | {300: "", 301: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(250)], "doc_id long, label int")
    model = quality_compress.train(docs, labels, params)
    halves = {r.doc_id: r.half for r in labels.select("doc_id", F.pmod(F.xxhash64(F.lit(params.seed + 1), "doc_id"), F.lit(2)).alias("half")).collect()}
    cut = lambda t: [raw[i : i + params.block] for raw in [(t or "").encode()] for i in range(0, len(raw), params.block)] or [b""]
    compressors = []
    for label, built in ((0, model.bad), (1, model.good)):
        samples = [part for t in sorted(texts[i] for i in range(250) if int(i % 3 != 0) == label and halves[i] == 0) for part in cut(t)]
        total = sum(map(len, samples))
        assert built == (b"".join(samples) if total < params.few_bytes else zstandard.train_dictionary(params.dictionary, samples).as_bytes())
        compressors.append(zstandard.ZstdCompressor(level=params.level, dict_data=zstandard.ZstdCompressionDict(built), write_content_size=False, write_dict_id=False))
    assert len(model.bad) != len(model.good)
    for r in quality_compress.score(docs, model, 0.3).collect():
        bad, good = (sum(len(c.compress(part)) for part in cut(texts[r.doc_id])) for c in compressors)
        x = (bad - good) / max(1, len((texts[r.doc_id] or "").encode()))
        want = 1 / (1 + math.exp(-(model.slope * x + model.bias)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_toxicity_scores_equal_a_plain_model(spark):
    """Counts, ratios and chosen features by dictionaries of plain n-grams; weights only where a feature is."""
    params = toxicity.ToxicityParams(sizes=(4, 5), min_z=2.0, steps=5_000)
    words = ["alpha", "beta", "gamma", "delta", "vile", "nasty"]
    texts = {i: " ".join(words[(i * k + k) % (6 if i % 4 == 0 else 4)] for k in range(1, 12)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, label int")
    model = toxicity.train(docs, labels, params)
    plain = lambda t: {t2[k : k + n] for t2 in [f" {t} "] for n in params.sizes for k in range(len(t2) - n + 1)}

    def hashed(gram):
        value = 0
        for c in gram:
            value = (value * 0x100000001B3 + ord(c)) % 2**64
        return ((value * 0x9E3779B97F4A7C15) % 2**64) >> (64 - params.bits)

    counts = {0: Counter(), 1: Counter()}
    for i in range(100):
        counts[int(i % 4 == 0)].update({hashed(g) for g in plain(texts[i])})
    n1, n0, chosen = 25, 75, {}
    for b in counts[0] | counts[1]:
        a, c = counts[1][b] + 0.5, counts[0][b] + 0.5
        ratio = math.log(a / (n1 + 1)) - math.log(c / (n0 + 1))
        if abs(ratio) / math.sqrt(1 / a + 1 / c) >= params.min_z:
            chosen[b] = ratio
    assert set(np.flatnonzero(model.weights)) <= set(chosen) and len(chosen) > 10
    used = [b for b in chosen if model.weights[b] != 0]
    assert len(used) > 0.9 * len(chosen)
    # The fitted weights are at the least of the penalised loss: its slope is near 0 in every feature.
    rows = [sorted({hashed(g) for g in plain(texts[i])} & set(chosen)) for i in range(100)]
    fitted = {b: model.weights[b] / chosen[b] for b in chosen}
    error = [1 / (1 + math.exp(-(model.bias + sum(model.weights[b] for b in row)))) - int(i % 4 == 0) for i, row in enumerate(rows)]
    for b in chosen:
        slope = sum(e * chosen[b] for e, row in zip(error, rows, strict=True) if b in row) + params.ridge * fitted[b]
        assert abs(slope) < 0.2
    for r in toxicity.score(docs, model, 0.7).collect():
        z = model.bias + sum(float(model.weights[b]) for b in {hashed(g) for g in plain(texts[r.doc_id])})
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6


@pytest.mark.parametrize("module", [toxicity, quality_compress])
def test_without_a_class_or_rows(spark, module):
    docs, labels = corpus(spark)
    model = module.train(docs, known_labels(labels, "toxic", F.lit(False)))
    scores = {r.score for r in module.score(docs, model).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert module.score(docs.limit(0), model).count() == 0


def test_repeated_labels_count_once(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, known_labels(labels, "toxic", F.lit(True)).collect())) == [(1, 1), (2, 0)]
