"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Method.  Every text is lower-cased, white space becomes single blanks, and its
distinct character n-grams (``sizes``) are hashed into ``2**bits`` buckets.
Spark counts, per bucket, in how many training texts of either class it occurs;
the smoothed log ratio of those counts is the bucket's naive Bayes ratio ``r``.
Every bucket whose ratio is ``min_z`` standard errors or more from 0 becomes a
feature with the value ``r``, and a ridge-penalised logistic regression is fitted
on them.  The score is the fitted probability of label 1.

Scale.  Both steps of training see one bounded sample (``max_fit_docs`` labelled
documents, the smallest seeded hashes), whose ids go to the tasks that read the
texts.  The counts are sums over at most ``2**bits`` keys, and the driver holds
for each of at most ``max_fit_docs`` documents the numbers of its features, as
32-bit integers in Arrow memory.  The model is one ``2**bits`` table of floats
(4 MB) that goes to the tasks, and scoring is a map without a shuffle.

Defined cases.  A null text counts as empty.  An empty text, or one without any
known feature, gets the model's prior.  Very long texts are read whole.
Repeated rows are scored each; an empty table gives an empty result.  With one
class or no class in the training rows the score is the smoothed share of
label 1.  Extra columns are kept; a clash with an output column is resolved in
favour of the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.labelled import smallest, with_texts
from waybill.llm.workspace import checkpointed

_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityParams:
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    min_z: float = 3.5
    max_fit_docs: int = 10_000
    ridge: float = 0.1
    steps: int = 500
    seed: int = 17


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    params: ToxicityParams

    def scores(self, texts: pd.Series) -> np.ndarray:
        """Probability of label 1 for each text."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found = np.unique(np.concatenate([g[self.weights[g] != 0] for g in grams(text, self.params)]))
            out[i] = self.bias + float(self.weights[found].sum(dtype=np.float64))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def grams(text: str | None, params: ToxicityParams) -> list[np.ndarray]:
    """Bucket numbers of a text's n-grams, an array for each size, with repeats."""
    clean = " " + " ".join((text or "").lower().split()) + " "
    points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out, rolled = [], points
    for size in range(2, max(params.sizes) + 1):
        if len(points) < size:
            break
        rolled = rolled[:-1] * _PRIME + points[size - 1 :]
        if size in params.sizes:
            out.append(((rolled * _SPREAD) >> np.uint64(64 - params.bits)).astype(np.int32))
    return out or [np.empty(0, np.int32)]


def _count(batches: Iterator[pd.DataFrame], params: ToxicityParams) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 2**params.bits), np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            counts[label, np.unique(np.concatenate(grams(text, params)))] += 1
    found = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": found, "n1": counts[1, found], "n0": counts[0, found]})


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_cols: int, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse entries, by Nesterov's accelerated gradient."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w, b = np.zeros(n_cols), float(np.log(share / (1 - share)))
    if len(values) == 0:
        return w, b
    rate = 4.0 / (np.bincount(rows, values**2).max() + 1.0 + 4 * ridge / len(y))
    vw, vb = w.copy(), b
    for step in range(steps):
        z = np.bincount(rows, values * vw[cols], minlength=len(y)) + vb
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y
        nw = vw - rate * (np.bincount(cols, values * error[rows], minlength=n_cols) + ridge * vw) / len(y)
        nb = vb - rate * float(error.mean())
        pull = step / (step + 3)
        vw, vb, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on the documents of ``labels``, unique (doc_id, label) rows with labels 0 and 1."""
    ids = checkpointed(smallest(labels, params.max_fit_docs, params.seed))
    rows = with_texts(docs, ids, params.max_fit_docs)
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    empty = np.zeros(2**params.bits, np.float32)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1.0)
        return ToxicityModel(empty, float(np.log(share / (1 - share))), params)

    counted = rows.select("text", "label").mapInPandas(lambda b: _count(b, params), "bucket long, n1 long, n0 long")
    counts = counted.groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    ratio = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    z = F.col("r") / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    chosen = (
        counts.withColumn("r", ratio)
        .where(F.abs(z) >= params.min_z)
        .select("bucket", "r")
        .toPandas()
        .sort_values("bucket")
    )
    buckets, r = chosen["bucket"].to_numpy(np.int64), chosen["r"].to_numpy(np.float64)
    slot = np.full(2**params.bits, -1, np.int32)
    slot[buckets] = np.arange(len(buckets), dtype=np.int32)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(s[s >= 0]) for s in (slot[np.concatenate(grams(t, params))] for t in batch["text"])]
            yield pd.DataFrame({"label": batch["label"], "slots": found})

    fitted = rows.select("text", "label").mapInPandas(features, "label int, slots array<int>").toArrow().combine_chunks()
    slots, y = fitted["slots"].combine_chunks(), fitted["label"].to_numpy().astype(np.float64)
    ends, cols = slots.offsets.to_numpy(), slots.values.to_numpy()
    w, b = fit_logistic(np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends)), cols, r[cols], y, len(r), params.ridge, params.steps)
    weights = empty.copy()
    weights[buckets] = (w * r).astype(np.float32)
    return ToxicityModel(weights, b, params)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    scored = docs.drop("score", "predicted").withColumn("score", probability("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
