"""Quality: a compression classifier on two zstandard dictionaries.

Method.  One dictionary is built from blocks of good labelled texts and one from
blocks of bad ones.  A text is cut into blocks of ``block`` bytes; every block is
compressed with either dictionary, and the sizes are summed.  Blocks are short, so
that what they repeat of themselves does not outweigh the dictionaries, however
long the text.  The measure is
``(bad size - good size) / size of the text``: above 0 the text is better
explained by good texts, and near 0 if neither helps, as with texts that repeat
themselves.  A logistic curve fitted on labelled texts that the dictionaries have
not seen turns it into a probability.  Dictionaries are trained on all blocks of
the sampled texts; where these are fewer than ``few_bytes`` together, too few to
train on, they are the dictionary as they are.

Scale.  Dictionaries and curve come from bounded samples: ``max_docs`` labelled
texts a class and half, the smallest seeded hashes.  Dictionaries are trained on
the driver, which holds one class's sampled texts at a time.  Scoring is a map
over whole texts, without a shuffle.

Defined cases.  A null text counts as empty; an empty text has the measure 0.
Very long texts are read whole, in blocks.  Repeated rows are scored each; an
empty table gives an empty result.  If the training rows lack a class, every
score is the smoothed share of good ones.  Extra columns are kept; those named
``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.labelled import smallest, with_texts


@dataclass(frozen=True)
class QualityParams:
    block: int = 128
    dictionary: int = 400_000
    level: int = 3
    few_bytes: int = 131_072
    max_docs: int = 2_000
    seed: int = 23


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    slope: float
    bias: float
    params: QualityParams

    def measure(self, texts: pd.Series) -> np.ndarray:
        bad, good = (_compressor(x, self.params.level) for x in (self.bad, self.good))
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            parts = blocks(text, self.params.block)
            b, g = (sum(len(c.compress(p)) for p in parts) for c in (bad, good))
            out[i] = (b - g) / max(1, sum(map(len, parts)))
        return out

    def scores(self, texts: pd.Series) -> np.ndarray:
        if not self.slope:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.measure(texts) + self.bias, -500, 500)))


@functools.lru_cache(4)
def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """One compressor for each dictionary and worker; its tables are built once."""
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False)


def blocks(text: str | None, size: int) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


def build_dictionary(samples: list[bytes], params: QualityParams) -> bytes:
    """A trained dictionary; with too few samples to train on, their raw bytes."""
    if sum(map(len, samples)) < params.few_bytes:
        return b"".join(samples).ljust(8, b"\0")
    return zstandard.train_dictionary(params.dictionary, samples).as_bytes()


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by damped Newton steps with a weak prior."""
    scale = float(x.std()) or 1.0
    w = np.array([1.0, 0.0])
    rows = np.column_stack([x / scale, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -500, 500)))
        gradient = rows.T @ (p - y) + 1e-2 * w
        w = w - np.linalg.solve((rows.T * (p * (1 - p) + 1e-9)) @ rows + 1e-2 * np.eye(2), gradient).clip(-2, 2)
    return max(float(w[0]) / scale, 1e-9), float(w[1])


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on the documents of ``labels``, unique (doc_id, label) rows; a seeded half makes the dictionaries, the other the curve."""
    halved = labels.withColumn("half", F.pmod(F.xxhash64(F.lit(params.seed + 1), "doc_id"), F.lit(2)))
    sizes = {(r["label"], r["half"]): r["n"] for r in halved.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    good, n = sum(v for k, v in sizes.items() if k[0]), sum(sizes.values())
    share = (good + 0.5) / (n + 1.0)
    flat = QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))), params)
    if not all(sizes.get((label, half)) for label in (0, 1) for half in (0, 1)):
        return flat

    def sample(label: int, half: int) -> DataFrame:
        own = halved.where((F.col("label") == label) & (F.col("half") == half)).select("doc_id", "label")
        return with_texts(docs, smallest(own, params.max_docs, params.seed), params.max_docs)

    def dictionary(label: int) -> bytes:
        texts = sorted(r["text"] or "" for r in sample(label, 0).select("text").collect())
        return build_dictionary([part for text in texts for part in blocks(text, params.block)], params)

    bad, good = dictionary(0), dictionary(1)
    shared = docs.sparkSession.sparkContext.broadcast(QualityModel(bad, good, 1.0, 0.0, params))

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.measure(texts))

    pairs = sample(0, 1).unionByName(sample(1, 1)).select("label", measured("text").alias("x")).toPandas()
    if pairs["label"].nunique() < 2:
        return flat
    n0, n1 = sizes[0, 1], sizes[1, 1]
    slope, bias = fit_curve(pairs["x"].to_numpy(np.float64), pairs["label"].to_numpy(np.float64))
    shown = min(n1, params.max_docs) / min(n0, params.max_docs)
    return QualityModel(bad, good, slope, bias + float(np.log((n1 / n0) / shown)), params)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    scored = docs.drop("score", "predicted").withColumn("score", probability("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
