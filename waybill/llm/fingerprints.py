"""Document fingerprints: threshold-scaled sketches.

Method.  A text's shingles are the runs of ``shingle`` code points that end at each
of its code points, with blanks of their own kind before the first, so a text has
as many as code points, however short.  Each is hashed to 32 bits, and every hash
below a fixed fraction of the range is kept, so a sketch grows with its text; if
those are fewer than ``least``, the ``least`` smallest are kept, or all there are.
The bound below which a sketch is whole follows from the sketch.  Two sketches are
compared and merged below the lower of their bounds, whatever the texts' lengths:
the share of one sketch found in another estimates containment, the shared part of
their union the Jaccard likeness.  At the defaults the fraction rules all but texts of
some 250 code points or fewer; between texts of under ``least`` code points both
estimates are exact.  A fingerprint is the sketch as base64 text of its sorted
little-endian 32-bit hashes.

Scale.  Sketching is a map over whole texts.  Pairing each document with the
next one by descending doc_id takes one shuffle of the texts: ids are dealt into
``ranges`` ranges at quantiles of the ids, and an id or null that many rows have
into several by a hash of the text; each range is ordered by itself (and spills if
it must), and only the first row of each range is copied to the range before.  In
one place stand ids and hashes of these rows, never texts.

Defined cases.  Null text counts as empty and has an empty sketch; two empty
sketches have likeness 1, an empty and another one 0.  Very long texts are read
whole.  Rows that repeat a doc_id are ordered by a hash of the text, then text, and each
has the following row as its next.  A null doc_id comes last.  A table of one row has
itself as the next document.  Extra columns are left out.  An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.workspace import checkpointed

_PRIME = 0x100000001B3
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
PAIRED = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass(frozen=True)
class SketchParams:
    """Code points of a shingle, one in how many hashes is kept, and the hashes kept of a short text."""

    shingle: int = 5
    one_in: int = 16
    least: int = 16

    @property
    def bound(self) -> int:
        return 2**32 // self.one_in


DEFAULT = SketchParams()


def _cut(hashes: np.ndarray, params: SketchParams) -> np.ndarray:
    """The sorted hashes that a sketch keeps of all."""
    kept = np.unique(hashes[hashes < params.bound])
    return kept if len(kept) >= params.least else np.unique(hashes)[: params.least]


@functools.lru_cache(8)
def sketch(text: str, params: SketchParams = DEFAULT) -> np.ndarray:
    """Sorted kept hashes of a text's shingles."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    padded = np.concatenate([np.zeros(params.shingle - 1, np.uint64), points])
    rolled = np.zeros(len(points), np.uint64)
    for i in range(params.shingle):
        rolled = rolled * np.uint64(_PRIME) + padded[i : i + len(points)]
    mixed = (rolled ^ (rolled >> np.uint64(29))) * _SPREAD
    return _cut(((mixed ^ (mixed >> np.uint64(32))) * _SPREAD >> np.uint64(32)).astype(np.uint32), params)


def bound(kept: np.ndarray, params: SketchParams = DEFAULT) -> int:
    """The largest hash up to which a sketch has all hashes of its text."""
    return 2**32 - 1 if len(kept) < params.least else max(params.bound - 1, int(kept[-1]))


def _comparable(a: np.ndarray, b: np.ndarray, params: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    both = min(bound(a, params), bound(b, params))
    return a[: np.searchsorted(a, both, side="right")], b[: np.searchsorted(b, both, side="right")]


def pack(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def merge(a: np.ndarray, b: np.ndarray, params: SketchParams = DEFAULT) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return _cut(np.union1d(*_comparable(a, b, params)), params)


def containment(a: np.ndarray, b: np.ndarray, params: SketchParams = DEFAULT) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty sketch is contained in any.

    NaN if ``a`` is too short to have a hash below ``b``'s bound.
    """
    if not len(a):
        return 1.0
    a, b = _comparable(a, b, params)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float("nan")


def likeness(a: np.ndarray, b: np.ndarray, params: SketchParams = DEFAULT) -> float:
    """Estimated Jaccard likeness; 1 for two empty sketches."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _comparable(a, b, params)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first code points of ``following``, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint(docs: DataFrame, params: SketchParams = DEFAULT) -> DataFrame:
    """``docs`` with ``fingerprint``."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(sketch(t or "", params)) for t in texts], dtype=object)

    return docs.drop("fingerprint").withColumn("fingerprint", made("text"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending doc_id, after the last the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = ranges or max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    bounds, repeats = np.unique(np.array(found["c"] or [], np.int64), return_counts=True)
    nulls = 1 + n * (found["n"] - found["known"]) // max(1, found["n"])

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Ascending with (doc_id, hash): an id at several quantiles has as many ranges, by hash."""
        known, x = ids.notna().to_numpy(), ids.fillna("0").astype("int64").to_numpy()  # as text: floats would round
        at = np.searchsorted(bounds, x, side="left")
        inside = np.minimum(at, max(len(bounds) - 1, 0))
        hot = known & (at < len(bounds)) & (bounds[inside] == x) if len(bounds) else np.zeros(len(x), bool)
        parts = np.where(hot, repeats[inside] if len(bounds) else 1, np.where(known, 1, nulls))
        share = (hashes.to_numpy(np.int64) >> 32) + 2**31  # 0 to 2**32 - 1
        return pd.Series((np.where(known, at, -1) << 32) + hot + parts * share // 2**32)

    dealt = rows.withColumn("range", range_of(F.col("doc_id").cast("string"), "h")).withColumn("copied", F.lit(False))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    firsts = checkpointed(dealt.groupBy("range").agg(F.max(place).alias("top")))  # at most 2 * n + 1 rows
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    after = firsts.select("range", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("top"), F.coalesce(F.lead("range").over(down), F.first("range").over(down)).alias("of"))
    tops = dealt.join(F.broadcast(firsts.select(F.col("range").alias("of"), "top.*").toDF("of", "known", "top_id", "top_h")), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")))
    texts = tops.groupBy("of").agg(F.max("text").alias("text"))
    copies = texts.join(F.broadcast(after), "of").select("top.doc_id", "text", "top.h", "range", F.lit(True).alias("copied"))
    order = Window.partitionBy("range").orderBy("copied", F.col("doc_id").desc_nulls_last(), F.desc("h"), F.desc("text"))
    paired = dealt.unionByName(copies).withColumn("next_text", F.lead("text").over(order))
    return paired.where(~F.col("copied")).select("doc_id", "text", "next_text")


def compare_with_next(docs: DataFrame, ranges: int | None = None, params: SketchParams = DEFAULT) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, following in zip(batch["doc_id"], batch["text"], batch["next_text"], strict=True):
                changed = edited(text, following)
                own, other = sketch(text, params), sketch(changed, params)
                out.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), pack(own), pack(other), likeness(own, other, params), likeness(own, sketch(following, params), params)))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    # Ids travel as text: pandas turns whole numbers beside nulls into floats.
    paired = with_next(docs, ranges).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(compared, PAIRED)
    return paired.withColumn("doc_id", F.col("doc_id").cast("long"))
