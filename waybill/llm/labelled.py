"""Bounded samples of labelled documents, taken without moving texts.

The sample is drawn from the label rows alone: the smallest seeded hashes of
doc_id.  It holds at most the stated number of (doc_id, label) pairs, and is sent
to every task if that number is at most ``BROADCAST_IDS``; texts then stay where
they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000


def known_labels(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(doc_id, label) of the usable rows with a label 0 or 1; of repeated ones the largest label counts."""
    rows = labels.where(usable & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.where("label in (0, 1)")


def smallest(labels: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` of the rows, by seeded hash."""
    return labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def with_texts(docs: DataFrame, sample: DataFrame, most: int) -> DataFrame:
    """The rows of a sample of at most ``most`` with their texts."""
    return docs.select("doc_id", "text").join(F.broadcast(sample) if most <= BROADCAST_IDS else sample, "doc_id")
