"""Sinks of label data: calibration artifacts and training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import tagging
from waybill.operators.calibration import BROADCAST_BUCKETS

# What an artifact says about its samples.
ABOUT = {"correctness_definition": "comparators.compare_field (shared fuzzy comparators)", "dedupe": "latest scan per tracking number", "excluded": "source='dataset' fields; empty ground truth"}


def write_calibration(table: DataFrame, path: str, annotated: int, samples: int, min_n: int) -> None:
    """The bucket table with its metadata as one JSON object, which ``readers.calibration_table`` reads.

    An artifact is one document, so a table of more than ``BROADCAST_BUCKETS`` buckets (counted) is refused;
    it is a table to write as such.
    """
    if table.count() > BROADCAST_BUCKETS:
        raise ValueError("too many buckets for one artifact; write the table as Parquet")
    bucket = F.struct("n", F.col("n_correct").alias("correct"), "accuracy", "p", F.array("lo", "hi").alias("wilson_95"), "usable")
    every = table.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", bucket.alias("bucket"))))).alias("buckets"))
    meta = {"annotated_labels": F.lit(annotated), "samples": F.lit(samples), "min_bucket_n": F.lit(min_n), "fitted_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")}
    meta |= {k: F.lit(v) for k, v in ABOUT.items()}
    named = F.struct(*[v.alias(k) for k, v in sorted(meta.items())])
    every.select(F.to_json(F.struct("buckets", named.alias("metadata"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_training(rows: DataFrame, path: str) -> DataFrame:
    """Tagged examples of (id, text, truth) as JSON lines; (written, skipped), where skipped ones have no token."""
    encoded = tagging.encode(rows)
    usable = F.size("tokens") > 0
    encoded.where(usable).select("id", "tokens", "labels").write.mode("overwrite").json(path)
    return rows.agg(F.count_if(F.size(tagging.tokenize(F.col("text"))) > 0).alias("written"), F.count_if(F.size(tagging.tokenize(F.col("text"))) == 0).alias("skipped"))
