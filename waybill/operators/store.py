"""The stored labels: reading, upserts, annotations, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.schema import FIELDS


def by_id(labels: DataFrame, key: object) -> DataFrame:
    return labels.where(F.col("label_id") == key)


def annotated(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("ground_truth").isNotNull()).orderBy(F.desc("processed_at"), "label_id")


def recent(labels: DataFrame, limit: int = 50) -> DataFrame:
    """The newest labels, with whether they are annotated."""
    shown = [c for c in ("label_id", "processed_at", "original_filename", "carrier", "tracking_number", "recipient_name") if c in labels.columns]
    return labels.select(*shown, F.col("ground_truth").isNotNull().alias("has_ground_truth")).orderBy(F.desc("processed_at"), "label_id").limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str = "label_id") -> DataFrame:
    """New rows replace old ones of their key; a replaced row loses its annotation and columns it lacks.

    The old rows meet only the keys of the new ones.  Of new rows with one key the
    latest counts, and of those the one with the greatest values in column order.
    """
    fresh = new.withColumn("ground_truth", F.lit(None).cast(old.schema["ground_truth"].dataType)) if "ground_truth" in old.columns else new
    plain = [F.to_json(F.struct(F.col(c))).desc() for c in new.columns]
    ranked = fresh.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("processed_at"), *plain)))
    last = ranked.where("_rank = 1").drop("_rank")
    kept = old.join(new.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def annotate(labels: DataFrame, updates: DataFrame, key: str = "label_id") -> DataFrame:
    """Annotations of ``updates`` (key, ground_truth) replace those of existing labels, known fields alone."""
    kept = updates.select(F.col(key).alias("_key"), F.map_filter("ground_truth", lambda k, v: k.isin(*FIELDS)).alias("_truth"))
    joined = labels.join(kept, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("ground_truth", F.when(F.col("_key").isNotNull(), F.col("_truth")).otherwise(F.col("ground_truth"))).drop("_key", "_truth")


def not_stored(fixtures: DataFrame, labels: DataFrame, order: str, key: str = "tracking_number") -> DataFrame:
    """Fixtures to import: those without a number, and the first of each number that is not stored yet."""
    known = F.coalesce(F.col(key), F.lit("")) != ""
    stored = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    fresh = fixtures.where(known).join(stored, F.col(key) == F.col("_key"), "left_anti")
    first = fresh.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rank = 1").drop("_rank")
    return first.unionByName(fixtures.where(~known))


def import_counts(fixtures: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """(imported, skipped) of ``not_stored``."""
    taken, every = not_stored(fixtures, labels, order).agg(F.count("*").alias("imported")), fixtures.agg(F.count("*").alias("n"))
    return taken.join(every).select("imported", (F.col("n") - F.col("imported")).alias("skipped"))


def dataset_rows(fixtures: DataFrame) -> DataFrame:
    """Stored labels of fixtures (label_id, original_filename, ocr_text, ocr_confidence, ocr_rotations, ground_truth): what was expected is what is stored."""
    value = lambda f: F.coalesce(F.element_at("ground_truth", F.lit(f)), F.lit(""))
    out = fixtures.select("label_id", F.current_timestamp().alias("processed_at"), "original_filename", "ocr_text", "ocr_confidence", "ocr_rotations", "ground_truth")
    out = out.withColumns({c: v for f in FIELDS for c, v in ((f, value(f)), (f"{f}_confidence", F.lit(1.0)), (f"{f}_source", F.lit("dataset")))})
    truth = F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*[F.col(f) for f in FIELDS]))
    return out.withColumns({"llm_called": F.lit(False), "processing_ms": F.lit(0).cast("long"), "ground_truth": truth})


def import_problems(images: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(no_json, errors): images without a fixture, and fixtures of images that are no JSON (``broken``)."""
    keys = ["folder", "stem"]
    known = fixtures.groupBy(*keys).agg(F.max("broken").alias("broken"))
    joined = images.select(*keys, "path").join(known, keys, "left")
    return joined.agg(F.count_if(F.col("broken").isNull()).alias("no_json"), F.count_if("broken").alias("errors"))
