"""Confidence calibration: bucket tables, hierarchical lookup, calibration error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import tracking as T
from waybill.functions.scoring import comparable
from waybill.functions.text import let, staged
from waybill.operators.evaluation import judged, newest
from waybill.schema import FIELDS, MIN_BUCKET_N

KEYS = ["field", "source", "sig"]
#: A bucket table of more rows than this is joined by a shuffle.
BROADCAST_BUCKETS = 100_000


def signature(validations: Column) -> Column:
    """Sorted ``name=True`` or ``name=False`` of those validations that are booleans."""
    real = F.map_filter(F.coalesce(validations, F.create_map().cast("map<string,string>")), lambda k, v: v.isin("true", "false"))
    return F.array_join(F.array_sort(F.transform(F.map_entries(real), lambda e: F.concat(e["key"], F.lit("="), F.initcap(e["value"])))), ",")


def recomputed_validations(field: Column, source: Column, label: dict[str, Column]) -> Column:
    """Validations that follow from the stored columns: the number's check digit, and whether the text has a model's value.

    ``label`` has ``value``, ``tracking_number``, ``carrier`` and ``ocr_text``, and where it is known ``comparable``, the text in comparable form.
    """
    none = F.create_map().cast("map<string,string>")
    flag = lambda name, test: let(test, lambda t: F.when(t.isNotNull(), F.create_map(F.lit(name), t.cast("string"))).otherwise(none))
    check = F.when(field == "tracking_number", T.checksum(F.coalesce(label["tracking_number"], F.lit("")), F.coalesce(label["carrier"], F.lit(""))))
    text = label["comparable"] if "comparable" in label else comparable(label["ocr_text"])
    found = let(F.struct(comparable(label["value"]).alias("v"), text.alias("t")), lambda x: F.when((x["v"] != "") & (F.coalesce(label["ocr_text"], F.lit("")) != ""), F.contains(x["t"], x["v"])))
    return F.map_concat(flag("checksum_valid", check), flag("found_in_ocr", F.when(source == "llm", found)))


def samples_of(labels: DataFrame) -> DataFrame:
    """Calibration samples (label_id, field, source, sig, correct, confidence) of the newest annotated label of each parcel.

    They are made inside the row, before the newest are chosen: the labels are read once, and their texts are not shuffled.
    """
    rows = staged(labels.where(F.col("ground_truth").isNotNull()), {"_text": comparable(F.col("ocr_text"))})

    def one(f: str) -> Column:
        source = F.coalesce(f"{f}_source", F.lit(""))
        label = {"value": F.col(f), "tracking_number": F.col("tracking_number"), "carrier": F.col("carrier"), "ocr_text": F.col("ocr_text"), "comparable": F.col("_text")}
        sig = signature(recomputed_validations(F.lit(f), source, label))
        verdict = judged(f, F.col(f), F.col(f"{f}_source"), F.element_at("ground_truth", F.lit(f)))
        made = lambda j: F.struct(j["field"].alias("field"), F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")).alias("source"), sig.alias("sig"), j["correct"].alias("correct"), F.col(f"{f}_confidence").alias("confidence"))
        return let(verdict, lambda j: F.when(j.isNotNull(), made(j)))

    rows = staged(rows, {"_samples": F.filter(F.array(*[one(f) for f in FIELDS]), lambda x: x.isNotNull())})
    return newest(rows.select("label_id", "tracking_number", "processed_at", "_samples")).select("label_id", F.inline("_samples"))


def report(table: DataFrame) -> DataFrame:
    """The buckets in the order of a report: those of a field first, by key, then those of a source alone."""
    return table.orderBy(F.instr("key", "|") == 0, "key")


def wilson(right: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share, within 0 and 1; the whole range without observations."""
    p, nn = F.try_divide(right, n), n.cast("double")
    spread = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), nn) + F.try_divide(F.lit(z * z / 4), nn * nn))
    mid, scale = p + F.try_divide(F.lit(z * z / 2), nn), 1 + F.try_divide(F.lit(z * z), nn)
    lo, hi = (mid - spread) / scale, (mid + spread) / scale
    return F.coalesce(F.greatest(lo, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(hi, F.lit(1.0)), F.lit(1.0))


def fit(samples: DataFrame, min_n: int = MIN_BUCKET_N) -> DataFrame:
    """Buckets of (field, source, signature), (field, source) and source in one pass.

    Level 0 leaves out empty signatures, so a plain key is counted once.
    """
    sets = [[F.col("field"), F.col("source"), F.col("sig")], [F.col("field"), F.col("source")], [F.col("source")]]
    grouped = samples.groupingSets(sets, F.col("field"), F.col("source"), F.col("sig"))
    counted = grouped.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg("confidence"), 6).alias("legacy_avg"))
    level = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2)
    out = counted.withColumn("level", level).drop("g").where("level > 0 or sig <> ''")
    lo, hi = wilson(F.col("n_correct"), F.col("n"))
    return out.select(
        F.concat_ws("|", *KEYS).alias("key"), *KEYS, "level", "n", "n_correct", F.round(F.col("n_correct") / F.col("n"), 4).alias("accuracy"),
        F.round((F.col("n_correct") + 1) / (F.col("n") + 2), 4).alias("p"), F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"), (F.col("n") >= min_n).alias("usable"), "legacy_avg",
    )


def lookup(rows: DataFrame, table: DataFrame, min_n: int = MIN_BUCKET_N) -> DataFrame:
    """``rows`` with ``p`` and ``bucket`` of the finest usable bucket, or nulls.

    A table of few buckets (counted) goes to every task; a larger one is joined by its keys.
    """
    usable = table.where(F.col("n") >= min_n).select(*KEYS, "level", "p", "key").persist()  # counted and joined three times, fitted once
    small = usable.count() <= BROADCAST_BUCKETS
    out = rows
    for level, keys in ((0, KEYS), (1, KEYS[:2]), (2, KEYS[1:2])):
        side = usable.where(F.col("level") == level).select(*keys, F.col("p").alias(f"_p{level}"), F.col("key").alias(f"_k{level}"))
        out = out.join(F.broadcast(side) if small else side, keys, "left")
    out = out.withColumn("_p0", F.when(F.col("sig") != "", F.col("_p0"))).withColumn("_k0", F.when(F.col("sig") != "", F.col("_k0")))
    return out.withColumn("p", F.coalesce("_p0", "_p1", "_p2")).withColumn("bucket", F.coalesce("_k0", "_k1", "_k2")).drop(*[f"_{c}{i}" for c in "pk" for i in range(3)])


def calibrated(rows: DataFrame, table: DataFrame, min_n: int = MIN_BUCKET_N) -> DataFrame:
    """``rows`` with ``calibrated``, the bucket's probability or else the confidence itself."""
    return lookup(rows, table, min_n).withColumn("calibrated", F.coalesce("p", "confidence"))


def calibration_error(rows: DataFrame, prediction: str, bins: int = 10) -> DataFrame:
    """(ece, n): mean gap of accuracy and prediction over equal bins, weighted by their rows."""
    known = rows.where(F.col(prediction).isNotNull())
    binned = known.groupBy(F.least(F.floor(F.col(prediction) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("acc"), F.avg(prediction).alias("conf"))
    return binned.agg(F.round(F.try_divide(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))), F.sum("n")), 6).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def confidence_model(mode: str, rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``confidence`` as it is (``legacy``) or calibrated."""
    if mode == "legacy":
        return rows
    if mode != "calibrated" or table is None:
        raise ValueError(f"unknown confidence mode {mode!r}, or no table")
    return calibrated(rows, table).withColumn("confidence", F.col("calibrated")).drop("calibrated", "p", "bucket")
