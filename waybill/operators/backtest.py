"""Backtests of a model against selected values, and of the gate that would let it win."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.selection import ner_gate

# The fewest rows that are split, and the thresholds of the sweep.
SPLIT_MIN = 25
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def held_out(rows: DataFrame, ids: DataFrame, key: str = "label_id") -> tuple[DataFrame, DataFrame]:
    """The rows of the ids that can be used, and (found, missing) counts."""
    joined = ids.select(key).distinct().join(rows, key, "left")
    usable = F.col("ground_truth").isNotNull() & F.col("ocr_text").isNotNull()
    return joined.where(usable), joined.agg(F.count_if(usable).alias("found"), F.count_if(~usable).alias("missing"))


def split(rows: DataFrame, key: str = "label_id", least: int = SPLIT_MIN) -> DataFrame:
    """``rows`` with ``test``: a fifth by hash, the same in every run; of fewer than ``least`` rows all are for training."""
    few = rows.limit(least).count() < least
    return rows.withColumn("test", F.lit(False) if few else F.pmod(F.xxhash64(key), F.lit(5)) == 0)


def head_to_head(rows: DataFrame) -> DataFrame:
    """By field over (field, source, ner_value, ner_correct, correct): coverage and both accuracies, the latter also without imported rows."""
    scan, covered = F.coalesce("source", F.lit("")) != "dataset", F.coalesce("ner_value", F.lit("")) != ""
    return rows.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(covered).alias("covered"), F.count_if("ner_correct").alias("ner_correct"), F.count_if(scan).alias("n_scans"),
        F.count_if(scan & F.col("ner_correct")).alias("ner_correct_scans"), F.count_if(scan & F.col("correct")).alias("selected_correct_scans"),
    )


def by_base_source(rows: DataFrame) -> DataFrame:
    covered = F.coalesce("ner_value", F.lit("")) != ""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("?"))
    return rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(covered).alias("covered"), F.count_if(covered & F.col("ner_correct")).alias("ner_correct"))


def sweep(names: DataFrame) -> DataFrame:
    """For each override threshold: fills, overrides, wins, losses and the policy's accuracy, over name rows
    (value, source, correct, ner_value, ner_confidence, ner_correct).

    Every row meets the ten thresholds, a fixed number, inside its own task.
    """
    each = names.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in THRESHOLDS])))
    gate = ner_gate(F.col("ner_value"), F.col("value"), F.col("source"), F.col("ner_confidence"), F.col("threshold"))
    rows = each.withColumn("gate", gate)
    result = F.when(F.col("gate").isNotNull(), F.col("ner_correct")).otherwise(F.col("correct"))
    over = F.col("gate") == "override"
    return rows.groupBy("threshold").agg(
        F.count_if(F.col("gate") == "fill").alias("fills"), F.count_if(over).alias("overrides"), F.count_if(over & F.col("ner_correct") & ~F.col("correct")).alias("wins"),
        F.count_if(over & ~F.col("ner_correct") & F.col("correct")).alias("losses"), F.count_if(result).alias("policy_correct"), F.count("*").alias("n"),
    )
