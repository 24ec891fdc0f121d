"""Accuracy of stored values against annotations.

Two frames: labels, one wide row for each scan, and samples, one row for each
scan and field with (label_id, field, source, confidence, correct).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import comparators as C
from waybill.functions.text import staged

# Lower ends of the confidence bands.
BANDS = (0.9, 0.7, 0.5, 0.0)


def latest(labels: DataFrame, key: str = "tracking_number", at: str = "processed_at", tie: str = "label_id") -> DataFrame:
    """The newest row of each parcel; rows without a number all stay.

    The two kinds are separate branches, so that the ranked one keeps only a
    group's first row before it is shuffled.
    """
    known = F.coalesce(F.col(key), F.lit("")) != ""
    order = Window.partitionBy(key).orderBy(F.desc(at), F.asc(tie))
    ranked = labels.where(known).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return ranked.unionByName(labels.where(~known))


def training_labels(labels: DataFrame, at: str = "processed_at") -> DataFrame:
    """The newest annotated label of each number; one without a number is known by its own id, as another label's number may be."""
    known = F.coalesce(F.nullif(F.col("tracking_number"), F.lit("")), F.col("label_id").cast("string"))
    order = Window.partitionBy("_known").orderBy(F.desc(at), F.asc("label_id"))
    rows = labels.where(F.col("ground_truth").isNotNull()).withColumn("_known", known)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_known")


def dedupe_count(labels: DataFrame, key: str = "tracking_number") -> DataFrame:
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return labels.agg(F.count("*").alias("n_rows"), (F.countDistinct(F.when(~blank, F.col(key))) + F.count_if(blank)).alias("n_latest"))


def fields_of(labels: DataFrame) -> DataFrame:
    """A row for each annotated field: (label_id, tracking_number, field, value, source, confidence, truth)."""
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"{f}_source").alias("source"), F.col(f"{f}_confidence").alias("confidence"))
    rows = labels.where(F.col("ground_truth").isNotNull()).select("label_id", "tracking_number", "ground_truth", F.explode(F.array(*[one(f) for f in S.FIELDS])).alias("x"))
    rows = rows.where(F.map_contains_key("ground_truth", F.col("x.field")))
    return rows.select("label_id", "tracking_number", "x.*", F.element_at("ground_truth", F.col("x.field")).alias("truth"))


def samples(labels: DataFrame) -> DataFrame:
    """Scorable fields that were not imported, with ``correct`` and ``strict``."""
    rows = fields_of(labels).where(F.coalesce("source", F.lit("")) != "dataset").where(C.scorable(F.col("field"), F.col("truth")))
    return rows.withColumn("correct", C.same(F.col("field"), F.col("value"), F.col("truth"))).withColumn("strict", C.same_strict(F.col("value"), F.col("truth")))


def exclusions(labels: DataFrame) -> DataFrame:
    """Imported values left out, over how many labels; counted before the scorable test."""
    rows = fields_of(labels)
    imported, own = F.col("source") == "dataset", F.coalesce("source", F.lit("")) != "dataset"
    return rows.agg(F.count_if(imported).alias("excluded_values"), F.countDistinct(F.when(imported, F.col("label_id"))).alias("excluded_labels"), F.count_if(own & ~C.scorable(F.col("field"), F.col("truth"))).alias("unscorable"))


def _measures() -> list[Column]:
    n, right = F.count("*"), F.count_if("correct")
    return [n.alias("n"), right.alias("n_correct"), F.round(F.try_divide(right, n), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("avg_confidence")]


def field_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field").agg(*_measures())


def with_overall(rows: DataFrame) -> DataFrame:
    """Field accuracies and their total."""
    return rows.rollup("field").agg(*_measures()).withColumn("field", F.coalesce("field", F.lit("OVERALL")))


def source_accuracy(rows: DataFrame) -> DataFrame:
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(source.alias("source")).agg(*_measures())


def band_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy in each confidence band, the empty ones too; a missing or negative confidence is in none."""
    band = reduce(lambda out, lo: out.when(F.col("confidence") >= lo, F.lit(lo)), BANDS, F.when(F.lit(False), F.lit(0.0)))
    found = rows.where("confidence >= 0").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    every = rows.sparkSession.createDataFrame([(lo,) for lo in BANDS], "band double")
    return every.join(found, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("correct"))


def staleness(labels: DataFrame, fitted: int) -> DataFrame:
    """Whether the annotations have outgrown the table that was fitted on ``fitted`` of them."""
    now = dedupe_count(labels).select(F.col("n_latest").alias("annotated"))
    return now.withColumn("fitted", F.lit(fitted).cast("long")).withColumn("stale", F.col("annotated") > F.lit(fitted) * F.lit(S.STALE_FACTOR))


def regressions(rows: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """Pass rates in per cent beside the floor that each field must hold."""
    floors = floors or S.RATCHET
    rates = rows.groupBy("field").agg((F.try_divide(F.count_if("correct") * F.lit(100.0).cast("double"), F.count("*"))).alias("rate"))
    table = rows.sparkSession.createDataFrame(list(floors.items()), "field string, floor double")
    joined = table.join(rates, "field", "left").withColumn("rate", F.round(F.coalesce("rate", F.lit(0.0)), 1))
    return joined.withColumn("regressed", F.col("rate") < F.col("floor"))


def _coverage(found: DataFrame, scorable: DataFrame, keys: list[str]) -> DataFrame:
    out = found.join(scorable, keys)
    return out.withColumn("coverage", F.round(F.try_divide("n", "scorable"), 6)).withColumn("accuracy", F.round(F.try_divide("n_correct", "n"), 6))


def candidate_accuracy(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """By source and field: how often a source proposes, is right, and beats what was selected.

    ``candidates`` has (label_id, field, source, value, correct), ``rows`` the samples.
    """
    chosen = rows.select("label_id", "field", F.col("correct").alias("selected_correct"))
    scorable = rows.groupBy("field").agg(F.count("*").alias("scorable"))
    joined = candidates.where("value <> ''").join(chosen, ["label_id", "field"])
    found = joined.groupBy("source", "field").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("correct") & ~F.col("selected_correct")).alias("beat_selected"))
    return _coverage(found, scorable, ["field"])


def accuracy_by_version(candidates: DataFrame, rows: DataFrame, source: str = "ner") -> DataFrame:
    """The same for one source by model version, the least of a scan's reasons; coverage is over that version's scans."""
    own = candidates.where(F.col("source") == source)
    versions = own.groupBy("label_id").agg(F.min(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(source))).alias("version"))
    return _by_version(own, rows.join(versions, "label_id"))


def _by_version(own: DataFrame, scans: DataFrame) -> DataFrame:
    """Coverage and accuracy of candidates by the version of their scan and field."""
    scorable = scans.groupBy("version", "field").agg(F.count("*").alias("scorable"))
    chosen = scans.select("label_id", "field", "version", F.col("correct").alias("selected_correct"))
    joined = own.where("value <> ''").join(chosen, ["label_id", "field"])
    found = joined.groupBy("version", "field").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("correct") & ~F.col("selected_correct")).alias("beat_selected"))
    return _coverage(found, scorable, ["version", "field"])


def with_provenance(labels: DataFrame) -> DataFrame:
    """Annotated labels whose scan recorded its candidates."""
    return labels.where((F.size("candidates") > 0) & (F.size("ground_truth") > 0))


def judged(field: str, value: Column, source: Column, truth: Column) -> Column:
    """(field, truth, correct) of one field of an annotated label, or null where it was imported or cannot be judged."""
    known = truth.isNotNull() & (F.coalesce(source, F.lit("")) != "dataset") & C.scorable(F.lit(field), truth)
    return F.when(known, F.struct(F.lit(field).alias("field"), truth.alias("truth"), C.same(F.lit(field), value, truth).alias("correct")))


def newest(labels: DataFrame, key: str = "tracking_number", at: str = "processed_at", tie: str = "label_id") -> DataFrame:
    """The rows of ``latest`` from one scan, for labels that are dear to make; those without a number are dealt by their own id."""
    known = F.coalesce(F.col(key), F.lit("")) != ""
    order = Window.partitionBy(key, F.when(~known, F.col(tie))).orderBy(F.desc(at), F.asc(tie))
    return labels.withColumn("_rank", F.row_number().over(order)).where(~known | (F.col("_rank") == 1)).drop("_rank")


def _with_verdicts(labels: DataFrame, columns: Sequence[str], source: str | None = None) -> DataFrame:
    """The newest annotated labels that stored candidates: (label_id, own, each, version).

    ``own`` has the fields that can be judged, ``each`` the columns of their candidates and
    whether the selected value was right.  All is found inside the row, before the newest are
    chosen, so that verdicts are shuffled instead of texts and the labels are read once.
    """
    rows = labels.where(F.col("ground_truth").isNotNull())
    if dict(labels.dtypes)["candidates"] == "string":
        rows = staged(rows, {"candidates": F.from_json("candidates", f"map<string,array<{S.CANDIDATE.simpleString()}>>")})
    recorded = (F.size("candidates") > 0) & (F.size("ground_truth") > 0)
    own = F.filter(F.array(*[judged(f, F.col(f), F.col(f"{f}_source"), F.element_at("ground_truth", F.lit(f))) for f in S.FIELDS]), lambda x: x.isNotNull())
    rows = staged(rows, {"own": F.when(recorded, own)})

    def of(o: Column, c: Column) -> Column:
        value = F.coalesce(c["value"], F.lit(""))
        named = {
            "field": o["field"], "source": F.coalesce(c["source"], F.lit("?")), "value": value, "confidence": c["confidence"], "reason": c["reason"], "proposed": value != "",
            "correct": C.same(o["field"], value, o["truth"]), "selected": o["correct"],
        }
        return F.struct(*[named[n].alias(n) for n in columns])

    taken = lambda c: F.lit(True) if source is None else F.coalesce(c["source"], F.lit("?")) == source
    listed = lambda o: F.filter(F.coalesce(F.element_at("candidates", o["field"]), F.array()), taken)
    reasons = F.transform(F.filter(F.flatten(F.filter(F.map_values("candidates"), lambda x: x.isNotNull())), lambda c: c["source"] == source), lambda c: F.coalesce(F.nullif(c["reason"], F.lit("")), F.lit(source)))
    rows = staged(rows, {
        "each": F.flatten(F.transform("own", lambda o: F.transform(listed(o), lambda c: of(o, c)))), "version": F.lit(None).cast("string") if source is None else F.when(F.col("own").isNotNull(), F.array_min(reasons)),
        "fields": F.transform("own", lambda o: o["field"]),
    })
    return newest(rows.select("label_id", "tracking_number", "processed_at", "fields", "each", "version")).where(F.col("fields").isNotNull())


def stored_candidates(labels: DataFrame) -> DataFrame:
    """(label_id, field, source, value, confidence, reason, correct) of every candidate that annotated labels have stored.

    ``candidates`` is the stored map, or its JSON text.  Of each parcel the newest scan
    counts, of those the ones that recorded candidates, and of these the fields that
    can be judged and were not imported.
    """
    return _with_verdicts(labels, ("field", "source", "value", "confidence", "reason", "correct")).select("label_id", F.inline("each"))


def provenance_of(labels: DataFrame) -> DataFrame:
    """The newest annotated label of each parcel with its candidates as a map; those that stored none are left out."""
    rows = newest(labels.where(F.col("ground_truth").isNotNull()))
    if dict(labels.dtypes)["candidates"] == "string":
        rows = staged(rows, {"candidates": F.from_json("candidates", f"map<string,array<{S.CANDIDATE.simpleString()}>>")})
    return with_provenance(rows)


def _counted(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Coverage and accuracy from verdicts: one aggregate over a row for each judged field and each of its proposals."""
    of_field = F.transform("fields", lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("boolean").alias("proposed"), F.lit(None).cast("boolean").alias("correct"), F.lit(None).cast("boolean").alias("selected")))
    each = rows.select("version", F.inline(F.concat(of_field, F.filter("each", lambda c: c["proposed"]))))
    own, of_keys = F.col("proposed").isNull(), Window.partitionBy(*keys)
    counts = each.groupBy("source", *keys).agg(F.count_if(own).alias("scorable"), F.count_if(~own).alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("correct") & ~F.col("selected")).alias("beat_selected"))
    found = counts.withColumn("scorable", F.sum("scorable").over(of_keys)).where("n > 0").select(*by, "n", "n_correct", "beat_selected", "scorable")
    return found.withColumn("coverage", F.round(F.try_divide("n", "scorable"), 6)).withColumn("accuracy", F.round(F.try_divide("n_correct", "n"), 6))


def stored_candidate_accuracy(labels: DataFrame) -> DataFrame:
    """``candidate_accuracy`` of what labels have stored."""
    return _counted(_with_verdicts(labels, ("field", "source", "proposed", "correct", "selected")), ["field"], ["source", "field"])


def stored_accuracy_by_version(labels: DataFrame, source: str = "ner") -> DataFrame:
    """``accuracy_by_version`` of what labels have stored; a scan's version follows from all its candidates, scorable or not."""
    rows = _with_verdicts(labels, ("field", "source", "proposed", "correct", "selected"), source).where(F.col("version").isNotNull())
    return _counted(rows, ["version", "field"], ["version", "field"])


def fixture_rates(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """(field, total, passed, rate) of fixtures that have an image, against what a scan extracted from it.

    ``expected`` has the fixtures' fields, ``image_path`` (or null); ``extracted`` the fields by ``image_path``.
    A field without a truth is not counted; one without a single truth has the rate 0.
    """
    found = extracted.select("image_path", *[F.col(f).alias(f"_{f}") for f in S.FIELDS])
    rows = expected.where(F.col("image_path").isNotNull()).join(found, "image_path", "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("truth"), F.coalesce(f"_{f}", F.lit("")).alias("value")) for f in S.FIELDS]))
    judged = rows.select(each.alias("x")).select("x.*").withColumn("scorable", C.scorable(F.col("field"), F.coalesce("truth", F.lit(""))))
    passed = F.col("scorable") & C.same(F.col("field"), F.col("value"), F.col("truth"))
    out = judged.groupBy("field").agg(F.count_if("scorable").alias("total"), F.count_if(passed).alias("passed"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("total")), F.lit(0.0)))
