"""Readers of label data: fixtures, JSON lines, calibration tables, images, and text choices of a scanner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill import schema as S

FIXTURE = ", ".join(f"{f} string" for f in S.FIELDS) + ", parser_used string, parser_matches array<string>"
BUCKETS = "metadata struct<min_bucket_n:bigint,samples:bigint>, buckets map<string,struct<n:bigint,correct:bigint,accuracy:double,p:double,wilson_95:array<double>,usable:boolean>>"


def fixtures(spark: SparkSession, glob: str) -> DataFrame:
    """Expected results, one JSON object a file, with carrier folder and stem of the path; ``broken`` where a file is no JSON."""
    read = spark.read.schema(f"{FIXTURE}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    rows = read.json(glob).withColumn("path", F.input_file_name())
    rows = rows.withColumn("broken", F.col("_corrupt").isNotNull() & F.coalesce(*S.FIELDS).isNull()).drop("_corrupt")
    return rows.withColumns({"folder": F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1), "stem": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)})


def images(spark: SparkSession, glob: str) -> DataFrame:
    """Image files with their bytes, folder, stem and extension."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.withColumns({"folder": F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1), "stem": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "extension": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})


def with_image(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Fixtures with the path of their image: jpg before jpeg before png, or null."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("jpg", "jpeg", "png")]), F.col("extension"))
    best = found.where(rank > 0).groupBy("folder", "stem").agg(F.min_by("path", rank).alias("image_path"))
    return expected.join(best, ["folder", "stem"], "left")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def calibration_table(spark: SparkSession, path: str) -> DataFrame:
    """The buckets of a calibration artifact, as ``operators.calibration.fit`` gives them; none without a file."""
    shape = "key string, field string, source string, sig string, level int, n long, p double"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(BUCKETS).option("multiLine", True).json(path).select(F.explode("buckets").alias("key", "b"))
    parts = F.split("key", r"\|")
    n = F.size(parts)
    return rows.select("key", F.when(n > 1, F.get(parts, 0)).alias("field"), F.when(n > 1, F.get(parts, 1)).otherwise(F.get(parts, 0)).alias("source"), F.when(n > 2, F.get(parts, 2)).otherwise("").alias("sig"), (3 - n).alias("level"), F.col("b.n").alias("n"), F.col("b.p").alias("p"))


def best_rotation(rotations: DataFrame) -> DataFrame:
    """One text for each label from (label_id, rot_no, text, conf, score).

    Rotations are tried in order; each strictly better one is taken, and the first
    taken one that is good enough ends the search.  Without any, the text is empty.
    """
    order = Window.partitionBy("label_id").orderBy("rot_no")
    before = F.coalesce(F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rows = rotations.withColumn("taken", F.col("score") > F.greatest(before, F.lit(-1)))
    ends = F.col("taken") & (F.col("conf") >= S.OCR_EXIT_CONFIDENCE) & (F.col("score") >= S.OCR_EXIT_SCORE)
    rows = rows.withColumn("over", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("over = 0")
    best = F.max_by(F.struct("text", "conf"), F.when(F.col("taken"), F.col("rot_no")))
    out = rows.groupBy("label_id").agg(best.alias("b"), F.count("*").alias("tried"))
    return out.select("label_id", F.coalesce("b.text", F.lit("")).alias("ocr_text"), F.coalesce("b.conf", F.lit(0.0)).alias("ocr_confidence"), "tried")
