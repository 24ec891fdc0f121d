"""The defined cases, for every operator and stage: clashing names, nulls, repeats, long texts, empty tables."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waybill.llm import chat_views, fingerprints, mixing, near_dedup, packing, quality_compress, rule_ledger, toxicity, url_filter, warc_zip
from waybill.llm.naming import unused
from waybill.llm.queries import MIX, URL_RULES, domain_of_source
from waybill.llm.workspace import shared_folder

CLASHES = ["_t", "_w", "_l", "_s", "_d", "_key", "key", "_url", "_gone", "gone", "_domain", "domain_", "_lang", "_source", "_label", "label", "node", "budget", "epochs", "cut", "last_take", "salt", "_salt", "row", "rank", "place", "h", "range", "n", "digest", "top", "tokens", "w", "cap"]
TEXTS = [None, "", " \t\n", "one two", "a plain text of some ten words or so, for once", "a plain text of some ten words or so, for once", "é😀 " * 9, "long words " * 95_000]


def clashing(rows):
    return rows.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])


def documents(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], ["src0", "src1", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, TEXTS[4], "en", "src0", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def toxic(rows, spark):
    model = toxicity.train(rows, spark.createDataFrame([(4, 1), (5, 0), (3, 0)], "doc_id long, label int"))
    return toxicity.score(rows, model)


def quality(rows, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, label int")
    return quality_compress.score(rows, quality_compress.train(rows, labels))


KEEP_ROWS = {
    "toxicity": toxic,
    "quality": quality,
    "ledger": lambda rows, spark: rule_ledger.apply_policy(rule_ledger.ledger(rows), rule_ledger.POLICIES["v2"]),
    "urls": lambda rows, spark: url_filter.judge(rows.withColumn("url", F.col("text")), URL_RULES),
    "near": lambda rows, spark: near_dedup.keep_one(rows),
    "mixing": lambda rows, spark: mixing.select_documents(rows, domain_of_source(), MIX),
}


@pytest.mark.parametrize("name", KEEP_ROWS)
def test_operators_keep_all_columns_of_their_rows(spark, name):
    rows = clashing(documents(spark))
    out = KEEP_ROWS[name](rows, spark)
    assert set(rows.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert all(r[c] == f"mine {c}" for r in got for c in CLASHES)
    if name not in ("near", "mixing"):
        assert len(got) == rows.count()
    if name == "near":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, x) for x in (0, 1, 2, 3, 4, 4, 4, 6, 7)] + [(True, 0)] * 2
    assert KEEP_ROWS[name](rows.limit(0), spark).count() == 0


def test_operators_with_rows_of_their_own(spark):
    rows = clashing(documents(spark))
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(rows, path).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.start == 0 for r in packed) == rows.count()
    assert all(len(fingerprints.compare_with_next(rows, ranges=r).collect()) == rows.count() for r in (2, 8))
    pages = rows.withColumns({"page_id": F.col("doc_id"), "url": F.col("lang"), "html": F.col("text")})
    packages = warc_zip.write_packages(pages, shared_folder(spark, "t"), max_records=3)
    assert warc_zip.read_packages(packages).count() == rows.count()
    turns = rows.withColumns({"conv_id": F.col("doc_id"), "turn": F.col("n_chars"), "role": F.col("lang")})
    views = chat_views.perspectives(turns).collect()
    assert len(views) == turns.select("conv_id", "turn", "role", "text").distinct().count() + 2  # two speakers and turns in the null conversation, one in the others
    for made in (packing.pack_documents(rows.limit(0), path), fingerprints.compare_with_next(rows.limit(0)), chat_views.perspectives(turns.limit(0))):
        assert made.count() == 0


def test_archives_are_read_in_as_many_tasks_as_their_bytes_need(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.sha2(F.concat(F.col("id"), k), 512))).alias("html"))
    packages = warc_zip.write_packages(pages.repartition(1), shared_folder(spark, "t"))
    span = 2**18
    total = packages.agg(F.sum("size")).first()[0]
    tasks = warc_zip.reading_tasks(packages, span)
    assert packages.count() == 1 and tasks == min(-(-total // span), 3 * spark.sparkContext.defaultParallelism) > 4
    read = warc_zip.read_packages(packages, span=span)
    counts = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert read.rdd.getNumPartitions() == tasks and sum(r["count"] for r in counts) == 400
    assert len(counts) > tasks / 3 and max(r["count"] for r in counts) < 200


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, sf_dir, name):
    stage, rows = dict(corpus_pipeline.STAGES)[name], clashing(documents(spark))
    assert (stage.__doc__ or "").count(" ") > 5
    for docs in (rows, rows.limit(0)):
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = out.collect()
        assert got or docs is not rows or name == "mixing"
        ids = {r.doc_id for r in rows.select("doc_id").collect()}
        assert {r.doc_id for r in got} <= ids and (docs is rows or not got)


def test_unused_names_differ_in_any_case(spark):
    rows = spark.createDataFrame([(1, 2)], "Key int, _key int")
    assert unused(rows, "key", "key", "other") == ["__key", "___key", "other"]
