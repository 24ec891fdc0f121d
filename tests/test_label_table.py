"""Stored upserts, versions of the schema, images, and a stream into the store."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from waybill.operators import selection
from waybill.operators.label_table import LabelTable, run_and_store
from waybill.plans import scan
from waybill.streaming import capture_store

AT = dt.datetime(2024, 1, 1)


def labels(spark, ids, city="X", **more):
    rows = [(i, AT, city) for i in ids]
    return spark.createDataFrame(rows, "label_id string, processed_at timestamp, city string").withColumns({c: F.lit(v) for c, v in more.items()})


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = LabelTable(spark, str(tmp_path / "t"), buckets=16)
    assert table.read().count() == 0 and table.annotate(labels(spark, ["a"])) == 0
    assert table.upsert(labels(spark, [f"k{i}" for i in range(200)])) == 200
    table.annotate(spark.createDataFrame([("k3", {"city": "Y", "odd": "z"}), ("k9", {"city": "W"}), ("none", {"city": "Q"})], "label_id string, ground_truth map<string,string>"))
    before = files(table.path)
    assert table.upsert(labels(spark, ["k3", "new", "new"], city="Z")) == 3
    after = files(table.path)
    place = {r.label_id: r.bucket for r in table._parts().where("label_id in ('k3', 'new')").collect()}
    touched = {f"bucket={b}" for b in place.values()}
    changed = {os.path.basename(os.path.dirname(f)) for f in before.items() ^ after.items() for f in [f[0]]}
    assert changed == touched and len(touched) <= 2 and len({os.path.dirname(f) for f in after}) > 10
    rows = {r.label_id: r for r in table.read().collect()}
    assert len(rows) == 201 and rows["k3"].city == rows["new"].city == "Z" and rows["k4"].city == "X"
    assert rows["k3"].ground_truth is None and rows["k9"].ground_truth == {"city": "W"} and "none" not in rows
    assert not os.listdir(f"{table.path}/_aside")
    assert table.upsert(labels(spark, [])) == 0 and files(table.path) == after


def test_parts_of_three_versions_are_read_in_one_scan(spark, tmp_path):
    table = LabelTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(labels(spark, ["a1", "a2"]))
    table.upsert(labels(spark, ["b1"], parser_used="deliver_to"))
    table.upsert(labels(spark, ["c1"], llm_model="small", llm_latency_ms=7))
    rows = {r.label_id: r for r in table.read().collect()}
    assert set(rows) == {"a1", "a2", "b1", "c1"} and rows["b1"].parser_used == "deliver_to" and rows["c1"].llm_latency_ms == 7
    assert rows["a1"].parser_used is None and rows["a1"].candidates is None and rows["b1"].llm_model is None
    plan = table.read().where("city = 'X' and llm_model = 'small'").select("label_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(city,X)" in plan and "EqualTo(llm_model,small)" in plan and "candidates" not in plan


def test_images_are_files_and_their_failures_a_column(spark, tmp_path):
    table = LabelTable(spark, str(tmp_path / "t"), buckets=2)
    rows = labels(spark, ["a", "b", "no/such/folder"]).withColumn("image", F.when(F.col("label_id") != "b", F.encode(F.col("label_id"), "utf-8")))
    assert run_and_store(table, rows, str(tmp_path / "images")) == 3
    got = {r.label_id: r for r in table.read().collect()}
    assert open(got["a"].image_path, "rb").read() == b"a" and got["b"].image_path is None and got["b"].store_error is None
    assert got["no/such/folder"].image_path is None and got["no/such/folder"].store_error
    assert "image" not in table.read().columns and os.listdir(tmp_path / "images") == ["a.jpg"]


TEXT = "SHIP TO\nAnna Stone\n12 OAK ST\nRiverton OH 45001\nUSPS TRACKING #\n9400100000000000000000"


def read(captures):
    return captures.withColumns({"ocr_text": F.lit(TEXT), "ocr_confidence": F.lit(90.0), "barcodes": F.array().cast("array<string>")})


def test_scanned_labels_are_stored_with_their_provenance(spark, tmp_path):
    table = LabelTable(spark, str(tmp_path / "t"), buckets=4)
    texts = read(spark.createDataFrame([("one",)], "label_id string"))
    run_and_store(table, selection.stored(scan.asked(texts), F.lit(AT)))
    r = table.read().first()
    assert (r.label_id, r.city, r.city_source, r.state, r.zip_code, r.llm_called) == ("one", "Riverton", "rule", "OH", "45001", False)
    assert r.selection_reasons["city"] == "rule_default" and [c.source for c in r.candidates["city"]] == ["rule"] and r.tracking_number_confidence > 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = LabelTable(spark, str(tmp_path / "t"), buckets=4)
    source = tmp_path / "in"
    shape = "stream string, frame_no long, ts timestamp, since timestamp"
    spark.createDataFrame([("cam", 7, AT, AT), ("cam", 9, AT, AT)], shape).coalesce(1).write.parquet(str(source))
    captured = spark.readStream.schema(shape).parquet(str(source))

    def run(checkpoint):
        query = capture_store.store_captures(captured, read, table, str(tmp_path / checkpoint))
        query.processAllAvailable()
        query.stop()

    run("c1")
    assert {r.label_id for r in table.read().collect()} == {"cam-7", "cam-9"}
    table.annotate(spark.createDataFrame([("cam-7", {"city": "Troy"})], "label_id string, ground_truth map<string,string>"))
    before = files(table.path)
    run("c2")  # another checkpoint: batch 0 comes again
    assert files(table.path) == before and table.apply_batch(labels(spark, ["x"]), "captures", 0) is False
    assert table.apply_batch(labels(spark, ["x"]), "captures", 50) and table.read().count() == 3


@pytest.mark.parametrize("buckets", [1, 8])
def test_the_latest_of_new_rows_counts(spark, tmp_path, buckets):
    table = LabelTable(spark, str(tmp_path / "t"), buckets=buckets)
    rows = spark.createDataFrame([("a", AT, "old"), ("a", AT + dt.timedelta(days=1), "new"), ("a", None, "none")], "label_id string, processed_at timestamp, city string")
    table.upsert(rows)
    assert [r.city for r in table.read().collect()] == ["new"]
