"""Captures of streams whose frames come out of order."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from waybill.streaming import debounce

SHAPE = "stream string, ts timestamp, frame_no long, detected boolean"


def frames_of(seed):
    rng, rows, no = random.Random(seed), [], 0
    for stream in ("a", "b", None):
        at = dt.datetime(2024, 5, 1)
        for _ in range(120):
            no += 1
            at += dt.timedelta(milliseconds=rng.randrange(1, 700))
            rows.append((stream, at, no, rng.random() < 0.45))
    return rows


def test_shuffled_frames_give_the_captures_of_the_batch(spark, tmp_path):
    rows = frames_of(4)
    want = {(r.stream, r.frame_no, r.ts, r.since) for r in debounce.captures(spark.createDataFrame(rows, SHAPE)).collect()}
    assert len(want) > 5
    # Frames come in batches, each a mix of some seconds, in no order; the last batch only moves time on.
    rng = random.Random(1)
    by_arrival = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.uniform(0, 8))))
    source, parts = str(tmp_path / "in"), 9
    os.makedirs(source)
    step = -(-len(by_arrival) // parts)
    batches = [by_arrival[i : i + step] for i in range(0, len(by_arrival), step)]
    for batch in batches:
        rng.shuffle(batch)
    batches.append([("clock", dt.datetime(2024, 5, 2), 10_000, False), ("a", None, 10_001, True)])
    schema = spark.createDataFrame([], SHAPE).schema
    found = debounce.captures_stream(spark.readStream.schema(schema).parquet(source), late="20 seconds")
    query = None
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(source)
        query = query or found.writeStream.format("memory").queryName("shuffled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        query.processAllAvailable()
        assert k < len(batches)
    query.processAllAvailable()
    got = [(r.stream, r.frame_no, r.ts, r.since) for r in spark.table("shuffled").collect()]
    query.stop()
    assert set(got) == want and len(got) == len(want)


def test_captures_of_one_hot_stream_over_many_blocks(spark):
    """One stream with all frames: hits and runs go across every block border."""
    rows = spark.range(6000).select(F.lit("hot").alias("stream"), (F.timestamp_seconds(F.lit(1_700_000_000)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 0.4)).alias("ts"), F.col("id").alias("frame_no"), (F.floor(F.col("id") / 37) % 3 != 0).alias("detected"))
    whole = {(r.frame_no, r.since) for r in debounce.captures(rows, 10**6).collect()}
    assert len(whole) == 6000 // 111 + 1 or len(whole) > 50
    assert {(r.frame_no, r.since) for r in debounce.captures(rows, 3).collect()} == whole
