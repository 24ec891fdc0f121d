"""Detection frames: a window of the last frames, and one capture for each held detection.

The batch forms take (stream, ts, frame_no, detected).  A stream is cut into
blocks of ``BLOCK_SECONDS``, each a group of its own, so one busy stream spreads
over the cluster; what a block needs of earlier ones (the last frames, the start
of the run that is open) comes from a table with one row a block.  Frames without
``ts`` come first.  The streaming form keeps the last frames, the open run and the
frames that wait for the watermark as state and gives the same captures.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waybill.schema import FRAME_HITS, FRAME_WINDOW, HOLD_SECONDS

CAPTURES = "stream string, frame_no long, ts timestamp, since timestamp"
STATE = "hits array<boolean>, since long, fired boolean, waiting array<long>, numbers array<long>, seen array<boolean>"  # microseconds; since is -1 while not steady


BLOCK_SECONDS = 600
_FRAME = ("stream", "ts", "frame_no", "detected")
_ORDER = ("ts", "frame_no")


def _block(seconds: int) -> Column:
    return F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(seconds * 1_000_000)), F.lit(-(2**62)))


def _with_blocks(frames: DataFrame, seconds: int) -> DataFrame:
    """Frames with their block and a key of their stream that is never null."""
    return frames.withColumns({"_block": _block(seconds), "_of": F.coalesce(F.concat(F.lit("="), F.col("stream").cast("string")), F.lit(""))})


def _steady(blocked: DataFrame) -> DataFrame:
    """``hits`` and ``steady`` beside each frame; what a block needs of the frames before it comes as one array a block."""
    newest = Window.partitionBy("_of", "_block").orderBy(*[F.col(c).desc_nulls_last() for c in _ORDER])
    ends = blocked.select("_of", "_block", *_ORDER, "detected").withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") < FRAME_WINDOW)
    ends = ends.groupBy("_of", "_block").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, F.col("detected").cast("int").alias("hit")))).alias("_end"))
    # Every block has a frame, so the blocks just before hold the last frames between them.
    before = Window.partitionBy("_of").orderBy("_block").rowsBetween(1 - FRAME_WINDOW, -1)
    last = ends.select("_of", "_block", F.transform(F.flatten(F.collect_list("_end").over(before)), lambda x: x["hit"]).alias("_last"))
    rows = blocked.join(last, ["_of", "_block"])
    inside = Window.partitionBy("_of", "_block").orderBy(*_ORDER)
    rows = rows.withColumns({"_row": F.row_number().over(inside), "_own": F.sum(F.col("detected").cast("int")).over(inside.rowsBetween(1 - FRAME_WINDOW, 0))})
    missing = F.least(F.greatest(F.lit(FRAME_WINDOW) - F.col("_row"), F.lit(0)), F.size("_last"))
    carried = F.aggregate(F.slice("_last", F.size("_last") - missing + 1, missing), F.lit(0), lambda a, x: a + x)
    hits = (F.col("_own") + F.when(missing > 0, carried).otherwise(F.lit(0))).alias("hits")
    rows = rows.select(*blocked.columns, hits)
    return rows.withColumn("steady", F.col("hits") >= FRAME_HITS)


def steady(frames: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``frames`` with ``hits`` among the last frames and whether they are enough."""
    return _steady(_with_blocks(frames, block_seconds)).drop("_block", "_of")


def captures(frames: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The first frame of each steady run that has held long enough: (stream, frame_no, ts, since).

    Frames are shuffled once, by stream and block; the run that is open where a block
    begins (the last frame that was not steady, and since when it is) comes from the
    table of blocks.
    """
    rows = _steady(_with_blocks(frames.select(*_FRAME), block_seconds))
    at = F.struct(*_ORDER)
    # A run is known by the last frame before it that was not steady; null for none.
    inside = Window.partitionBy("_of", "_block").orderBy(*_ORDER)
    rows = rows.withColumn("_broken", F.last(F.when(~F.col("steady"), at), ignorenulls=True).over(inside))
    ends = rows.groupBy("_of", "_block").agg(F.max(F.when(~F.col("steady"), at)).alias("_end"))
    runs = rows.where("steady").groupBy(F.col("_of").alias("_o"), F.col("_block").alias("_b"), "_broken").agg(F.min("ts").alias("_tail_since"))
    tail = (F.col("_of") == F.col("_o")) & (F.col("_block") == F.col("_b")) & F.col("_broken").eqNullSafe(F.col("_end"))
    blocks = ends.join(runs, tail, "left").select("_of", "_block", "_end", "_tail_since")
    earlier = Window.partitionBy("_of").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_before": F.last("_end", ignorenulls=True).over(earlier), "_part": F.sum(F.col("_end").isNotNull().cast("int")).over(Window.partitionBy("_of").orderBy("_block"))})
    same = Window.partitionBy("_of", "_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("_open", F.min("_tail_since").over(same))
    blocks = blocks.select("_of", "_block", "_before", F.lag("_open").over(Window.partitionBy("_of").orderBy("_block")).alias("_open_since"))
    rows = rows.where("steady").join(blocks, ["_of", "_block"])
    run = Window.partitionBy("_of", "_block", "_broken")
    own = F.min("ts").over(run)
    since = F.when(F.col("_broken").isNotNull(), own).otherwise(F.coalesce("_open_since", own))
    rows = rows.withColumn("since", since).withColumn("_run", F.coalesce("_broken", "_before"))
    held = rows.where(F.col("ts") >= F.col("since") + F.expr(f"make_dt_interval(0, 0, 0, {HOLD_SECONDS})"))
    first = held.groupBy("_of", "_run", "since").agg(F.min(at).alias("at"), F.first("stream").alias("stream"))
    return first.select("stream", "at.frame_no", "at.ts", "since")


def _fired(frames: Iterable[tuple[int, int, bool]], hits: list[bool], since: int, fired: bool) -> tuple[list[tuple[int, int, int]], list[bool], int, bool]:
    """(frame_no, at, since) of captures among frames (at, frame_no, detected) in order, and the state after them; times in microseconds."""
    out = []
    for at, frame_no, detected in frames:
        hits = [*hits, detected][-FRAME_WINDOW:]
        if sum(hits) < FRAME_HITS:
            since, fired = -1, False
            continue
        since = at if since < 0 else since
        if not fired and at - since >= HOLD_SECONDS * 1_000_000:
            fired = True
            out.append((frame_no, at, since))
    return out, hits, since, fired


def _step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Frames wait until the watermark has passed them, so that they are taken in order however they come."""
    hits, since, fired, waiting = [], -1, False, []
    if state.exists:
        hits, since, fired, *columns = state.get
        hits, waiting = list(hits), list(zip(*columns, strict=True))
    for batch in batches:
        waiting += zip((int(t.value) // 1000 for t in batch["ts"]), batch["frame_no"].tolist(), batch["detected"].astype(bool).tolist(), strict=True)
    passed = state.getCurrentWatermarkMs() * 1000
    waiting.sort()
    ready = [w for w in waiting if w[0] <= passed]
    waiting = waiting[len(ready) :]
    out, hits, since, fired = _fired(ready, hits, since, fired)
    times, numbers, seen = ([w[i] for w in waiting] for i in range(3))
    state.update((hits, since, fired, times, numbers, seen))
    if waiting:
        state.setTimeoutTimestamp(max(times[0] // 1000, passed // 1000) + 1)
    stamp = lambda us: pd.Timestamp(us, unit="us")
    yield pd.DataFrame([(key[0], n, stamp(at), stamp(start)) for n, at, start in out], columns=["stream", "frame_no", "ts", "since"])


def captures_stream(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The captures of a stream of frames, which may come in any order and up to ``late`` after their time.

    A stream's state is its last frames, the run that is open, and the frames that the
    watermark has not passed; a timer at the first of these takes them up when no
    more come.  Frames without ``ts`` have no place in a stream and are left out, as
    are those that come later than ``late``.
    """
    rows = frames.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", late)
    return rows.groupBy("stream").applyInPandasWithState(_step, CAPTURES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
