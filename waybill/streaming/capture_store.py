"""The camera's loop: captures of a stream are read, scanned without a language model, and stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waybill.operators import selection
from waybill.operators.label_table import LabelTable
from waybill.plans import scan

Reader = Callable[[DataFrame], DataFrame]


def capture_rows(captures: DataFrame, read: Reader, seams: scan.Seams = scan.Seams(), policy: str = "off") -> DataFrame:
    """Stored labels of captures (stream, frame_no, ts): ``read`` adds ocr_text, ocr_confidence, barcodes and maybe image.

    The key is the stream and the frame, so a capture that comes again is the same label.
    """
    keyed = captures.withColumn("label_id", F.concat_ws("-", F.coalesce("stream", F.lit("")), F.col("frame_no").cast("string")))
    rows = scan.asked(read(keyed), seams, policy).withColumn("llm_requested_mode", F.lit(policy))
    return selection.stored(rows, F.col("ts").cast("timestamp"))


def store_captures(captures: DataFrame, read: Reader, table: LabelTable, checkpoint: str, name: str = "captures", images: str | None = None) -> StreamingQuery:
    """Start storing a stream of captures; each batch is applied once, also if it is replayed after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        table.apply_batch(capture_rows(batch, read), name, number, images)

    return captures.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name).start()
