"""Fields, closed vocabularies, thresholds and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of fields, carriers, policies, modes and tags.
FIELDS = ("recipient_name", "street_address", "city", "state", "zip_code", "tracking_number", "carrier")
SCORED = FIELDS[:-1]
CARRIERS = ("SpeedX", "Amazon", "YunExpress", "UniUni", "TikTok", "USPS", "UPS", "FEDEX", "Unknown")
POLICIES = ("off", "auto", "force_vision")
LLM_MODES = ("none", "text", "vision", "vision_fallback")
TAGS = ("O", "B-NAME", "I-NAME", "B-STREET", "I-STREET", "B-CITY", "I-CITY", "B-STATE", "B-ZIP", "B-TRACKING", "I-TRACKING", "B-CARRIER")
TAG_OF = {"recipient_name": "NAME", "street_address": "STREET", "city": "CITY", "state": "STATE", "zip_code": "ZIP", "tracking_number": "TRACKING", "carrier": "CARRIER"}
LONG_TAGS = ("NAME", "STREET", "CITY", "TRACKING")

# Confidences and thresholds of the extraction policy.
TRACKING_MIN_LENGTH, TRACKING_HIGH, TRACKING_LOW = 15, 0.95, 0.40
NAME_HIGH, NAME_LOW = 0.85, 0.45
STREET_HIGH, STREET_LOW = 0.70, 0.45
CITY_HIGH, CITY_LOW = 0.85, 0.45
STATE_VALID, ZIP_VALID, CHECKSUM_FAILED = 0.95, 0.78, 0.30
LLM_IN_TEXT, LLM_NOT_IN_TEXT = 0.85, 0.75
OCR_CONFIDENCE_MIN, OCR_TEXT_MIN, BLANK_FIELDS_MIN = 60.0, 50, 3
OCR_EXIT_CONFIDENCE, OCR_EXIT_SCORE = 75.0, 12
NER_FILL, NER_OVERRIDE = 0.50, 0.80
MIN_BUCKET_N, STALE_FACTOR, WARN_BELOW_N = 25, 1.25, 5
FRAME_WINDOW, FRAME_HITS, HOLD_SECONDS = 10, 3, 2.0
# Accuracy in per cent below which a field has regressed.
RATCHET = {"recipient_name": 54.2, "street_address": 78.3, "city": 80.8, "state": 84.6, "zip_code": 80.8, "tracking_number": 73.1, "carrier": 100.0}

CANDIDATE = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("value", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("validations", T.MapType(T.StringType(), T.StringType())), T.StructField("reason", T.StringType()),
])


def labels_schema() -> T.StructType:
    """The stored label: one wide row for each scan.  The names of its columns are fixed values."""
    text, real, whole = T.StringType(), T.DoubleType(), T.LongType()
    fields = [("id", text), ("processed_at", T.TimestampType()), ("original_filename", text), ("image_path", text), ("ocr_text", text), ("ocr_confidence", real), ("ocr_rotations", whole), ("barcode_raw", text)]
    for name in FIELDS:
        fields += [(name, text), (f"{name}_confidence", real), (f"{name}_source", text)]
    fields += [
        ("llm_called", T.BooleanType()), ("processing_ms", whole), ("ground_truth", T.MapType(text, text)), ("corrections", text), ("parser_used", text),
        ("selection_reasons", T.MapType(text, text)), ("candidates", T.MapType(text, T.ArrayType(CANDIDATE))),
        ("llm_requested_mode", text), ("llm_model", text), ("llm_latency_ms", whole), ("llm_trigger_reasons", T.ArrayType(text)),
    ]
    return T.StructType([T.StructField(n, t, n not in ("id", "processed_at")) for n, t in fields])


def labels_schema_without_id() -> T.StructType:
    """The stored columns but the key, which tables name and type themselves."""
    return T.StructType([f for f in labels_schema() if f.name != "id"])


def evolve(rows: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """``rows`` with every column of the schema that they lack, as nulls; extra columns stay."""
    schema = schema or labels_schema()
    empty = rows.sparkSession.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
    return empty.unionByName(rows, allowMissingColumns=True)
