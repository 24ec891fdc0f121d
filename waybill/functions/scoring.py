"""Confidences, warnings and triggers of the rule extraction, and the quality of scanned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.lines import SUFFIX
from waybill.functions.text import bounded, full, has, let, letters_of, lines, squeeze, strip, visible_of

# What a label's text is expected to say, and its weight.
MARKERS = (
    (r"USPS\s+DELIVER\s+TO", 3), (r"DELIVER\s+TO", 7), (r"SHIP\s+TO", 5), ("SHIP", 2), (None, 4), (r"USPS\s+TRACKING", 5), (r"UPS\s+TRACKING", 5), ("TRACKING", 3), ("USPS", 2),
    ("UPS", 2), ("FEDEX", 2), (r"PRIORITY\s+MAIL", 2), (r"PARCEL\s+SELECT", 2), ("GROUND", 1), ("POSTAGE", 1), ("UNIUNI", 1),
)
# Forms of state, ZIP code, place and box on a label, and their weight.
TO_LINE = r"(?:\A|\n)\s*TO\s*:"
LAYOUT = ((bounded(r"[A-Z]{2}\s+\d{5}(?:[-–— ]?\d{4})?"), 5), (r"(?:\A|\n)\s*[A-Z][A-Z .'-]+,?\s+[A-Z]{2}\s+\d{5}", 3), (bounded(r"\d{5}[-–— ]\d{4}"), 2))
PLACE = bounded(rf"{SUFFIX}|BUILDING|BLDG|CENTER|HUB")
BOX = bounded(r"P\.?\s*O\.?\s+BOX\s+\d+")
UPSIDE_DOWN = "S4LVIS|G3LINN|CIVD|3DVLSOD|NNGWNN|ONIYOVYL|SDNS"


def comparable(value: Column) -> Column:
    """Upper case words without punctuation, for agreement and containment."""
    return squeeze(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""))


def confidences(row: dict[str, Column]) -> dict[str, Column]:
    """Confidence of each scored field by its form, and ``overall``; ``row`` has the six values."""
    value = {f: F.coalesce(row[f], F.lit("")) for f in S.SCORED}
    by_form = lambda f, good, high, low: F.when(value[f] == "", 0.0).when(good, high).otherwise(low).cast("double")
    out = {
        "recipient_name": by_form("recipient_name", full(value["recipient_name"], r"[A-Za-z][A-Za-z .'-]+"), S.NAME_HIGH, S.NAME_LOW),
        "street_address": by_form("street_address", has(value["street_address"], r"\d"), S.STREET_HIGH, S.STREET_LOW),
        "city": by_form("city", full(value["city"], r"[A-Za-z .'-]+"), S.CITY_HIGH, S.CITY_LOW),
        "state": F.when(full(value["state"], "[A-Z]{2}"), S.STATE_VALID).otherwise(0.0).cast("double"),
        "zip_code": F.when(full(value["zip_code"], r"\d{5}(-\d{4})?"), S.ZIP_VALID).otherwise(0.0).cast("double"),
        "tracking_number": by_form("tracking_number", F.length(value["tracking_number"]) >= S.TRACKING_MIN_LENGTH, S.TRACKING_HIGH, S.TRACKING_LOW),
    }
    total = out["recipient_name"]
    for f in S.SCORED[1:]:
        total = total + out[f]
    return out | {"overall": F.round(total / 6, 2)}


def _present(*tests: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(test, name) for test, name in tests]), lambda x: x.isNotNull())


# The names of warnings, triggers and modes in the functions below.
def warnings(row: dict[str, Column], checksum: Column) -> Column:
    c = confidences(row)
    value = {f: F.coalesce(row[f], F.lit("")) for f in S.SCORED}
    missing = lambda f: value[f] == ""
    return _present(
        ((c["tracking_number"] == S.TRACKING_LOW), "tracking_number_short"), (missing("tracking_number"), "tracking_number_missing"),
        (c["recipient_name"] == S.NAME_LOW, "recipient_name_low_confidence"), (missing("recipient_name"), "recipient_name_missing"),
        (c["street_address"] == S.STREET_LOW, "street_address_missing_number"), (missing("street_address"), "street_address_missing"),
        (c["city"] == S.CITY_LOW, "city_low_confidence"), (missing("city"), "city_missing"),
        (c["state"] == 0, "state_missing_or_invalid"), (c["zip_code"] == 0, "zip_code_missing_or_invalid"), (F.coalesce(~checksum, F.lit(False)), "tracking_checksum_failed"),
    )


def penalised(confidence: Column, checksum: Column) -> Column:
    """Tracking confidence after a failed check digit; ``overall`` is left alone."""
    return F.when(checksum == F.lit(False), S.CHECKSUM_FAILED).otherwise(confidence)


def triggers(row: dict[str, Column], ocr_confidence: Column, ocr_text: Column, rejected: Column, flags: dict[str, Column]) -> Column:
    """Reasons to look at the image itself, in a fixed order."""
    c = confidences(row)
    blanks = sum(((F.coalesce(row[f], F.lit("")) == "") | (c[f] == 0)).cast("int") for f in ("city", "state", "street_address", "zip_code"))
    return _present(
        (ocr_confidence < S.OCR_CONFIDENCE_MIN, "ocr_confidence_low"), (F.length(strip(ocr_text)) < S.OCR_TEXT_MIN, "ocr_text_short"),
        (blanks >= S.BLANK_FIELDS_MIN, "blank_address_fields"), (rejected, "street_rejected"), *[(flag, name) for name, flag in flags.items()],
    )


def llm_mode(policy: Column, reasons: Column, street: Column, llm_street: Column, enabled: Column | None = None, rejected: Column | None = None) -> Column:
    """How a label's language model was asked: not at all, about the text, about the image, or about both; a model that is not there is not asked again."""
    no_street = (F.coalesce(street, F.lit("")) == "") | F.coalesce(rejected if rejected is not None else F.lit(False), F.lit(False))
    answered = enabled if enabled is not None else F.lit(True)
    return (
        F.when(policy == "off", "none")
        .when((policy == "force_vision") | (F.size(reasons) > 0), "vision")
        .when(answered & no_street & (F.coalesce(llm_street, F.lit("")) == ""), "vision_fallback")
        .otherwise("text")
    )


def found_in_text(value: Column, ocr_text: Column, enabled: Column) -> Column:
    """Confidence of a model's value by whether the text has it; null when the model was not asked."""
    return F.when(enabled, let(comparable(value), lambda v: in_text(v, comparable(ocr_text)))).cast("double")


def in_text(value: Column, text: Column) -> Column:
    """The same over comparable forms."""
    return F.when(value == "", 0.0).when(F.contains(text, value), S.LLM_IN_TEXT).otherwise(S.LLM_NOT_IN_TEXT)


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_quality(text: Column) -> Column:
    """Points for what labels say and how they are laid out, less points for damage.

    Upper case, lines and the counts of each line are computed once and shared.
    """
    counted = lambda x: F.struct(x.alias("line"), visible_of(x).alias("visible"), letters_of(x).alias("letters"))
    body = F.coalesce(text, F.lit(""))
    parts = F.struct(
        F.upper(body).alias("upper"), F.transform(lines(text), counted).alias("rows"), visible_of(body).alias("visible"), letters_of(body).alias("letters"),
        F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")).alias("signs"),
    )
    return F.when(F.coalesce(strip(text), F.lit("")) == "", -20).otherwise(let(parts, _points)).cast("int")


def _points(x: Column) -> Column:
    upper, rows, visible, letters = x["upper"], x["rows"], x["visible"], x["letters"]
    score = F.lit(0)
    for pattern, weight in MARKERS:
        score = score + F.when(has(upper, bounded(pattern) if pattern else TO_LINE), weight).otherwise(0)
    for pattern, weight in LAYOUT:
        score = score + F.least(_hits(upper, pattern), F.lit(2)) * weight
    address = F.filter(rows, lambda r: (has(r["line"], r"\d") & has(r["line"], PLACE, True)) | has(r["line"], BOX, True))
    readable = F.filter(rows, lambda r: (r["visible"] >= 3) & (r["letters"] >= 3) & (2 * r["letters"] >= r["visible"]))
    one = F.size(F.filter(rows, lambda r: r["visible"] == 1))
    score = score + F.least(F.size(address), F.lit(3)) * 4 + F.least(F.size(readable), F.lit(6))
    symbols = visible - x["signs"]
    score = score - F.when(letters < 0.15 * visible, 8).when(letters < 0.3 * visible, 4).otherwise(0)
    score = score - F.when(symbols > 0.35 * visible, 5).when(symbols > 0.2 * visible, 2).otherwise(0)
    score = score - F.when(one > 0.4 * F.size(rows), 5).when(one > 0.25 * F.size(rows), 2).otherwise(0)
    return score - F.least(2 * _hits(upper, bounded(UPSIDE_DOWN)), F.lit(8))


def mean_ocr_confidence(confidences: Column) -> Column:
    """Mean of a scan's word confidences without the -1 of boxes that hold no word; 0 if none is left."""
    known = F.filter(confidences, lambda c: c.isNotNull() & (c != -1))
    total = F.aggregate(known, F.lit(0.0), lambda a, c: a + c.cast("double"))
    return F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))
