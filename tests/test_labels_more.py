"""Rules that no query reaches: the mailroom's street, the campus address, warnings, penalties, confidence models, typed numbers."""

import pytest
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import scoring
from waybill.functions import tracking as T
from waybill.operators import calibration, parse


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_streets_of_the_mailroom_are_put_right(spark):
    place = ("DICKINSON COLLEGE", "CARLISLE PA 17013")
    fixed = lambda *lines, street: one(spark, parse.mailroom_street(strings(*lines), F.lit(street)))
    assert fixed("8 N COLLEGE ST", "HUB # 1234", *place, street="8 N COLLEGE ST") == "28 N COLLEGE ST HUB # 1234"
    assert fixed("8 N COLLEGE STREET", "UB 77", *place, street="x") == "28 N COLLEGE ST HUB 77"
    assert fixed("ZB-N COLLEGE ST HUB 555", *place, street="x") == "28 N COLLEGE ST HUB 555"
    assert fixed("28 N COLLEGE ST HUB 9", *place, street="28 N COLLEGE ST HUB 9") == "28 N COLLEGE ST HUB 9"
    assert fixed("8 N COLLEGE ST", "HUB # 1234", street="8 N COLLEGE ST") == "8 N COLLEGE ST"  # nothing else shows the place
    assert fixed("8 N COLLEGE ST", "HUB 1234", "CARLISLE, PA 17013", street="y") == "28 N COLLEGE ST HUB 1234"
    assert fixed("OAK ST", *place, street="y") == "y"


def test_campus_addresses(spark):
    found = lambda *lines: one(spark, parse.campus_address(strings(*lines)))
    got = found("Anna Stone", "112 Kern Building", "UNIVERSITY PARK, PA 16802-1234")
    assert (got.zip_code, got.street_address) == ("16802-1234", "112 Kern Building")
    got = found("E123 Holmes Center", "a", "b", "University Park PA 16802")
    assert (got.zip_code, got.street_address) == ("16802", "E123 Holmes Center")
    assert found("1 Far Building", "a", "b", "c", "d", "UNIVERSITY PARK PA 16802").street_address is None
    assert found("UNIVERSITY PARK PA 17013") is None and found() is None


def test_warnings_and_the_penalty_of_a_failed_check(spark):
    row = lambda **v: {f: F.lit(v.get(f, "")) for f in S.SCORED}
    good = row(recipient_name="Anna Stone", street_address="12 OAK ST", city="Troy", state="OH", zip_code="45001", tracking_number="9" * 22)
    assert one(spark, scoring.warnings(good, F.lit(True))) == [] and one(spark, scoring.warnings(good, F.lit(None).cast("boolean"))) == []
    assert one(spark, scoring.warnings(good, F.lit(False))) == ["tracking_checksum_failed"]
    missing = one(spark, scoring.warnings(row(), F.lit(None).cast("boolean")))
    assert missing == ["tracking_number_missing", "recipient_name_missing", "street_address_missing", "city_missing", "state_missing_or_invalid", "zip_code_missing_or_invalid"]
    odd = one(spark, scoring.warnings(row(recipient_name="Ann4", street_address="OAK ST", city="Tr0y", state="O", zip_code="450", tracking_number="123"), F.lit(False)))
    assert odd == ["tracking_number_short", "recipient_name_low_confidence", "street_address_missing_number", "city_low_confidence", "state_missing_or_invalid", "zip_code_missing_or_invalid", "tracking_checksum_failed"]
    sure = F.lit(0.95)
    assert [one(spark, scoring.penalised(sure, F.lit(x).cast("boolean"))) for x in (True, False, None)] == [0.95, S.CHECKSUM_FAILED, 0.95]


def test_modes_of_stored_columns(spark):
    mode = lambda policy, reasons, street, llm, **more: one(spark, scoring.llm_mode(F.lit(policy), strings(*reasons), F.lit(street), F.lit(llm), **more))
    assert mode("off", ["x"], "", "") == "none" and mode("auto", ["x"], "", "") == "vision" and mode("force_vision", [], "a", "a") == "vision"
    assert mode("auto", [], "", "") == "vision_fallback" and mode("auto", [], "", "12 OAK") == "text" and mode("auto", [], "12 OAK", "") == "text"
    assert mode("auto", [], "", "", enabled=F.lit(False)) == "text" and mode("auto", [], "12 OAK", "", rejected=F.lit(True)) == "vision_fallback"


def test_confidence_models(spark):
    rows = spark.createDataFrame([("city", "rule", "", 0.3), ("zip_code", "llm", "", 0.4)], "field string, source string, sig string, confidence double")
    table = spark.createDataFrame([("city", "rule", None, 1, 40, 0.9, "k")], "field string, source string, sig string, level int, n long, p double, key string")
    assert calibration.confidence_model("legacy", rows) is rows
    got = {r.field: r.confidence for r in calibration.confidence_model("calibrated", rows, table).collect()}
    assert got == {"city": 0.9, "zip_code": 0.4}
    for mode, given in (("calibrated", None), ("other", table)):
        with pytest.raises(ValueError):
            calibration.confidence_model(mode, rows, given)


def test_numbers_of_one_carrier(spark):
    assert one(spark, T.clean_ups(F.lit("1Z999AA1O123456784"))) == "1Z999AA10123456784" and one(spark, T.clean_ups(F.lit("1Z999AA1O123456783"))) == "1Z999AA1O123456783"
    assert [one(spark, T.valid_usps(F.lit(x))) for x in ("9400 1000 0000 0000 0000 00", "5600000000000000000000", "940012", "1Z999AA10123456784")] == [True, True, False, False]
    assert one(spark, T.from_barcodes(strings("x", "4201234594001000000000000000001234567890"))) == "001234567890"
