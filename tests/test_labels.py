"""Facts about the label operators, on invented people and places."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import comparators as C
from waybill.functions import scoring, tagging, text
from waybill.functions import tracking as T
from waybill.operators import calibration, parse, selection, store
from waybill.plans import scan, views
from waybill.plans.queries import QUERIES
from waybill.streaming import debounce


def values(spark, rows, *columns):
    """Columns over one-row tables: ``rows`` are (a, b) texts."""
    return [tuple(r) for r in spark.createDataFrame(rows, "a string, b string").select(*columns).collect()]


def test_names_streets_and_zips(spark):
    a, b = F.col("a"), F.col("b")
    names = [("Stone, Anna", "Anna Stone", True), ("annastone", "Anna Stone", True), ("Anna Q Stone", "Anna Stone", True), ("Anna Stone", "Anna Q. Stone", False), ("Anna Quinn Stone", "Anna Q Stone", True), ("", "x", False), (None, None, False)]
    assert [r[0] for r in values(spark, [n[:2] for n in names], C.same_name(a, b))] == [n[2] for n in names]
    streets = [("12 Oak Street", "12 OAK ST.", True), ("Return Address 12 Oak St", "12 Oak St", False), ("PO BOX 17", "PO BOX 17", False), ("APT 12 Oak St", "12 OAK STREET HUB 9", True)]
    assert [r[0] for r in values(spark, [s[:2] for s in streets], C.same_street(a, b))] == [s[2] for s in streets]
    assert values(spark, [("17013", "17013-2311")], C.same_zip(a, b)) == [(False,)]
    assert values(spark, [("PO BOX 1773", None)], C.scorable(F.lit("street_address"), a), C.scorable(F.lit("city"), a)) == [(False, True)]


def test_check_digits_and_carriers(spark):
    a = F.col("a")
    ups = [("1Z999AA10123456784", True), ("1Z999AA10123456785", False), ("TBA000000000001", None)]
    assert [r[0] for r in values(spark, [(n, "") for n, _ in ups], T.ups_checksum(a))] == [x for _, x in ups]
    usps = [("9400100000000000000006", True), ("9400100000000000000007", False), ("123", None), ("", None)]
    assert [r[0] for r in values(spark, [(n, "") for n, _ in usps], T.usps_checksum(a))] == [x for _, x in usps]
    carriers = [("spx1", "SpeedX"), ("TBA1", "Amazon"), ("YWNJC1", "YunExpress"), ("UUS1", "UniUni"), ("1LSD1", "TikTok"), ("9" + "1" * 19, "USPS"), ("1" * 15, "FEDEX"), ("x", "Unknown"), (None, "Unknown")]
    assert [r[0] for r in values(spark, [(n, "") for n, _ in carriers], T.carrier_of(a))] == [c for _, c in carriers]
    assert values(spark, [("1ba-000 000 000 001", "SPX000000000001")], T.clean(a), T.valid(a), T.valid(F.col("b"))) == [("TBA000000000001", True, False)]
    row = spark.createDataFrame([(["USPS TRACKING #", "9400 1000 0000 0000 0000 06"],), (["x"],), ([],)], "lines array<string>")
    assert [r[0] for r in row.select(T.tracking_in_lines(F.col("lines"))).collect()] == ["9400100000000000000006", "", ""]


def test_text_primitives(spark):
    got = values(spark, [(" a\x1cb\r\n\n c ", "o'brien-smith")], text.lines(F.col("a")), text.title(F.col("b")))
    assert got == [(["a", "b", "c"], "O'Brien-Smith")]
    assert values(spark, [("straße, x", None)], scoring.comparable(F.col("a")), scoring.text_quality(F.col("b"))) == [("STRASSE X", -20)]


def select_one(spark, policy=selection.base_policy, **c):
    base = {"field": "recipient_name", "rule_value": None, "rule_confidence": 0.5, "llm_value": None, "llm_confidence": 0.85, "ner_value": None, "ner_confidence": 0.0, "llm_mode": "none", "label_id": 1} | c
    schema = ", ".join(f"{k} {'double' if 'confidence' in k else 'int' if k == 'label_id' else 'string'}" for k in base)
    r = selection.select(spark.createDataFrame([tuple(base.values())], schema), policy).first()
    return r.value, r.source, r.reason


def test_selection_policies(spark):
    assert select_one(spark, rule_value="", llm_value="Ann", llm_mode="text") == ("Ann", "llm", "rule_blank_llm_fill")
    assert select_one(spark, rule_value="Bo", llm_value="Ann", llm_mode="vision") == ("Ann", "llm", "vision_conflict_override")
    assert select_one(spark, rule_value="Bo", llm_value="Ann", llm_mode="vision_fallback") == ("Bo", "rule_based", "rule_default")
    assert select_one(spark, rule_value="Troy.", llm_value="TROY", llm_mode="vision") == ("Troy.", "agreement", "rule_llm_agree")
    assert select_one(spark, rule_value="", llm_value="") == ("", "agreement", "rule_llm_agree")
    assert select_one(spark, rule_value="") == ("", "rule_based", "rule_default")
    ner = {"policy": selection.name_policy, "ner_value": "Ann Stone"}
    assert select_one(spark, rule_value="", ner_confidence=0.5, **ner)[1:] == ("ner", "ner_name_fill")
    assert select_one(spark, rule_value="Bo", ner_confidence=0.79, **ner)[1] == "rule_based"
    assert select_one(spark, rule_value="Bo", ner_confidence=0.8, **ner)[1:] == ("ner", "ner_name_override")
    assert select_one(spark, rule_value="Bo", ner_confidence=0.9, field="city", **ner)[1] == "rule_based"
    assert select_one(spark, rule_value="", llm_value="Cy", ner_confidence=0.9, **ner)[1] == "llm"
    with pytest.raises(ValueError):
        scan.resolve_policy(True, "auto")


def test_vision_triggers_of_every_parcel(spark, sf_dir):
    def reasons(r):
        blanks = (r.city == "") + (r.street_address == "") + (not re.fullmatch("[A-Z]{2}", r.state)) + (not re.fullmatch(r"\d{5}(-\d{4})?", r.zip_code))
        name = r.recipient_name
        checks = [("ocr_confidence_low", True), ("ocr_text_short", len(r.ocr_text.strip()) < 50), ("blank_address_fields", blanks >= 3)]
        return ",".join([n for n, fired in checks if fired] + ["name_single_word"] * (len(name) > 3 and " " not in name))

    rows = views.parcel(spark, sf_dir).collect()
    got = {r.label_id: r.triggers for r in QUERIES["vision_triggers_all"](spark, sf_dir).collect()}
    assert got == {r.label_id: reasons(r) for r in rows} and len(got) == len(rows)
    assert {got[r.label_id] for r in rows if r.form == 2} == {"ocr_confidence_low,name_single_word"}


def test_selection_and_comparison_of_every_field(spark, sf_dir):
    n = views.parcel(spark, sf_dir).count()
    for name in ("selection_legacy_fields", "comparison_record_fields"):
        counts = {r.field: r["count"] for r in QUERIES[name](spark, sf_dir).groupBy("field").count().collect()}
        assert counts == {f: n for f in S.FIELDS}


def test_calibration_lookup_falls_through(spark):
    table = spark.createDataFrame([("tracking_number", "rule", "checksum_valid=True", 0, 40, 0.96, "a"), ("tracking_number", "rule", None, 1, 90, 0.75, "b"), ("city", "llm", None, 1, 5, 0.99, "c"), (None, "llm", None, 2, 200, 0.9, "d")], "field string, source string, sig string, level int, n long, p double, key string")
    rows = spark.createDataFrame([(1, "tracking_number", "rule", "checksum_valid=True"), (2, "tracking_number", "rule", "checksum_valid=False"), (3, "city", "llm", ""), (4, "state", "barcode", "")], "id int, field string, source string, sig string")
    assert {r.id: (r.p, r.bucket) for r in calibration.lookup(rows, table).collect()} == {1: (0.96, "a"), 2: (0.75, "b"), 3: (0.9, "d"), 4: (None, None)}
    lo, hi = calibration.wilson(F.lit(2), F.lit(32))
    r = spark.range(1).select(F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi")).first()
    assert (r.lo, r.hi) == (0.0173, 0.2015)


def test_tokens_spans_and_tags(spark):
    assert len(values(spark, [("JOHN SMITH, 28 N. COLLEGE ST", "")], tagging.tokenize(F.col("a")))[0][0]) == 7
    tags = [(1, i, t, 0.8) for i, t in enumerate(["B-ZIP", "B-ZIP", "O", "I-STREET", "I-STREET", "B-NAME", "I-STREET", "B-NOPE"])]
    spans = tagging.decode(spark.createDataFrame(tags, "id int, pos int, tag string, prob double"))
    assert sorted((r.entity, r.start, r.end) for r in spans.collect()) == [("NAME", 5, 6), ("STREET", 3, 5), ("STREET", 6, 7), ("ZIP", 0, 1), ("ZIP", 1, 2)]
    assert {r.entity: r.start for r in tagging.best(spans).collect()} == {"ZIP": 0, "STREET": 3, "NAME": 5}
    rows = spark.createDataFrame([(1, "TO ANN STONE\n12 OAK ST", {"recipient_name": "Ann Stone", "street_address": "12 Oak St", "city": "Oak"}), (2, "", {"city": "x"})], "id int, text string, truth map<string,string>")
    labels = {r.id: r.labels for r in tagging.encode(rows).collect()}
    assert labels == {1: ["O", "B-NAME", "I-NAME", "B-STREET", "I-STREET", "I-STREET"], 2: []}


def parsed(spark, *lines):
    return parse.parse(spark.createDataFrame([(list(lines),)], "lines array<string>")).first()


def test_parsers(spark):
    r = parsed(spark, "USPS DELIVER TO:", "Anna Stone", "12 OAK ST", "Riverton OH 45001")
    assert (r.parser_used, r.recipient_name, r.street_address, r.city, r.state, r.zip_code) == ("deliver_to", "Anna Stone", "12 OAK ST", "Riverton", "OH", "45001")
    r = parsed(spark, "DELIVER TO", "x", "Riverton, OH,", "12 OAK ST", "45001")
    assert (r.parser_used, r.city, r.zip_code) == ("uniuni_deliver_to", "Riverton", "45001")
    r = parsed(spark, "45001-1234 Riverton x OH")
    assert r.parser_used == ""
    r = parsed(spark, "Anna Stone", "12 OAK ST", "45001-1234 Riverton x OH")
    assert (r.parser_used, r.recipient_name, r.zip_code) == ("zip_first_combined", "Anna Stone", "45001-1234")
    r = parsed(spark, "Anna Stone", "12 OAK ST", "Riverton, OH, US, 45001")
    assert (r.parser_used, r.city) == ("city_state_country_zip", "Riverton")
    r = parsed(spark, "Anna Stone", "no 12 OAK ST", "Riverton OH 45001")
    assert (r.parser_used, r.street_address, r.recipient_name) == ("generic_city_state_zip", "12 OAK ST", "Anna Stone")
    r = parsed(spark, "Anna Stone", "NORTH UNIVERSITY HUB 77", "12 OAK ST", "Riverton OH 45001")
    assert (r.parser_used, r.recipient_name) == ("college_mailroom_parser", "Anna Stone")
    assert parsed(spark).parser_used == ""


def test_mailroom_block_of_any_length(spark):
    boxes = [f"PO BOX {i}" for i in range(1, 106)]
    r = parsed(spark, "SHIP Anna Stone NORTH UNIVERSITY HUB 77", *boxes, "Riverton OH 45001")
    assert r.parser_used == "college_mailroom_parser" and all(b in r.street_address.upper() for b in boxes)


def test_store(spark):
    old = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), {"city": "X"}), (2, dt.datetime(2024, 1, 2), None)], "label_id int, processed_at timestamp, ground_truth map<string,string>")
    new = old.where("label_id = 1").withColumn("processed_at", F.lit(dt.datetime(2024, 2, 1)))
    assert {r.label_id: r.ground_truth for r in store.upsert(old, new).collect()} == {1: None, 2: None}
    marked = store.annotate(old, spark.createDataFrame([(2, {"city": "Y", "bad": "z"}), (9, {"city": "Q"})], "label_id int, ground_truth map<string,string>"))
    assert {r.label_id: r.ground_truth for r in marked.collect()} == {1: {"city": "X"}, 2: {"city": "Y"}}


def test_captures_do_not_depend_on_blocks(spark):
    start = dt.datetime(2024, 5, 1)
    rows, k = [], 0
    for stream in ("a", "b", None):
        at = start
        for i in range(150):
            k += 1
            at += dt.timedelta(milliseconds=(k * 37) % 900)
            rows.append((stream, at, k, (k * k // 60) % 3 != 0))
        rows.append((stream, None, k + 1000, True))
    frames = spark.createDataFrame(rows, "stream string, ts timestamp, frame_no long, detected boolean")
    hits, fired = {}, set()
    for stream in ("a", "b", None):
        last, since, done = [], None, False
        for _, at, no, detected in sorted((r for r in rows if r[0] == stream), key=lambda r: (r[1] is not None, r[1] or start, r[2])):
            last = [*last, detected][-10:]
            hits[no] = sum(last)
            if sum(last) < 3:
                since, done = None, False
                continue
            since = since or at
            if not done and at - since >= dt.timedelta(seconds=2):
                done = True
                fired.add((stream, no, since))
    assert len(fired) > 3
    for seconds in (1, 7, 600):
        assert {r.frame_no: r.hits for r in debounce.steady(frames, seconds).collect()} == hits
        assert {(r.stream, r.frame_no, r.since) for r in debounce.captures(frames, seconds).collect()} == fired


def test_stream_gives_the_batch_captures(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    frames = [("s", i, start + dt.timedelta(seconds=0.3 * i), (i // 15) % 2 == 0) for i in range(90)] + [("t", i, start + dt.timedelta(seconds=0.1 * i), i % 5 == 0) for i in range(40)]
    rows = spark.createDataFrame(frames, "stream string, frame_no long, ts timestamp, detected boolean")
    want = sorted((r.stream, r.frame_no) for r in debounce.captures(rows).collect())
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = debounce.captures_stream(stream, late="0 seconds").writeStream.format("memory").queryName("captured").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.stream, r.frame_no) for r in spark.table("captured").collect()) == want and len(want) >= 2
