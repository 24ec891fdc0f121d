"""Readers, sinks and operators of stored labels, and the arithmetic around a tagger."""

import json
import math
import random
import re

from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import scoring, tagging
from waybill.operators import backtest, calibration, evaluation, selection, store
from waybill.sources import readers, sinks

WORD = re.compile(r"[A-Za-z0-9#&'.\-]+|[^\w\s]")


def tagged(text, truth):
    """Tags by a plain walk: longer values first, free tokens only."""
    tokens = WORD.findall(text)
    labels = ["O"] * len(tokens)
    plain = lambda t: re.sub(r"[^\w]", "", t).lower()
    for field in sorted(S.FIELDS, key=lambda f: -len(truth.get(f) or "")):
        wanted = WORD.findall(truth.get(field) or "")
        bare = [x for x in map(plain, wanted) if x]
        found = None
        for hay, needle in ((tokens, wanted), ([t.lower() for t in tokens], [w.lower() for w in wanted]), ([plain(t) for t in tokens], bare)):
            if found is None and needle:
                found = next(((i, i + len(needle)) for i in range(len(hay) - len(needle) + 1) if hay[i : i + len(needle)] == needle), None)
        for i in range(*(found or (0, 0))):
            if labels[i] == "O":
                tag = S.TAG_OF[field]
                labels[i] = f"{'B' if i == found[0] or tag not in S.LONG_TAGS else 'I'}-{tag}"
    return tokens, labels


def test_overlapping_values_keep_their_free_tokens(spark):
    rng = random.Random(3)
    cases = [("12 OAK ST Riverton OH", {"street_address": "12 OAK ST Riverton", "city": "Riverton OH"})]
    for _ in range(60):
        words = [rng.choice(["Oak", "ST", "ann", "PA", "17013", "1Z9", "Lake", "-", "x."]) for _ in range(12)]
        cut = lambda: " ".join(words[(a := rng.randrange(12)) : a + rng.randrange(1, 5)])  # noqa: B023, E731
        cases.append((" ".join(words), {f: cut() for f in S.FIELDS if rng.random() < 0.7}))
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, text string, truth map<string,string>")
    got = {r.id: (r.tokens, r.labels) for r in tagging.encode(rows).collect()}
    assert got[0][1] == ["B-STREET", "I-STREET", "I-STREET", "I-STREET", "I-CITY"]
    assert got == {i: tagged(*c) for i, c in enumerate(cases)}


def test_words_take_the_prediction_of_their_first_piece(spark):
    logits = [[0.0] * 12, [5.0, *[0.0] * 11], [1.0, 3.0, *[0.5] * 10], [0.0] * 11 + [2.0]]
    rows = spark.createDataFrame([(1, 4, [None, 0, 1, 1], logits), (2, 0, [], [])], "id long, n_words int, word_ids array<int>, logits array<array<double>>")
    got = {r.pos: (r.tag, r.prob) for r in tagging.word_predictions(rows).collect()}
    share = lambda x: math.exp(max(x)) / sum(map(math.exp, x))
    assert [got[i][0] for i in range(4)] == [S.TAGS[0], S.TAGS[1], "O", "O"]
    assert abs(got[0][1] - share(logits[1])) < 1e-12 and abs(got[1][1] - share(logits[2])) < 1e-12 and got[3][1] == 0.0
    number = S.TAGS.index
    pieces = spark.createDataFrame([([None, 0, 0, 1, 1, 2, None], ["B-NAME", "B-ZIP", "odd"])], "w array<int>, l array<string>")
    aligned = pieces.select(tagging.aligned_labels(F.col("w"), F.col("l"))).first()[0]
    assert aligned == [-100, number("B-NAME"), number("I-NAME"), number("B-ZIP"), number("B-ZIP"), 0, -100]
    right = tagging.token_accuracy(spark.createDataFrame([(["O", "B-ZIP", "O"], ["O", "O", "-100"])], "predicted array<string>, expected array<string>")).first()
    assert (right.n, right.n_correct) == (2, 1)
    words = F.array(*[F.lit(x) for x in ("1Z", "9", "pa")])
    row = spark.range(1).select(*[tagging.value_of(words, F.lit(e), F.lit(a), F.lit(b)) for e, a, b in (("TRACKING", 0, 2), ("STATE", 2, 3), ("NAME", 0, 2))]).first()
    assert tuple(row) == ("1Z9", "PA", "1Z 9")


def test_fixtures_images_and_imports(spark, tmp_path):
    for folder, stem, text in (("ups", "a", {"city": "Riverton", "tracking_number": "1Z1"}), ("ups", "b", {"city": "Fairview"}), ("usps", "c", None)):
        (tmp_path / folder / "expected").mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "images").mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "expected" / f"{stem}.json").write_text("{broken" if text is None else json.dumps(text, indent=1))
        (tmp_path / folder / "images" / f"{stem}.png").write_bytes(b"p")
    (tmp_path / "ups" / "images" / "a.jpg").write_bytes(b"j")
    (tmp_path / "ups" / "images" / "none.jpeg").write_bytes(b"n")
    expected, found = readers.fixtures(spark, f"{tmp_path}/*/expected/*.json"), readers.images(spark, f"{tmp_path}/*/images/*")
    assert {(r.folder, r.stem): (r.city, r.broken) for r in expected.collect()} == {("ups", "a"): ("Riverton", False), ("ups", "b"): ("Fairview", False), ("usps", "c"): (None, True)}
    paths = {r.stem: (r.image_path or "").rsplit("/", 1)[-1] for r in readers.with_image(expected, found).collect()}
    assert paths == {"a": "a.jpg", "b": "b.png", "c": "c.png"}
    assert tuple(store.import_problems(found, expected).first()) == (1, 1)
    extracted = readers.with_image(expected, found).select("image_path", F.upper("city").alias("city"), *[F.lit("").alias(f) for f in S.FIELDS if f != "city"])
    rates = {r.field: (r.total, r.passed, r.rate) for r in evaluation.fixture_rates(readers.with_image(expected, found), extracted).collect()}
    assert rates["city"] == (2, 2, 100.0) and rates["tracking_number"] == (1, 0, 0.0) and rates["state"] == (0, 0, 0.0)
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(lines), "a int").orderBy("a").collect()] == [1, 2]
    shape = "label_id string, original_filename string, ocr_text string, ocr_confidence double, ocr_rotations long, ground_truth map<string,string>"
    rows = store.dataset_rows(spark.createDataFrame([("x", "a.png", "t", 90.0, 4, {"city": "Riverton", "other": "z"})], shape)).first()
    assert (rows.city, rows.city_source, rows.city_confidence, rows.state, rows.llm_called) == ("Riverton", "dataset", 1.0, "", False)
    assert rows.ground_truth == {f: ("Riverton" if f == "city" else "") for f in S.FIELDS}
    fixtures, stored = (spark.createDataFrame(x, "k long, tracking_number string") for x in ([(1, "A"), (2, "A"), (3, ""), (4, None), (5, "B")], [(9, "B")]))
    assert tuple(store.import_counts(fixtures, stored, "k").first()) == (3, 2)


def test_calibration_artifact_round_trip(spark, tmp_path):
    rows = [("city", "llm", "found_in_ocr=True", i % 3 > 0, 0.5) for i in range(40)] + [("zip_code", "rule", "", True, None)] * 3
    table = calibration.fit(spark.createDataFrame(rows, "field string, source string, sig string, correct boolean, confidence double"))
    sinks.write_calibration(table, str(tmp_path / "table"), 43, 43, 25)
    names = ["key", "field", "source", "sig", "level", "n", "p"]
    read = readers.calibration_table(spark, str(tmp_path / "table"))
    plain = lambda frame: sorted(tuple("" if v is None else v for v in r) for r in frame.select(*names).collect())
    assert plain(read) == plain(table) and read.count() == 5
    assert readers.calibration_table(spark, str(tmp_path / "none")).count() == 0
    assert [r.key for r in calibration.report(table).collect()] == ["city|llm", "city|llm|found_in_ocr=True", "zip_code|rule", "llm", "rule"]


def test_training_sink_counts_texts_without_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, "12 Oak", {"street_address": "12 Oak"}), (2, "  ", {"city": "x"}), (3, None, {})], "id long, text string, truth map<string,string>")
    assert tuple(sinks.write_training(rows, str(tmp_path / "t")).first()) == (1, 2)
    assert [tuple(r) for r in spark.read.schema("id long, tokens array<string>, labels array<string>").json(str(tmp_path / "t")).collect()] == [(1, ["12", "Oak"], ["B-STREET", "I-STREET"])]


def test_recomputed_validations(spark):
    shape = "field string, source string, value string, tracking_number string, carrier string, ocr_text string"
    rows = spark.createDataFrame([
        ("tracking_number", "rule", "1Z999AA10123456784", "1Z999AA10123456784", "UPS", "x"), ("tracking_number", "llm", "1Z999AA10123456785", "1Z999AA10123456785", "UPS", "no 1z999aa10123456785"),
        ("city", "llm", "River-ton", "", "", "at RIVERTON"), ("city", "llm", "Fairview", "", "", "at RIVERTON"), ("city", "llm", "", "", "", "t"), ("city", "rule", "Riverton", "", "", "Riverton"), ("city", "llm", "x", None, None, None),
    ], shape)
    label = {c: F.col(c) for c in ("value", "tracking_number", "carrier", "ocr_text")}
    got = [r[0] for r in rows.select(calibration.signature(calibration.recomputed_validations(F.col("field"), F.col("source"), label))).collect()]
    assert got == ["checksum_valid=True", "checksum_valid=False,found_in_ocr=True", "found_in_ocr=True", "found_in_ocr=False", "", "", ""]


def test_rotations_gates_and_splits(spark):
    rows = [(1, 0, "a", 80.0, 3), (1, 1, "b", 80.0, 12), (1, 2, "c", 99.0, 20), (2, 0, "d", 10.0, 5), (2, 1, "e", 10.0, 5), (3, 0, "f", 10.0, -20)]
    got = {r.label_id: (r.ocr_text, r.tried) for r in readers.best_rotation(spark.createDataFrame(rows, "label_id long, rot_no int, text string, conf double, score int")).collect()}
    assert got == {1: ("b", 2), 2: ("d", 2), 3: ("", 1)}
    conf = spark.createDataFrame([([-1, 50, 70],), ([-1],), (None,)], "c array<int>").select(scoring.mean_ocr_confidence(F.col("c"))).collect()
    assert [r[0] for r in conf] == [60.0, 0.0, 0.0]
    gate = spark.createDataFrame([(1, {"city": ["c"]}, {"city": "x"}), (2, {}, {"city": "x"}), (3, None, {"city": "x"}), (4, {"city": ["c"]}, None)], "label_id long, candidates map<string,array<string>>, ground_truth map<string,string>")
    assert [r.label_id for r in evaluation.with_provenance(gate).collect()] == [1]
    assert backtest.split(spark.range(24).toDF("label_id")).where("test").count() == 0
    assert 0 < backtest.split(spark.range(500).toDF("label_id")).where("test").count() < 200
    stored = spark.createDataFrame([(1, {"city": "x"}, "t"), (2, None, "t")], "label_id long, ground_truth map<string,string>, ocr_text string")
    usable, counts = backtest.held_out(stored, spark.createDataFrame([(1,), (2,), (3,), (1,)], "label_id long"))
    assert [r.label_id for r in usable.collect()] == [1] and tuple(counts.first()) == (1, 2)
    wide = S.evolve(spark.createDataFrame([("1", "c", 5)], "id string, city string, extra int"))
    assert {f.name for f in S.labels_schema()} | {"extra"} == set(wide.columns) and wide.first().city == "c"


def test_upserts_take_one_row_of_a_key(spark):
    shape = "label_id long, processed_at int, city string, ground_truth string"
    old = spark.createDataFrame([(1, 1, "a", "t"), (2, 1, "b", "u")], shape)
    new = spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (2, 3, "e"), (3, 1, "f")], "label_id long, processed_at int, city string")
    assert sorted(tuple(r) for r in store.upsert(old, new).collect()) == [(1, 1, "a", "t"), (2, 3, "e", None), (3, 1, "f", None)]
    assert store.recent(old.withColumn("original_filename", F.lit("n"))).columns == ["label_id", "processed_at", "original_filename", "has_ground_truth"]


def test_extraction_results(spark):
    values = {"recipient_name": ("Ann Stone", "Bo Marsh"), "city": ("", "Riverton"), "carrier": ("Unknown", "UPS")}
    columns = {**{f: F.lit(values.get(f, ("", ""))[0]) for f in S.FIELDS}, **{f"llm_{f}": F.lit(values.get(f, ("", ""))[1]) for f in S.FIELDS}, **{f"{f}_confidence": F.lit(0.4) for f in S.SCORED}}
    rows = spark.range(2).withColumnRenamed("id", "label_id").withColumns({**columns, "llm_enabled": F.col("label_id") == 1, "llm_mode": F.when(F.col("label_id") == 1, "text").otherwise("none"), "ocr_text": F.lit("RIVERTON"), "parser_used": F.lit("p"), "tracking_source": F.lit("ocr"), "street_rejected": F.lit(True)})
    side = selection.sources_of(rows)
    long = selection.rule_candidates(rows).unionByName(selection.llm_candidates(rows))
    slow = selection.side_by_side(long, rows.select("label_id", "llm_mode"))
    order = [c for c in side.columns]
    assert sorted(map(str, side.select(order).collect())) == sorted(map(str, slow.select(order).collect()))
    out = {r.label_id: r for r in selection.results(selection.public_values(selection.select(side), rows), rows, selection.conflicts(side)).collect()}
    assert tuple(out[1].city) == ("Riverton", 0.85, "llm") and tuple(out[0].city) == ("", 0.4, "blank")
    assert tuple(out[1].street_address)[2] == "rejected_rule" and out[1].recipient_name.value == "Ann Stone"
    assert out[1].conflicts == ["recipient_name"] and out[0].conflicts == [] and out[1].llm_telemetry.fields_from_llm == ["city"]
    assert out[0].llm_telemetry.called is False and out[1].ner_telemetry is None and out[1].ocr_rotations_tried == 4


def test_passages_of_any_length_are_found(spark, tmp_path):
    from waybill.plans import queries

    rng = random.Random(6)
    words = ["al", "be", "ga", "de", "ep", "ze"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(99, None)]
    items = [(k, " ".join(rng.choice(words) for _ in range(1 + k % 7))[k % 2 :]) for k in range(70)] + [(99, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i) for d, t in docs for i, v in items if t and v.strip() and v.strip().upper() in t.upper()}
    got = [tuple(r) for r in queries.found_in_text_join(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
