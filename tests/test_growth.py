"""What large tables need: even parts, work inside the row, methods small enough to be compiled."""

from pyspark.sql import functions as F

from waybill.functions import lines as L
from waybill.functions import tagging
from waybill.functions.text import let, lines, words
from waybill.operators import evaluation
from waybill.plans import queries, views


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_labels_come_in_even_parts(spark, sf_dir):
    parts = views.labels(spark, sf_dir).select("label_id").rdd.glom().map(len).collect()
    assert len(parts) == 4 and min(parts) > max(parts) / 2
    assert views.line(spark, sf_dir).rdd.getNumPartitions() == 4


def test_encoding_stays_inside_the_row(spark):
    shape = "id long, text string, truth map<string,string>"
    rows = spark.createDataFrame([(1, "Ann Stone OH", {"state": "OH"}), (1, "PA", {"state": "pa", "city": None}), (2, "x", None)], shape)
    encoded = tagging.encode(rows, carried=("truth",))
    assert "Exchange" not in plan_of(encoded) and "Join" not in plan_of(encoded)
    # Rows that share an id keep their own labels.
    assert sorted(r.labels for r in encoded.collect()) == [["B-STATE"], ["O"], ["O", "O", "B-STATE"]]
    assert [tuple(r) for r in tagging.match_rates(encoded).collect()] == [("state", 2, 2)]


def test_match_rates_read_the_labels_once(spark, sf_dir):
    assert plan_of(queries.field_match_rate(spark, sf_dir)).count("orders.parquet") == plan_of(queries.bio_encode(spark, sf_dir)).count("orders.parquet")


def test_provenance_is_made_inside_the_row(spark, sf_dir):
    plan = plan_of(queries.selection_provenance(spark, sf_dir))
    assert "SortAggregate" not in plan and "HashAggregate" not in plan and plan.count("orders.parquet") == 1


def test_candidates_of_all_sources_come_from_one_scan(spark, sf_dir):
    assert plan_of(queries.candidate_long(spark, sf_dir)).count("orders.parquet") == 1


def test_documents_come_in_even_parts(spark, sf_dir):
    for query in (queries.ocr_quality_score, queries.normalize_comparison):
        parts = query(spark, sf_dir).rdd.glom().map(len).collect()
        assert len(parts) == 4 and min(parts) > max(parts) / 2
    assert plan_of(queries.found_in_text_join(spark, sf_dir)).count("REPARTITION_BY_NUM") >= 1


def test_stored_labels_are_read_once(spark, sf_dir):
    for query in (queries.QUERIES["stored_candidate_accuracy"], queries.QUERIES["stored_ner_by_version"]):
        assert plan_of(query(spark, sf_dir)).count("orders.parquet") == 1


def test_samples_of_labels_read_them_once(spark, sf_dir):
    assert plan_of(queries.samples_from_labels(spark, sf_dir)).count("orders.parquet") == 1


def test_newest_keeps_what_latest_keeps(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 2), (4, "", 1), (4, "", 1), (5, None, 1)], "label_id long, tracking_number string, processed_at int")
    kept = [sorted(r.label_id for r in f(rows).collect()) for f in (evaluation.newest, evaluation.latest)]
    assert kept == [[2, 4, 4, 5]] * 2


def test_match_rates_make_only_the_columns_they_read(spark, sf_dir):
    # The view of all stored columns was made for each label: values, sources and confidences that no tag needs.
    plan = queries.field_match_rate(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ner_confidence" not in plan and "llm_name" not in plan and "true_street" in plan


def test_spans_are_found_exactly_then_without_case_then_without_marks(spark):
    rows = spark.createDataFrame([("ANN Ann ann",), ("x ann",), ("x A-n.n #",), ("x",), (None,)], "text string")
    found = rows.select(tagging.find_span(tagging.tokenize("text"), F.lit("Ann")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in found] == [(1, 2), (1, 2), (1, 2), None, None]


def test_a_scan_without_a_model_asks_no_python_worker(spark, sf_dir):
    plan = plan_of(queries.scan_fields(spark, sf_dir))
    assert "Python" not in plan and "Exchange" in plan


def test_texts_are_read_once_and_send_only_words_that_passages_ask_for(spark, sf_dir):
    found = queries.found_in_text_join(spark, sf_dir)
    found.collect()
    final = plan_of(found).split("Initial Plan")[0]
    # The words that were found serve the counts and the search; no text is cut into words a second time.
    assert final.count("documents.parquet") == 1 and final.count("explode(split(") == 1
    assert "LeftSemi" in final and "ReusedExchange" in final


def test_a_scan_takes_few_passes_and_makes_no_warnings_that_nobody_reads(spark, sf_dir):
    plan = queries.scan_fields(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Each pass writes every column of the row anew; there were twenty, and the features of all lines went through most of them.
    assert plan.count("Generate inline(") <= 7 and "tracking_number_missing" not in plan and "name_single_word" not in plan


def test_lines_that_need_no_cleaning_are_told_from_those_that_do(spark):
    same = ["Ann Stone", "12 OAK ST", "12 old oak Street", "Troy PA 12345", "1Z999AA10000000001", "9400", "TO: Ann", "S Oak", "x " * 20_000 + "x", ""]
    made = {"12 OAK ST ab": "12 OAK ST", "12. OAK ST": "12 OAK ST", "N 12 OAK RD": "N12 OAK RD", "s 12": "s12", "AUB 7": "HUB 7", "1@2": "102", "a  b": "a b", " a": "a", "a b": "a b", "x REQUESTED  y": "x REQUESTED y",
            "~ 12 OAK ST": "12 OAK ST", "28 N COLLEGE ST HUB 3": "28 N COLLEGE ST HUB 3", "12 OAK ST;": "12 OAK ST", "\\IVERSITY": "UNIVERSITY", "PRRLISLE": "CARLISLE"}
    rows = spark.createDataFrame([(x, y) for x, y in [*((s, s) for s in same), *made.items()]], "x string, y string")
    for bind in (L.repeated, let):
        assert [(r.x[:30], r.a[:30]) for r in rows.select("x", "y", L.clean_address(F.col("x"), bind).alias("a")).collect() if r.a != r.y] == []


def test_lines_and_words_are_cut_at_unicode_spaces(spark):
    texts = [" a b\r\n\r\n c \x0bd\x1e \x1fe", " x ", "", None, " \n ", "\U0001f600 y\x85z"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(lines("x").alias("l"), words("x").alias("w")).collect()
    assert [r.l for r in rows] == [["a b", "c", "d", "e"], ["x"], [], [], [], ["\U0001f600 y", "z"]]
    assert [r.w for r in rows] == [["a", "b", "c", "d", "e"], ["x"], [], [], [], ["\U0001f600", "y", "z"]]
