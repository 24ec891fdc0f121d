"""The models' seams: two passes, failures, one opening a process, and the way from words to fields."""

import os
import sys
import uuid

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import tagging
from waybill.operators import models, selection
from waybill.plans import model_queries, scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no path to the tests
SHAPE = "label_id int, ocr_text string, trigger_reasons array<string>, street_rejected boolean, " + ", ".join(f"{f} string" for f in S.FIELDS)


def label(i, text, street="", reasons=(), rejected=False, **more):
    values = {f: "" for f in S.FIELDS} | {"street_address": street} | more
    return (i, text, list(reasons), rejected, *[values[f] for f in S.FIELDS])


def scripted():
    """Answers by words in the text: what the text call and the image call give, and where they fail or break."""

    def answer(rows):
        out = []
        for text, request in zip(rows["ocr_text"], rows["request"], strict=True):
            if f"{request} breaks" in text:
                raise OSError("no line")
            fields = {"street_address": f"{request} street" if f"{request} street" in text else None, "city": f" {request} city ", "failed": "busy" if f"{request} fails" in text else None}
            out.append(fields)
        return pd.DataFrame(out)

    return models.LanguageModel("scripted", "small", "large", answer)


def test_language_model_in_two_passes(spark):
    rows = spark.createDataFrame([
        label(1, "text street vision street"), label(2, "vision street"), label(3, "vision street", street="12 OAK ST"), label(4, "vision street", street="12 OAK ST", rejected=True),
        label(5, "vision street", reasons=["ocr_text_short"]), label(6, "vision breaks"), label(7, "text breaks"), label(8, "text fails", city="Troy"), label(9, "vision fails", city="Troy"), label(10, ""), label(11, "nothing"), label(12, "vision breaks", reasons=["x"]),
    ], SHAPE).repartition(1)
    got = {r.label_id: r for r in models.ask(rows, str(uuid.uuid4()), scripted).collect()}
    seen = {i: (r.llm_mode, r.llm_enabled, r.llm_calls, r.llm_street_address, r.llm_city) for i, r in got.items()}
    assert seen == {
        1: ("text", True, 1, "text street", "text city"),
        2: ("vision_fallback", True, 2, "vision street", "text city"),  # only what was blank is filled
        3: ("text", True, 1, "12 OAK ST", "text city"),
        4: ("text", True, 1, "12 OAK ST", "text city"),  # rejected by the rules, but the answer starts from their values
        5: ("vision", True, 1, "vision street", "vision city"),
        6: ("text", True, 2, "", "text city"),  # the second call breaks: the first one's answer stands
        7: ("none", False, 1, "", ""),
        8: ("vision_fallback", True, 2, "", "Troy"),
        9: ("vision_fallback", True, 2, "", "text city"),
        10: ("vision_fallback", True, 1, "", "vision city"),  # nothing to ask about but the image
        11: ("vision_fallback", True, 2, "", "text city"),
        12: ("none", False, 1, "", ""),
    }
    assert got[5].llm_model == "large" and got[1].llm_model == "small" and got[8].llm_notes == "call failed: busy" and got[10].llm_notes == "no text to ask about"
    off = models.ask(rows, "any", scripted, policy="off").collect()
    assert {(r.llm_mode, r.llm_enabled, r.llm_calls, r.llm_provider, r.llm_notes) for r in off} == {("none", False, 0, "none", "off by policy")} and {r.llm_street_address for r in off} == {"", "12 OAK ST"}
    forced = models.ask(rows.where("label_id = 3"), "any other", scripted, policy="force_vision").first()
    assert (forced.llm_mode, forced.llm_street_address) == ("vision", "vision street")
    assert models.ask(rows.limit(0), "none", scripted).count() == 0


def test_a_model_that_cannot_be_opened_is_tried_once(spark, tmp_path):
    key, place = str(uuid.uuid4()), str(tmp_path)

    def broken():
        open(os.path.join(place, str(uuid.uuid4())), "w").close()
        raise OSError("no artifact")

    rows = spark.createDataFrame([label(i, "words of a text") for i in range(50)], SHAPE).coalesce(1)
    out = models.ask(models.predict(rows, key, broken), key + "l", broken).collect()
    assert {(r.llm_enabled, r.llm_notes, len(r.ner), r.ner_version) for r in out} == {(False, "no model configured", 0, None)} and len(out) == 50
    assert len(os.listdir(place)) == 2  # one opening for each of the two models


def test_spans_inside_a_row_are_those_of_the_windows(spark):
    tags = spark.range(4000).select((F.col("id") % 40).alias("id"), F.floor(F.col("id") / 40).cast("int").alias("pos"), F.element_at(F.array(*[F.lit(t) for t in (*S.TAGS, "B-NOPE", "I-NAME", "I-NAME")]), (F.abs(F.hash("id")) % 15 + 1).cast("int")).alias("tag"), F.lit(0.5).alias("prob"))
    want = {(r.id, r.entity, r.start, r.end) for r in tagging.decode(tags).collect()}
    rows = tags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "prob"))).alias("tags"))
    got = rows.select("id", F.inline(tagging.spans_of(F.col("tags"))))
    assert {(r.id, r.entity, r.start, r.end) for r in got.collect()} == want and len(want) > 500


def test_words_beyond_the_cut_have_no_prediction(spark):
    text = "Anna Stone " * 400
    rows = spark.createDataFrame([label(1, text), label(2, ""), label(3, None)], SHAPE)
    got = {r.label_id: r for r in models.predict(rows, "cut", model_queries.arithmetic_tagger).collect()}
    few = models.predict(rows, "cut", model_queries.arithmetic_tagger, max_pieces=2).collect()
    assert got[1].ner and got[1].ner_version == "arithmetic@1" and not got[2].ner and not got[3].ner and not any(r.ner for r in few)
    cut = spark.createDataFrame([([None, 0, 0, 1, None], ["B-NAME", "O"])], "w array<int>, l array<string>")
    assert cut.select(tagging.aligned_labels(F.col("w"), F.col("l"), 3)).first()[0] == [-100, 1, 2]


def test_span_f1_by_entity(spark):
    shape = "id int, pos int, tag string, prob double"
    tags = lambda *texts: spark.createDataFrame([(i, p, t, 1.0) for i, ts in enumerate(texts) for p, t in enumerate(ts.split())], shape)
    got = {r.entity: (r.n_expected, r.n_predicted, r.n_common, r.f1) for r in tagging.span_f1(tags("B-NAME I-NAME O B-ZIP", "B-CITY"), tags("B-NAME I-NAME O B-ZIP", "I-NAME")).collect()}
    assert got == {"NAME": (1, 2, 1, round(2 / 3, 6)), "ZIP": (1, 1, 1, 1.0), "CITY": (1, 0, 0, 0.0), "micro": (3, 3, 2, round(2 / 3, 6))}


def test_scan_with_both_models(spark):
    text = "SHIP TO\nAnna Stone\n12 OAK ST\nRiverton OH 45001\nUSPS TRACKING #\n9400 1000 0000 0000 0000 00"
    texts = spark.createDataFrame([(1, text, 95.0, []), (2, "nothing to read here but many words that fill the line up", 95.0, [])], "label_id int, ocr_text string, ocr_confidence double, barcodes array<string>")
    seams = scan.Seams(scripted, str(uuid.uuid4()), model_queries.arithmetic_tagger, "arithmetic tagger")
    rows = scan.asked(texts, seams).collect()
    assert {r.label_id: r.llm_mode for r in rows} == {1: "text", 2: "vision"}
    got = {(r.label_id, r.field): (r.value, r.source) for r in scan.scan(texts, seams, select=selection.name_policy).collect()}
    assert got[1, "street_address"] == ("12 OAK ST", "agreement") and got[1, "zip_code"][0] == "45001" and got[2, "city"] == ("vision city", "llm") and len(got) == 14
    plain = {(r.label_id, r.field): (r.value, r.source) for r in scan.scan(texts).collect()}
    assert plain[1, "city"] == ("Riverton", "rule") and plain[2, "city"] == ("", "blank")
    plan = scan.scan(texts, seams)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
