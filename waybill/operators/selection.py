"""Candidates of the sources, and which of them a field takes.

Candidates are one long frame (label_id, field, value, source, confidence,
validations, reason); selection pivots the three sources of a field into one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import tracking as T
from waybill.functions.comparators import plausible_name
from waybill.functions.scoring import comparable, found_in_text, in_text
from waybill.functions.text import full, let, staged


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _flag(name: str, test: Column) -> Column:
    return F.when(test.isNotNull(), F.create_map(F.lit(name), test.cast("string"))).otherwise(_empty_map())


def _candidate(field: str, value: Column, source: str, confidence: Column, validations: Column, reason: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.coalesce(value, F.lit("")).alias("value"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"), validations.alias("validations"), reason.alias("reason"))


def rule_candidates(rows: DataFrame) -> DataFrame:
    """Seven candidates a label, blank values too; the number's carries its check digit."""
    check = _flag("checksum_valid", T.checksum(F.col("tracking_number"), F.col("carrier")))
    conf = lambda f: F.coalesce(F.col(f"{'tracking_number' if f == 'carrier' else f}_confidence"), F.lit(0.0))
    each = [_candidate(f, F.col(f), "rule", conf(f), check if f == "tracking_number" else _empty_map(), F.col("parser_used")) for f in S.FIELDS]
    return rows.select("label_id", F.inline(F.array(*each)))


def llm_candidates(rows: DataFrame) -> DataFrame:
    """A model's values (columns ``llm_<field>``) where it was asked; blank ones count too."""
    def one(f: str) -> Column:
        conf = found_in_text(F.col(f"llm_{f}"), F.col("ocr_text"), F.lit(True)) if f != "carrier" else F.lit(0.0)
        return _candidate(f, F.col(f"llm_{f}"), "llm", conf, _flag("found_in_ocr", conf == S.LLM_IN_TEXT), F.lit("llm"))

    return rows.where("llm_enabled").select("label_id", F.inline(F.array(*[one(f) for f in S.FIELDS])))


def ner_validations(field: Column, value: Column) -> Column:
    return (
        F.when(field == "recipient_name", _flag("name_plausible", plausible_name(value)))
        .when(field == "state", _flag("format_valid", full(value, "[A-Z]{2}")))
        .when(field == "zip_code", _flag("format_valid", full(value, r"\d{5}(-\d{4})?")))
        .when(field == "tracking_number", _flag("checksum_valid", T.checksum(value, T.carrier_of(value))))
        .otherwise(_empty_map())
    )


def ner_candidates(rows: DataFrame) -> DataFrame:
    """Non-empty predictions of ``ner``, a map of field to (value, confidence, alternates)."""
    each = rows.select("label_id", F.explode("ner").alias("field", "p"), "ner_version").where("p.value <> ''")
    more = F.create_map(F.lit("alternates"), F.col("p.alternates").cast("string"))
    return each.select("label_id", "field", F.col("p.value").alias("value"), F.lit("ner").alias("source"), F.col("p.confidence").alias("confidence"), F.map_concat(ner_validations(F.col("field"), F.col("p.value")), more).alias("validations"), F.col("ner_version").alias("reason"))


def proposed(rows: DataFrame) -> DataFrame:
    """(label_id, field, source, value) of the candidates of all sources, in one scan of wide rows."""
    entry = lambda f, source, value: F.struct(f.alias("field"), F.lit(source).alias("source"), F.coalesce(value, F.lit("")).alias("value"))
    rule = F.array(*[entry(F.lit(f), "rule", F.col(f)) for f in S.FIELDS])
    llm = F.filter(F.array(*[F.when(F.col("llm_enabled"), entry(F.lit(f), "llm", F.col(f"llm_{f}"))) for f in S.FIELDS]), lambda x: x.isNotNull())
    ner = F.filter(F.transform(F.coalesce(F.map_entries("ner"), F.array()), lambda e: entry(e["key"], "ner", e["value"]["value"])), lambda x: x["value"] != "")
    return rows.select("label_id", F.inline(F.concat(rule, llm, ner)))


def side_by_side(candidates: DataFrame, modes: DataFrame) -> DataFrame:
    """A row for each label and field: values and confidences of the sources, and the label's ``llm_mode``."""
    # Of two candidates of one source the surer one counts, then the greater value.
    best = lambda s: F.max(F.when(F.col("source") == s, F.struct("confidence", "value"))).alias(s)
    pivoted = candidates.groupBy("label_id", "field").agg(*[best(s) for s in ("rule", "llm", "ner")])
    return pivoted.select("label_id", "field", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("rule", "llm", "ner") for c in ("value", "confidence")]).join(modes, "label_id")


def sources_of(rows: DataFrame, fields: Sequence[str] = S.FIELDS, carried: Sequence[str] = ()) -> DataFrame:
    """What ``side_by_side`` gives for the candidates of wide rows, made inside each row: no shuffle, one scan.

    ``rows`` has the fields and their confidences, ``llm_<field>`` and ``llm_enabled``,
    ``ocr_text``, ``llm_mode`` and, where a tagger ran, ``ner``; ``carried`` columns of the label stay beside each field.
    """
    return rows.select("label_id", "llm_mode", *carried, F.inline(_sides(rows, fields)))


def _sides(rows: DataFrame, fields: Sequence[str] = S.FIELDS) -> Column:
    """An array with a struct for each field: values and confidences of the sources."""
    tagged = "ner" in rows.columns

    def one(field: str, text: Column) -> Column:
        value, asked = F.coalesce(F.col(f"llm_{field}"), F.lit("")), F.col("llm_enabled")
        sure = let(comparable(value), lambda v: in_text(v, text)) if field != "carrier" else F.lit(0.0)
        p = F.element_at("ner", F.lit(field)) if tagged else F.lit(None)
        taken = p["value"] != "" if tagged else F.lit(False)
        rule = F.coalesce(F.col(f"{'tracking_number' if field == 'carrier' else field}_confidence"), F.lit(0.0))
        return F.struct(
            F.lit(field).alias("field"), F.coalesce(field, F.lit("")).alias("rule_value"), rule.cast("double").alias("rule_confidence"),
            F.when(asked, value).alias("llm_value"), F.when(asked, sure).alias("llm_confidence"),
            F.when(taken, p["value"] if tagged else F.lit("")).alias("ner_value"), F.when(taken, (p["confidence"] if tagged else F.lit(0.0)).cast("double")).alias("ner_confidence"),
        )

    return let(F.when(F.col("llm_enabled"), comparable(F.col("ocr_text"))), lambda text: F.array(*[one(f, text) for f in fields]))


Policy = Callable[[dict[str, Column]], dict[str, Column]]


def base_policy(c: dict[str, Column]) -> dict[str, Column]:
    """Fill a blank rule value, override it in vision mode, else keep it."""
    rule, llm = F.coalesce(c["rule_value"], F.lit("")), F.coalesce(c["llm_value"], F.lit(""))
    agree = c["llm_value"].isNotNull() & (comparable(rule) == comparable(llm))
    fill = (rule == "") & (llm != "")
    override = (c["llm_mode"] == "vision") & (llm != "") & ~agree
    taken = fill | override
    return {
        "value": F.when(taken, llm).otherwise(rule),
        "source": F.when(taken, "llm").when(agree, "agreement").otherwise("rule_based"),
        "confidence": F.when(taken, c["llm_confidence"]).otherwise(F.coalesce(c["rule_confidence"], F.lit(0.0))),
        "reason": F.when(fill, "rule_blank_llm_fill").when(override, "vision_conflict_override").when(agree, "rule_llm_agree").otherwise("rule_default"),
    }


def ner_gate(value: Column, base_value: Column, base_source: Column, confidence: Column, override: Column | float = S.NER_OVERRIDE, fill: Column | float = S.NER_FILL) -> Column:
    """``fill``, ``override`` or null: whether a predicted name may replace the selected one."""
    open_ = (F.coalesce(value, F.lit("")) != "") & (base_source != "llm") & (comparable(value) != comparable(base_value)) & plausible_name(value)
    blank = F.coalesce(base_value, F.lit("")) == ""
    return F.when(open_ & blank & (confidence >= fill), "fill").when(open_ & ~blank & (confidence >= override), "override")


def name_policy(c: dict[str, Column]) -> dict[str, Column]:
    """The base policy, and for names alone a gated prediction."""
    base = base_policy(c)
    gate = F.when(c["field"] == "recipient_name", ner_gate(c["ner_value"], base["value"], base["source"], c["ner_confidence"]))
    won = gate.isNotNull()
    return {
        "value": F.when(won, c["ner_value"]).otherwise(base["value"]),
        "source": F.when(won, "ner").otherwise(base["source"]),
        "confidence": F.when(won, c["ner_confidence"]).otherwise(base["confidence"]),
        "reason": F.when(won, F.concat(F.lit("ner_name_"), gate)).otherwise(base["reason"]),
    }


#: What of a label its public values need.
CARRIED = ("tracking_source", "street_rejected", *(f"{f}_confidence" for f in S.SCORED))


def select(pivoted: DataFrame, policy: Policy = base_policy, carried: Sequence[str] = ()) -> DataFrame:
    """(label_id, field, value, source, confidence, reason) by the policy, and the carried columns."""
    columns = {c: F.col(c) for c in pivoted.columns}
    return pivoted.select("label_id", "field", *[v.alias(k) for k, v in policy(columns).items()], *carried)


def public_values(selected: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Values with public sources and confidences; ``selected`` carries ``CARRIED`` of its label, or takes it from ``labels``."""
    if labels is not None:
        selected = selected.join(labels.select("label_id", *CARRIED), "label_id")
    scored = F.lit(0.0)
    for f in S.SCORED:
        scored = F.when(F.col("field") == f, F.coalesce(F.col(f"{f}_confidence"), F.lit(0.0))).otherwise(scored)
    scored = F.when(F.col("field") == "carrier", F.coalesce("tracking_number_confidence", F.lit(0.0))).otherwise(scored)
    number, model = F.col("field") == "tracking_number", F.col("source").isin("llm", "ner")
    source = (
        F.when((F.col("value") == "") & (F.col("field") == "street_address") & F.col("street_rejected"), "rejected_rule").when(F.col("value") == "", "blank")
        .when(number, F.col("tracking_source")).when(F.col("source") == "rule_based", "rule").otherwise(F.col("source"))
    )
    conf = F.when((F.col("value") != "") & ~number & model, F.col("confidence")).otherwise(scored)
    return selected.select("label_id", "field", "value", conf.alias("confidence"), source.alias("source"), "reason")


def conflicts(pivoted: DataFrame) -> DataFrame:
    """(label_id, conflicts): sorted fields on which a model and the rules differ, neither being blank."""
    rule, llm = F.coalesce("rule_value", F.lit("")), F.coalesce("llm_value", F.lit(""))
    differ = (F.col("llm_mode") != "none") & (comparable(rule) != comparable(llm)) & (llm != "") & ~rule.isin("", "Unknown")
    return pivoted.groupBy("label_id").agg(F.sort_array(F.collect_list(F.when(differ, F.col("field")))).alias("conflicts"))


def comparison(pivoted: DataFrame, policy: Policy = base_policy) -> DataFrame:
    """Rule, model and selected value of each field, and whether the first two agree."""
    columns = {c: F.col(c) for c in pivoted.columns}
    agree = F.col("llm_value").isNotNull() & (comparable(F.col("rule_value")) == comparable(F.col("llm_value")))
    return pivoted.select("label_id", "field", F.coalesce("rule_value", F.lit("")).alias("rule_value"), F.coalesce("llm_value", F.lit("")).alias("llm_value"), policy(columns)["value"].alias("selected_value"), agree.alias("agreement"))


CANDIDATE = "struct<field:string,value:string,source:string,confidence:double,validations:map<string,string>,reason:string>"


def candidate_map(rows: DataFrame, sides: Column) -> Column:
    """All that was proposed, as a scan stores it: field to its candidates, those of the rules first, inside the row.

    ``sides`` are the sources of each field; a model that was asked proposes blanks too, a tagger only values.
    """
    tagged = "ner" in rows.columns
    version = F.col("ner_version") if "ner_version" in rows.columns else F.lit("ner")
    check = _flag("checksum_valid", T.checksum(F.col("tracking_number"), F.col("carrier")))

    def entries(x: Column) -> Column:
        number = x["field"] == "tracking_number"
        rule = F.struct(x["field"], x["rule_value"], F.lit("rule"), x["rule_confidence"], F.when(number, check).otherwise(_empty_map()), F.col("parser_used"))
        there = F.when(x["field"] != "carrier", x["llm_confidence"] == S.LLM_IN_TEXT)
        llm = F.struct(x["field"], x["llm_value"], F.lit("llm"), x["llm_confidence"], _flag("found_in_ocr", F.coalesce(there, F.lit(False))), F.lit("llm"))
        alternates = F.element_at("ner", x["field"])["alternates"].cast("string") if tagged else F.lit(None).cast("string")
        validations = F.map_concat(ner_validations(x["field"], x["ner_value"]), F.create_map(F.lit("alternates"), alternates))
        ner = F.struct(x["field"], x["ner_value"], F.lit("ner"), x["ner_confidence"], validations, version)
        each = [rule.cast(CANDIDATE), F.when(x["llm_value"].isNotNull(), llm.cast(CANDIDATE)), F.when(x["ner_value"].isNotNull(), ner.cast(CANDIDATE))]
        return F.filter(F.array(*each), lambda c: c.isNotNull())

    return F.map_from_entries(F.transform(sides, lambda x: F.struct(x["field"], entries(x))))


def with_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``candidates``, the map of all that was proposed."""
    rows = staged(rows, {"_sides": _sides(rows)})
    return staged(rows, {"candidates": candidate_map(rows, F.col("_sides"))}).drop("_sides")


def _chosen(rows: DataFrame, policy: Policy) -> Column:
    """An array with a struct for each field of ``_sides``: what the policy selects."""
    def chosen(x: Column) -> Column:
        named = {c: x[c] for c in ("field", "rule_value", "rule_confidence", "llm_value", "llm_confidence", "ner_value", "ner_confidence")}
        out = policy(named | {"llm_mode": F.col("llm_mode")})
        return F.struct(x["field"].alias("field"), *[v.alias(k) for k, v in out.items()])

    return F.transform("_sides", chosen)


def provenance_of(rows: DataFrame, policy: Policy = base_policy) -> DataFrame:
    """What ``provenance`` gives for the candidates of wide rows, made inside each row: no shuffle, one scan."""
    rows = staged(rows, {"_sides": _sides(rows)})
    rows = staged(rows, {"_chosen": _chosen(rows, policy), "candidates": candidate_map(rows, F.col("_sides"))})
    entry = lambda c: F.struct(c["source"].alias("source"), F.to_json(c).alias("c"))
    listed = lambda e: F.struct(e["key"].alias("field"), F.transform(F.array_sort(F.transform(e["value"], entry)), lambda x: x["c"]).alias("c"))
    reason = F.transform("_chosen", lambda x: F.struct(x["field"].alias("field"), x["reason"].alias("reason")))
    return staged(rows, {
        "selection_reasons": F.map_from_entries(F.array_sort(reason)), "candidates": F.map_from_entries(F.array_sort(F.transform(F.map_entries("candidates"), listed))),
    }).select("label_id", "selection_reasons", "candidates")


def with_choices(rows: DataFrame, policy: Policy = base_policy) -> DataFrame:
    """``rows`` with ``choices``, the selected value of every field with its public source and confidence, and ``candidates``; no shuffle."""
    rows = staged(rows, {"_sides": _sides(rows)})
    own = F.create_map(*[x for f in S.FIELDS for x in (F.lit(f), F.coalesce(F.col(f"{'tracking_number' if f == 'carrier' else f}_confidence"), F.lit(0.0)).cast("double"))])
    rows = staged(rows, {"_chosen": _chosen(rows, policy), "candidates": candidate_map(rows, F.col("_sides")), "_own": own})

    def public(x: Column) -> Column:
        number, model = x["field"] == "tracking_number", x["source"].isin("llm", "ner")
        source = (
            F.when((x["value"] == "") & (x["field"] == "street_address") & F.col("street_rejected"), "rejected_rule").when(x["value"] == "", "blank")
            .when(number, F.col("tracking_source")).when(x["source"] == "rule_based", "rule").otherwise(x["source"])
        )
        confidence = F.when((x["value"] != "") & ~number & model, x["confidence"]).otherwise(F.element_at("_own", x["field"]))
        return F.struct(x["field"].alias("field"), x["value"].alias("value"), source.alias("source"), confidence.cast("double").alias("confidence"), x["reason"].alias("reason"))

    return staged(rows, {"choices": F.transform("_chosen", public)}).drop("_sides", "_chosen", "_own")


def stored(rows: DataFrame, at: Column, policy: Policy = base_policy) -> DataFrame:
    """The stored label of each scanned text, one wide row: values, provenance and how the models were asked; ``at`` is its time."""
    rows = with_choices(rows, policy)
    value = lambda f, c: F.get("choices", S.FIELDS.index(f))[c]
    known = lambda c, default: F.col(c) if c in rows.columns else default
    wide = [value(f, c).alias(name) for f in S.FIELDS for c, name in (("value", f), ("confidence", f"{f}_confidence"), ("source", f"{f}_source"))]
    return rows.select(
        F.col("label_id").cast("string").alias("label_id"), at.alias("processed_at"), known("original_filename", F.lit(None).cast("string")).alias("original_filename"), "ocr_text",
        F.col("ocr_confidence").cast("double").alias("ocr_confidence"), F.get("barcodes", 0).alias("barcode_raw") if "barcodes" in rows.columns else F.lit("").alias("barcode_raw"), *wide,
        F.col("llm_enabled").alias("llm_called"), "parser_used", F.map_from_entries(F.transform("choices", lambda x: F.struct(x["field"], x["reason"]))).alias("selection_reasons"), "candidates",
        known("llm_requested_mode", F.lit("auto")).alias("llm_requested_mode"), known("llm_model", F.lit("")).alias("llm_model"), F.col("trigger_reasons").alias("llm_trigger_reasons"),
        *(["image"] if "image" in rows.columns else []),
    )


def provenance(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(label_id, selection_reasons, candidates): why each value was taken, and all that were proposed."""
    entry = F.struct("field", "value", "source", "confidence", "validations", "reason")
    by_field = candidates.groupBy("label_id", "field").agg(F.sort_array(F.collect_list(F.struct("source", F.to_json(entry).alias("c")))).alias("cs"))
    lists = by_field.groupBy("label_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.col("cs.c").alias("c"))))).alias("candidates"))
    reasons = selected.groupBy("label_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "reason")))).alias("selection_reasons"))
    return reasons.join(lists, "label_id")


def results(public: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """One nested extraction result for each label.

    ``public`` has the public values, ``found`` the conflicts by label, ``labels`` the
    scan's own columns: ``llm_enabled``, ``llm_mode`` and, where known, policy,
    provider, model, latency, reasons, rotations and milliseconds.
    """
    known = lambda c, default: F.coalesce(F.col(c), default) if c in labels.columns else default
    value = F.struct("value", "confidence", "source")
    taken = lambda s: F.sort_array(F.collect_list(F.when(F.col("source") == s, F.col("field"))))
    by = public.groupBy("label_id").agg(*[F.max(F.when(F.col("field") == f, value)).alias(f) for f in S.FIELDS], taken("llm").alias("from_llm"), taken("ner").alias("from_ner"))
    own = labels.select(
        "label_id", F.col("llm_enabled").alias("llm_called"), "llm_mode", known("policy", F.lit("auto")).alias("requested_mode"), known("llm_provider", F.lit("none")).alias("provider"),
        known("llm_model", F.lit("")).alias("model"), known("llm_latency_ms", F.lit(None).cast("long")).alias("latency_ms"), known("trigger_reasons", F.array().cast("array<string>")).alias("trigger_reasons"),
        known("ocr_rotations", F.lit(4)).alias("ocr_rotations_tried"), known("processing_ms", F.lit(0)).alias("processing_ms"),
    )
    rows = own.join(by, "label_id").join(found, "label_id", "left")
    llm = F.struct("requested_mode", F.col("llm_called").alias("called"), F.col("llm_mode").alias("mode"), "provider", "model", "latency_ms", "trigger_reasons", F.col("from_llm").alias("fields_from_llm"))
    ner = F.when(F.size("from_ner") > 0, F.struct(F.col("from_ner").alias("fields_from_ner")))
    conflicts = F.when(F.col("llm_called"), F.coalesce("conflicts", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.select("label_id", *S.FIELDS, "llm_called", conflicts.alias("conflicts"), "processing_ms", "llm_mode", "ocr_rotations_tried", llm.alias("llm_telemetry"), ner.alias("ner_telemetry"))
