"""Queries of the models' seams, over models that are plain arithmetic, so that SQL can say what they answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import tagging
from waybill.functions import tracking as T
from waybill.functions.text import staged
from waybill.operators import corners, evaluation, models, selection
from waybill.plans import views
from waybill.plans.queries import _JUDGED, _NEWEST, _SOURCES, _SPANS, _SURE, _TAGS, _TOKENS, _tag_case, _tags, _wide, query

PIECE = 4  # letters of a sub-word of the arithmetic tagger


def arithmetic_tagger() -> models.Tagger:
    """A tagger whose logits are small sums of a sub-word's letters."""
    k = np.arange(len(S.TAGS))

    def tag(texts: list[list[str]], most: int) -> list[tuple[list[int | None], list[list[float]]]]:
        pieces = [[(w, word[i : i + PIECE]) for w, word in enumerate(words) for i in range(0, len(word), PIECE)][: most - 2] for words in texts]
        signs = np.array([(ord(p[0]), ord(p[-1]), len(p)) for of in pieces for _, p in of]).reshape(-1, 3, 1)
        logits = ((signs[:, 0] * 7 + signs[:, 1] * 3 + signs[:, 2] * (k + 1) * 5 + k * k * 11) % 29 / 4).tolist()
        special, out, at = [1.0] + [0.0] * (len(S.TAGS) - 1), [], 0
        for of in pieces:
            out.append(([None, *(w for w, _ in of), None], [special, *logits[at : at + len(of)], special]))
            at += len(of)
        return out

    return models.Tagger("arithmetic@1", tag)


_PREDICTED = f""", words as (select label_id as id, unnest(t) as word, unnest(range(len(t))) as pos from (select label_id, regexp_extract_all(ocr_text, {_TOKENS}) as t from parcel)),
 placed as (select *, substr(word, 1, {PIECE}) as piece, coalesce(sum(ceil(len(word) / {PIECE}::double)) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) as before from words),
 scored as (select id, pos, list_transform(range({len(S.TAGS)}), lambda k: ((unicode(piece) * 7 + unicode(piece[-1]) * 3 + len(piece) * (k + 1) * 5 + k * k * 11) % 29) / 4::double) as x from placed where before < {models.MAX_PIECES - 2}),
 t as (select id, pos, [{", ".join(f"'{t}'" for t in S.TAGS)}][list_position(x, list_max(x))] as tag, 1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) as prob from scored)"""
_RANKED = """, named as (select *, row_number() over (partition by id, entity order by mean_prob desc, "start") as rn, count(*) over (partition by id, entity) - 1 as alternates from spans)"""


@query("parcel", _PREDICTED + _SPANS.replace("round(avg(prob), 6)", "avg(prob)") + _RANKED + f""", chosen as (select n.id, n.entity, n.mean_prob, n.alternates, string_agg(w.word, ' ' order by w.pos) as v
   from named n join words w on w.id = n.id and w.pos >= n."start" and w.pos < n."end" where rn = 1 group by all)
 select id as label_id, {_tag_case({t: f for f, t in S.TAG_OF.items()}, "entity")} as field, case entity when 'STATE' then upper(v) when 'TRACKING' then replace(v, ' ', '') else v end as value, round(mean_prob, 4) as confidence, alternates::int as alternates from chosen""")
def predicted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to sub-words to logits to tags to spans to values, inside each label's row."""
    rows = models.predict(views.texts(spark, sf_dir), "arithmetic tagger", arithmetic_tagger)
    return rows.select("label_id", F.explode("ner").alias("field", "p")).select("label_id", "field", "p.*")


@query(None, "with x as (select 1)" + _TAGS + _SPANS + """, other as (select id, pos, case when pos % 7 = 3 then 'O' when pos % 11 = 5 and tag like 'B-%' then 'I-' || substr(tag, 3) else tag end as tag from t),
 e2 as (select *, case when tag = 'O' then null else substr(tag, 3) end as entity from other), l2 as (select *, lag(entity) over (partition by id order by pos) as before from e2),
 s2 as (select *, sum(case when entity is not null and (tag like 'B-%' or before is distinct from entity) then 1 else 0 end) over (partition by id order by pos) as span from l2),
 spans2 as (select id, entity, min(pos) as "start", max(pos) + 1 as "end" from s2 where entity is not null group by id, span, entity),
 met as (select coalesce(a.entity, b.entity) as entity, (a.id is not null)::int as a, (b.id is not null)::int as b from spans a full join spans2 b on a.id = b.id and a.entity = b.entity and a."start" = b."start" and a."end" = b."end"),
 counted as (select coalesce(entity, 'micro') as entity, sum(a) as n, sum(b) as m, sum(a * b) as c from met group by rollup(entity))
 select entity, n::bigint as n_expected, m::bigint as n_predicted, c::bigint as n_common, round(coalesce(c / nullif(m, 0), 0), 6) as "precision", round(coalesce(c / nullif(n, 0), 0), 6) as recall, round(coalesce(2 * c / nullif(n + m, 0), 0), 6) as f1 from counted""")
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the events against the same with some left out and some begun otherwise."""
    tags = _tags(spark, sf_dir)
    left_out = F.when(F.col("pos") % 7 == 3, "O").when((F.col("pos") % 11 == 5) & F.col("tag").startswith("B-"), F.concat(F.lit("I-"), F.substring("tag", 3, 100))).otherwise(F.col("tag"))
    return tagging.span_f1(tags, tags.withColumn("tag", left_out))


def arithmetic_language_model() -> models.LanguageModel:
    """A language model that answers by the length of the text; some of its calls fail."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        size, seen = rows["ocr_text"].str.len(), rows["request"] == "vision"
        street = ("V " + size.astype(str) + " ST").where(seen, ("T " + size.astype(str) + " ST").where(size % 3 == 0, ""))
        failed = pd.Series("busy", rows.index, dtype=object).where((size % 7 == 0) & ~seen, None)
        city = pd.Series("Visible", rows.index).where(seen, pd.Series("Readable", rows.index).where(size % 2 == 0, " "))
        return pd.DataFrame({"street_address": street, "city": city, "failed": failed})

    return models.LanguageModel("arithmetic", "small", "large", answer)


@query("parcel", """, r as (select *, len(ocr_text) as n, case when form = 2 or len(ocr_text) < 70 then 'vision' else 'text' end as request, street_address = '' or form = 1 as no_street from parcel),
 a as (select *, case when request = 'vision' then 'V ' || n || ' ST' when n % 7 = 0 then street_address when n % 3 = 0 then 'T ' || n || ' ST' else street_address end as s,
   case when request = 'vision' then 'Visible' when n % 7 = 0 then city when n % 2 = 0 then 'Readable' else city end as c from r),
 b as (select *, request = 'text' and no_street and s = '' as again from a)
 select label_id, case when again then 'vision_fallback' else request end as llm_mode, (1 + again::int)::int as llm_calls, case when again then 'V ' || n || ' ST' else s end as street, case when again and c = '' then 'Visible' else c end as city,
   case when request = 'text' and n % 7 = 0 then 'call failed: busy' else '' end as llm_notes from b""")
def vision_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes, calls and filled values of a language model asked in two passes."""
    short = F.length("ocr_text") < 70
    rows = views.parcel(spark, sf_dir).withColumns({"trigger_reasons": F.filter(F.array(F.when(F.col("form") == 2, "name_single_word"), F.when(short, "ocr_text_short")), lambda x: x.isNotNull()), "street_rejected": F.col("form") == 1, "carrier": F.lit("")})
    out = models.ask(rows, "arithmetic language model", arithmetic_language_model)
    return out.select("label_id", "llm_mode", "llm_calls", F.col("llm_street_address").alias("street"), F.col("llm_city").alias("city"), "llm_notes")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels as stored labels, each with the candidates of its scan as JSON text; every ninth recorded none."""
    rows = _wide(spark, sf_dir).withColumns({"ner_version": F.concat(F.lit("v"), (F.col("label_id") % 2).cast("string"))})
    rows = staged(rows, {c: F.col(c) for c in rows.columns if c != "lines"})  # a view's expressions end here, as those of a stored table do
    return staged(selection.with_candidates(rows), {"candidates": F.when(F.col("label_id") % 9 != 0, F.to_json("candidates"))})


_OWN = _JUDGED + _NEWEST.replace("where label_id % 10 <> 0", "where label_id % 10 <> 0") + ", own as (select j.* from j join newest using (label_id) where label_id % 9 <> 0)" + _SOURCES
_RIGHT = _JUDGED[_JUDGED.index(", j as (select *, case field") + len(", j as (select *, ") : _JUDGED.index(" as correct")]
_SCORED = f", c as (select label_id, field, source, value, truth, selected, {_RIGHT} as correct from (select p.label_id, p.field, p.source, p.value, o.truth, o.correct as selected from proposed p join own o on o.label_id = p.label_id and o.field = p.field where p.value <> ''))"


@query("parcel", _OWN + _SCORED + """, s as (select field, count(*) as scorable from own group by field),
 f as (select source, field, count(*) as n, count(*) filter (correct) as n_correct, count(*) filter (correct and not selected) as beat_selected from c group by all)
 select f.*, s.scorable, round(f.n / s.scorable, 6) as coverage, round(f.n_correct / f.n, 6) as accuracy from f join s on s.field = f.field""")
def stored_candidate_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source proposed, from the candidates that scans stored."""
    return evaluation.stored_candidate_accuracy(_stored(spark, sf_dir))


@query("parcel", _OWN + _SCORED + """, v as (select label_id, 'v' || (label_id % 2) as version from parcel where ner_name <> ''),
 s as (select version, field, count(*) as scorable from own join v using (label_id) group by all),
 f as (select version, field, count(*) as n, count(*) filter (correct) as n_correct, count(*) filter (correct and not selected) as beat_selected from c join v using (label_id) where source = 'ner' group by all)
 select f.*, s.scorable, round(f.n / s.scorable, 6) as coverage, round(f.n_correct / f.n, 6) as accuracy from f join s on s.field = f.field and s.version = f.version""")
def stored_ner_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagger's stored candidates by the version that made them."""
    return evaluation.stored_accuracy_by_version(_stored(spark, sf_dir))


@query("parcel", _SOURCES + f""", x as (select p.*, q.ocr_text, q.confidence as own, q.ner_confidence from proposed p join parcel q using (label_id))
 select label_id, field, source, value, (case source when 'rule' then coalesce(own, 0) when 'ner' then ner_confidence when 'llm' then case when field = 'carrier' then 0 else {_SURE} end end)::double as confidence, case source when 'rule' then 'view' when 'llm' then 'llm' else 'v' || (label_id % 2) end as reason from x""")
def stored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate as it is stored, out of the map of its label."""
    rows = _wide(spark, sf_dir).withColumns({"ner_version": F.concat(F.lit("v"), (F.col("label_id") % 2).cast("string"))})
    each = selection.with_candidates(rows).select("label_id", F.explode("candidates").alias("of", "listed")).select("label_id", F.inline("listed"))
    return each.select("label_id", "field", "source", "value", "confidence", "reason")


#: Four points of each event, in one of four orders, some of them no quadrilateral.
_CONTOURS = """select event_id, [{x: (user_id % 97)::double, y: (event_id % 89)::double}, {x: (user_id % 97 + event_id % 211)::double, y: (event_id % 89 + user_id % 13)::double},
  {x: (user_id % 97 + event_id % 199)::double, y: (event_id % 89 + event_id % 173)::double}, {x: (user_id % 97 + user_id % 11)::double, y: (event_id % 89 + event_id % 181)::double}] as raw from events"""


def _contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, e, u = F.col("user_id") % 97, F.col("event_id") % 89, F.col("event_id"), F.col("user_id")
    raw = F.array(point(x, y), point(x + e % 211, y + u % 13), point(x + e % 199, y + e % 173), point(x + u % 11, y + e % 181))
    shift = (e % 4).cast("int")
    turned = F.concat(F.slice(raw, shift + 1, 4), F.slice(raw, 1, shift))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", turned.alias("points"))


@query(None, f"""with c as ({_CONTOURS}), t as (select event_id, raw[(event_id % 4 + 1)::int:] || raw[1:(event_id % 4)::int] as p from c),
 f as (select event_id, p, list_transform(p, lambda q: q.x + q.y) as s, list_transform(p, lambda q: q.y - q.x) as d from t),
 i as (select event_id, p, [list_position(s, list_min(s)), list_position(d, list_min(d)), list_position(s, list_max(s)), list_position(d, list_max(d))] as k from f),
 o as (select event_id, list_transform(k, lambda j: p[j]) as q from i where len(list_distinct(k)) = 4),
 m as (select event_id, q, list_sum(list_transform(q, lambda a: a.x)) / 4 as cx, list_sum(list_transform(q, lambda a: a.y)) / 4 as cy from o),
 w as (select event_id, list_transform(q, lambda a: least(greatest(cx + (a.x - cx) * {corners.MARGIN}, 0), 255)) as x, list_transform(q, lambda a: least(greatest(cy + (a.y - cy) * {corners.MARGIN}, 0), 191)) as y from m),
 z as (select event_id, x, y, greatest(sqrt((x[3] - x[4]) ** 2 + (y[3] - y[4]) ** 2), sqrt((x[2] - x[1]) ** 2 + (y[2] - y[1]) ** 2)) as a, greatest(sqrt((x[2] - x[3]) ** 2 + (y[2] - y[3]) ** 2), sqrt((x[1] - x[4]) ** 2 + (y[1] - y[4]) ** 2)) as b from w)
 select event_id, round(x[1], 6) as left_x, round(y[1], 6) as top_y, round_even(a, 0)::int as width, round_even(b, 0)::int as height from z where round_even(a, 0) >= {corners.LEAST_SIDE} and round_even(b, 0) >= {corners.LEAST_SIDE}""")
def crop_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in order, with their margin, and sizes of the crops of contours made from the events."""
    plan = corners.crop_plan(F.col("points"), F.lit(256), F.lit(192))
    rows = _contours(spark, sf_dir).select("event_id", plan.alias("c")).where("c is not null")
    first = F.get("c.corners", 0)
    return rows.select("event_id", F.round(first["x"], 6).alias("left_x"), F.round(first["y"], 6).alias("top_y"), F.col("c.width").alias("width"), F.col("c.height").alias("height"))


@query("parcel", """, a as (select label_id, processed_at, tracking_number, coalesce(nullif(tracking_number, ''), label_id::varchar) as k from parcel where label_id % 10 <> 0)
 select label_id, k as "key" from (select *, row_number() over (partition by k order by processed_at desc, label_id) as rn from a) where rn = 1""")
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated label that training takes of each parcel; labels without a number are parcels of their own."""
    return evaluation.training_labels(views.labels(spark, sf_dir)).select("label_id", F.coalesce(F.nullif("tracking_number", F.lit("")), F.col("label_id").cast("string")).alias("key"))


#: UPS numbers with a right check digit, some of whose digits were read as letters; and USPS numbers among them.
_DAMAGED = """select o_orderkey as label_id, o_orderkey % 4 as kind, '999AA1' || lpad(cast(o_orderkey as varchar(20)), 9, '0') as body from orders"""
_WEIGHED = "list_sum(list_transform(range(15), lambda i: (case when regexp_matches({x}[i + 1], '[0-9]') then ascii({x}[i + 1]) - 48 else (ascii({x}[i + 1]) - 63) % 10 end) * (1 + i % 2)))"
_FORM = "'1Z[A-Z0-9]{16}'"


def _right(t: str) -> str:
    """SQL of whether a cleaned number has the UPS form and the right check digit."""
    return f"(regexp_full_match({t}, {_FORM}) and regexp_matches({t}[18], '[0-9]') and (10 - {_WEIGHED.format(x=t + '[3:]')} % 10) % 10 = ascii({t}[18]) - 48)"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("label_id"), (F.col("o_orderkey") % 4).alias("kind"), F.concat(F.lit("999AA1"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("body"))
    places = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr("body", i, F.lit(1)))
    value = F.transform(places, lambda c, i: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise((F.ascii(c) - 63) % 10) * (1 + i % 2))
    digit = (10 - F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10) % 10
    number = F.concat(F.lit("1Z"), "body", digit.cast("string"))
    return rows.select("label_id", F.when(F.col("kind") == 0, number).when(F.col("kind") == 1, F.translate(number, "0158", "OISB")).when(F.col("kind") == 2, F.concat(F.lower(F.substring(number, 1, 17)), F.lit(" x"))).otherwise(F.concat(F.lit("94 "), F.translate(F.lpad("label_id", 20, "0"), "06", "oG"))).alias("read"))


@query(None, f"""with d as ({_DAMAGED}), n as (select *, '1Z' || body || ((10 - {_WEIGHED.format(x='body')} % 10) % 10)::varchar as number from d),
 r as (select label_id, case kind when 0 then number when 1 then translate(number, '0158', 'OISB') when 2 then lower(number[:17]) || ' x' else '94 ' || translate(lpad(label_id::varchar, 20, '0'), '06', 'oG') end as read from n),
 c as (select *, regexp_replace(regexp_replace(regexp_replace(upper(read), '[^A-Z0-9]', '', 'g'), '^1BA', 'TBA'), '^1LSDO', '1LSD0') as t from r),
 f as (select *, t[:2] || translate(t[3:], 'OILSBG', '011586') as fixed, translate(t, 'OILSBG', '011586') as all_digits from c)
 select label_id, case when regexp_full_match(t, {_FORM}) and not {_right('t')} and {_right('fixed')} then fixed else t end as ups, case when regexp_full_match(all_digits, '(?:9[1-5]|56)\\d*') then all_digits else t end as usps,
  regexp_full_match(t, '(?:9[1-5]|56)\\d{{18,}}') as is_usps, {_right('t')} as right_digit from f""")
def numbers_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged numbers as a UPS and as a USPS number, where the damage is undone by the check digit or the form."""
    read = F.col("read")
    return _damaged(spark, sf_dir).select("label_id", T.clean_ups(read).alias("ups"), T.clean_usps(read).alias("usps"), T.valid_usps(read).alias("is_usps"), T.ups_check_digit(T.clean(read)).alias("right_digit"))
