"""Derived views: the driver's tables have no labels, so queries build them first.

The SQL below runs unchanged on Spark and on DuckDB; tables are named in braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.text import lines, staged

_FIELD = "case event_id % 7 " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(S.FIELDS)) + " end"

SCAN = f"""select event_id as label_id, ts as processed_at, case when user_id % 11 = 0 then '' else cast(user_id as string) end as tracking_number, {_FIELD} as field,
  case event_type when 'view' then 'rule' when 'click' then 'agreement' when 'purchase' then 'barcode' when 'signup' then 'llm' else '' end as source,
  case when event_id % 13 = 0 then null when value > 100 then cast(1 as double) else value / 100 end as confidence,
  case event_id % 3 when 0 then '' when 1 then 'checksum_valid=True' else 'checksum_valid=False' end as sig, (event_id * 7919) % 10 < 7 as correct
from {{events}}"""

SAMPLE = """select d.doc_id as label_id, d.lang as field, d.source as source, case when l.toxic = 1 then 'clean=False' else 'clean=True' end as sig, l.quality = 1 as correct,
  case when d.doc_id % 13 = 0 then null else cast(d.doc_id % 100 as double) / 100 end as confidence
from {labels} l join {documents} d on l.doc_id = d.doc_id"""

_PICK = lambda names, by: f"split_part('{'|'.join(names)}', '|', cast({by} % {len(names)} as int) + 1)"
_PAD = lambda x, n, c: f"lpad(cast({x} as string), {n}, '{c}')"
#: Invented people and places.
FIRST, LAST = ("Anna", "Boris", "Carla", "Dmitri", "Evelyn", "Farid", "Greta"), ("Stone", "Ohara", "Lindqvist", "Marsh", "Nguyen")
STREETS, CITIES, STATES = ("OAK", "ELM", "MAIN", "LAKE"), ("Springfield", "Riverton", "Fairview"), ("PA", "OH", "NY", "WA")

_ORDERS = "{orders} join {customer} on o_custkey = c_custkey"
_BASE = f"""select o_orderkey as label_id, o_orderdate as processed_at, o_orderkey % 5 as form, o_orderkey % 6 as kind, o_orderkey % 4 as origin,
  {_PICK(FIRST, "o_custkey")} as given, {_PICK(LAST, "(o_custkey + o_orderkey)")} as family, cast(o_custkey % 900 + 1 as string) as house, {_PICK(STREETS, "o_orderkey")} as road,
  {_PICK(CITIES, "o_custkey")} as town, {_PICK(STATES, "o_custkey")} as region, {_PAD("o_custkey % 90000 + 10000", 5, "0")} as code,
  case o_orderkey % 6 when 0 then '9400' || {_PAD("o_orderkey", 18, "0")} when 1 then '1Z999AA1' || {_PAD("o_orderkey", 10, "0")} when 2 then 'TBA' || {_PAD("o_orderkey", 12, "0")}
    when 3 then {_PAD("o_orderkey", 12, "4")} when 4 then 'SPX' || {_PAD("o_orderkey", 12, "0")} else '' end as number
from {_ORDERS}"""

PARCEL = f"""select label_id, processed_at, form, kind, origin, number as tracking_number, given || ' ' || family as true_name,
  case form when 0 then given || ' ' || family when 1 then family || ', ' || given when 2 then given || family when 3 then given || ' Q ' || family else '' end as recipient_name,
  house || ' ' || road || ' STREET' as true_street,
  case form when 0 then house || ' ' || road || ' ST' when 1 then house || ' ' || road || ' ST.' when 2 then 'APT ' || house || ' ' || road || ' STREET' when 3 then road || ' STREET' else '' end as street_address,
  town as true_city, case when form = 4 then '' when form = 1 then upper(town) else town end as city, region as true_state, case when form = 2 then 'P4' else region end as state,
  case when form = 3 then code || '-1234' else code end as true_zip, case when form = 2 then '' else code end as zip_code, number as true_number,
  case origin when 0 then 'rule' when 1 then 'llm' when 2 then 'agreement' else 'dataset' end as source,
  case when form = 4 then null else cast(form as double) / 5 + cast(0.15 as double) end as confidence,
  case kind when 0 then 'USPS DELIVER TO' when 1 then 'SHIP TO' when 2 then 'DELIVER TO' when 3 then 'TO: ' || given || ' ' || family else 'PRIORITY MAIL' end || chr(10) ||
  given || ' ' || family || chr(10) || house || ' ' || road || ' ST' || chr(10) || town || ' ' || region || ' ' || code || chr(10) || 'USPS TRACKING #' || chr(10) || number as ocr_text,
  case when form = 4 then given || ' ' || family when form = 1 then given || ' ' || family else '' end as llm_name,
  case when label_id % 3 = 0 then given || ' ' || family when label_id % 3 = 1 then upper(family) || ' ' || house else '' end as ner_name, cast(label_id % 100 as double) / 100 as ner_confidence,
  case label_id % 3 when 0 then 'vision' when 1 then 'text' else 'none' end as llm_mode
from ({_BASE}) b"""

#: Lines as a reader returns them: names, streets, places, markers and furniture, some of them damaged.
_LINES = (
    "given || ' ' || family", "family || ', ' || given", "'TO: ' || given || ' ' || family", "'SHIP TO: |'", "'~ ' || house || ' ' || road || ' ST ;x'",
    "house || '. ' || road || ' AVENUE APT 4'", "'N 12 ' || road || ' RD'", "house || ' ' || road || ' §'", "house || ' ' || road || ' ST ' || chr(123) || 'zz'",
    "town || ' ' || region || ' ' || code", "'ZIP ' || code", "'USPS TRACKING #'", "'DELIVER TO'", "'USPS rQ TO'", "'VER  TO '",
    "given || ' ' || family || ' CARRIER - LEAVE IF NO RESPONSE x'", "house || ' ' || chr(92) || 'IVERSITY BLVD'", "'1@5 ' || road || ' LN'", "'AUB # ' || house",
    "code || '-1234'", "'|  ' || given || '  ' || family || ' |'", "'Dr. ' || given || ' Q ' || family", "'MEDIA MAIL'", "'PO BOX ' || house", "'SENDER ' || family || ' LLC'",
    "house || ' ' || road || ' 5T'", "house || ' ' || road || ' blvd'", "'12@4 PRRLISLE DR'", "' 1LSDO23O4 ' || house", "'ab'", "'--- __'",
)
LINE = "select label_id, case label_id % " + str(len(_LINES)) + " " + " ".join(f"when {i} then {x}" for i, x in enumerate(_LINES)) + f" end as line from ({_BASE}) b"

FRAMES = """select cast(user_id % 3 as string) as stream, ts, event_id as frame_no, event_type in ('signup', 'view') as detected from {events}"""


def _build(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(spark, sf_dir, SCAN, "events")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(spark, sf_dir, SAMPLE, "labels", "documents")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(spark, sf_dir, FRAMES, "events")


def _dealt_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over orders in even parts: a label costs up to a millisecond, and a file is read in as few parts as it has row groups.

    Only the three columns that the views read are moved, before any text is made of them.
    """
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(sql.replace(_ORDERS, "{dealt}"), dealt=rows.repartition(parts, "o_orderkey"))


def parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt_orders(spark, sf_dir, PARCEL)


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt_orders(spark, sf_dir, LINE)


TRUTH = {"recipient_name": "true_name", "street_address": "true_street", "city": "true_city", "state": "true_state", "zip_code": "true_zip", "tracking_number": "true_number"}


def truth() -> Column:
    """A parcel's annotation: field to true value."""
    return F.create_map(*[x for f, t in TRUTH.items() for x in (F.lit(f), F.col(t))])


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(label_id, ocr_text) of the parcels and further columns of theirs, made once a row and no others beside them."""
    rows = parcel(spark, sf_dir).select("label_id", "ocr_text", *columns)
    return staged(rows, {c: F.col(c) for c in rows.columns})


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents in even parts: a text costs milliseconds to judge, and a file is read in as few parts as it has row groups."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *columns)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels as stored labels: values, sources, confidences and a partial annotation.

    The parcel's own expressions end at a generator, as at a table: the optimizer would
    otherwise carry each of them through every filter that follows, for seconds a stage.
    """
    rows = parcel(spark, sf_dir)
    rows = staged(rows, {c: F.col(c) for c in rows.columns})
    out = rows.withColumn("ground_truth", F.when(F.col("label_id") % 10 != 0, truth())).withColumn("carrier", F.lit("")).withColumn("lines", lines(F.col("ocr_text")))
    return out.withColumns({c: v for f in S.FIELDS for c, v in ((f"{f}_source", F.col("source")), (f"{f}_confidence", F.col("confidence")))})
