"""The whole way from decoded texts to selected fields, with seams for the models.

``texts`` has (label_id, ocr_text, ocr_confidence, barcodes array<string>) and,
for a language model that sees it, ``image``.  Everything happens inside a label's
row: stages that each compute their columns once, the models as columns, and the
fields side by side; there is no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import scoring, text
from waybill.functions import tracking as T
from waybill.operators import models, parse, selection


@dataclass(frozen=True)
class Seams:
    """How the models are opened on the workers, each with the key under which a process holds it; None for none."""

    llm: Callable[[], models.LanguageModel | None] | None = None
    llm_key: str = "llm"
    tagger: Callable[[], models.Tagger] | None = None
    tagger_key: str = "tagger"


def resolve_policy(skip_llm: bool = False, policy: str | None = None) -> str:
    """``off`` when skipped, else ``auto`` or what is asked for; contradictions raise."""
    if policy is not None and policy not in S.POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if skip_llm and policy not in (None, "off"):
        raise ValueError(f"skip_llm contradicts policy {policy!r}")
    return policy or ("off" if skip_llm else "auto")


def dealt(texts: DataFrame) -> DataFrame:
    """The same rows in even parts: a label costs a millisecond to parse and microseconds to move, and files are read in few parts."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label_id")


def _number(lines: Column, barcodes: Column) -> Column:
    """The label's number and its source."""
    def arbitrated(x: Column) -> Column:
        number, _ = T.arbitrate(x["barcode"], x["ocr"], F.lit(""), lines)
        return text.let(number, lambda n: F.struct(n.alias("tracking_number"), T.origin(n, x["barcode"], x["ocr"]).alias("tracking_source")))

    return text.let(F.struct(T.from_barcodes(barcodes).alias("barcode"), T.tracking_in_lines(lines).alias("ocr")), arbitrated)


def _judged(value: dict[str, Column], ocr_text: Column) -> Column:
    """The number's carrier and check digit, and the confidences."""
    number, plain = value["tracking_number"], scoring.confidences(value)

    def scored(carrier: Column, checksum: Column) -> Column:
        all_ = {f: plain[f] for f in S.SCORED} | {"tracking_number": scoring.penalised(plain["tracking_number"], checksum)}
        return F.struct(carrier.alias("carrier"), checksum.alias("checksum"), *[v.alias(f"{f}_confidence") for f, v in all_.items()])

    return text.let(T.carrier_in_context(number, ocr_text), lambda c: text.let(T.checksum(number, c), lambda k: scored(c, k)))


def extract(texts: DataFrame) -> DataFrame:
    """Rule extraction: lines, number, carrier, address, confidences, warnings and triggers."""
    rows = text.staged(texts, {"lines": text.lines(F.col("ocr_text"))})
    rows = text.together(rows, _number(F.col("lines"), F.col("barcodes")), ("tracking_number", "tracking_source"))
    rows = parse.normalise(parse.parse(rows))
    value = {f: F.col(f) for f in S.SCORED}
    rows = text.together(rows, _judged(value, F.col("ocr_text")), ("carrier", "checksum", *(f"{f}_confidence" for f in S.SCORED)))
    flags = {n: F.col(n) for n in ("name_looks_like_street", "name_is_sender_artifact", "name_single_word", "name_looks_like_org")}
    # Columns of their own, not made where nothing reads them.
    apart = {"overall_confidence": scoring.confidences(value)["overall"], "warnings": scoring.warnings(value, F.col("checksum")), "trigger_reasons": scoring.triggers(value, F.col("ocr_confidence"), F.col("ocr_text"), F.col("street_rejected"), flags)}
    inside = lambda c: text.let(F.lit(0), lambda _: c)
    return rows.withColumns({name: inside(c) for name, c in apart.items()})


def asked(texts: DataFrame, seams: Seams = Seams(), policy: str = "auto") -> DataFrame:
    """The extraction with the models' values beside it."""
    rows = models.ask(extract(texts), seams.llm_key, seams.llm, resolve_policy(policy=policy))
    return rows if seams.tagger is None else models.predict(rows, seams.tagger_key, seams.tagger)


def scan(texts: DataFrame, seams: Seams = Seams(), policy: str = "auto", select: selection.Policy = selection.base_policy) -> DataFrame:
    """(label_id, field, value, confidence, source, reason) for every text and field."""
    pivoted = selection.sources_of(asked(texts, seams, policy), carried=selection.CARRIED)
    return selection.public_values(selection.select(pivoted, select, selection.CARRIED))
