"""Models on the way of a scan: a language model asked about a label, and a tagger of its words.

A model is opened on the worker, at the first batch that needs it, once for each
process and key; if opening fails, that source is off for the life of the process
and the scan goes on without it.  Both models are columns: a batch goes in, a
struct for each row comes out, and no row is shuffled or joined.

The language model is asked in two passes inside the task.  The first pass asks
about the text, or about the image where the triggers or the policy say so; the
second asks about the image for those rows alone whose text answer has no street,
where the rules have none either, and fills only what is still blank.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions import tagging
from waybill.functions.text import blank, staged, strip

# Fixed value: sub-words that a tagger reads of a text, its special ones included.
MAX_PIECES = 256
ANSWER = "struct<llm_enabled boolean, llm_provider string, llm_model string, llm_notes string, llm_mode string, llm_calls int, " + ", ".join(f"llm_{f} string" for f in S.FIELDS) + ">"
PIECES = "struct<word_ids array<int>, logits array<array<double>>>"


@dataclass(frozen=True)
class LanguageModel:
    """``answer`` takes rows (request, ocr_text, tracking_number, image) and returns, row by row, values of fields, and ``failed`` where a call gave none."""

    provider: str
    text_model: str
    vision_model: str
    answer: Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Tagger:
    """``tag`` takes texts of words and the most sub-words, and returns (word_ids, logits) of each; word_ids are None for special sub-words."""

    version: str
    tag: Callable[[list[list[str]], int], list[tuple[list[int | None], list[list[float]]]]]


def opened(key: str, opener: Callable[[], Any]) -> Any:
    """The model of a key in this process; None for good once opening it has failed."""
    held = sys.modules.setdefault("_waybill_opened_models", ModuleType("_waybill_opened_models")).__dict__
    if key not in held:
        try:
            held[key] = opener()
        except Exception:  # noqa: BLE001  a scan never fails for want of a model
            held[key] = None
    return held[key]


def _answers(model: LanguageModel, rows: pd.DataFrame) -> pd.DataFrame:
    """The values for each row, with ``failed``, and ``raised`` where the call broke; a batch that breaks is asked row by row."""
    columns = [*S.FIELDS, "failed"]
    try:
        return model.answer(rows).reindex(columns=columns).set_axis(rows.index).assign(raised=False)
    except Exception:  # noqa: BLE001
        if len(rows) == 1:
            return pd.DataFrame(None, rows.index, columns, dtype=object).assign(raised=True)
        return pd.concat([_answers(model, rows.iloc[[i]]) for i in range(len(rows))])


def _text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v.strip() if isinstance(v, str) else "").astype(object)


def _completed(rule: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """A model's values, and the rules' where it has none."""
    return pd.DataFrame({f: _text(found[f]).where(_text(found[f]) != "", rule[f]) for f in S.FIELDS})


def _respond(batch: pd.DataFrame, model: LanguageModel | None) -> pd.DataFrame:
    rule = pd.DataFrame({f: _text(batch[f]) for f in S.FIELDS})
    values, request = rule.copy(), batch["request"]
    out = pd.DataFrame({"llm_enabled": False, "llm_provider": "none", "llm_model": "", "llm_notes": "", "llm_mode": "none", "llm_calls": 0}, index=batch.index)
    out.loc[request == "none", "llm_notes"] = "off by policy"
    asked = request != "none"
    out.loc[asked, "llm_mode"] = request[asked]
    if model is None:
        out.loc[asked, "llm_notes"] = "no model configured"
        return _answered(out, values)
    empty = asked & (request == "text") & (_text(batch["ocr_text"]) == "")
    out.loc[asked, ["llm_enabled", "llm_provider"]] = [True, model.provider]
    out.loc[empty, "llm_notes"] = "no text to ask about"
    first = batch[asked & ~empty]
    if len(first):
        found = _answers(model, first)
        out.loc[first.index, "llm_calls"] = 1
        out.loc[first.index, "llm_model"] = first["request"].map({"text": model.text_model, "vision": model.vision_model})
        values.loc[first.index] = _completed(rule.loc[first.index], found)
        failed, raised = found.index[found["failed"].notna()], found.index[found["raised"].astype(bool)]
        values.loc[failed] = rule.loc[failed]
        out.loc[failed, "llm_notes"] = "call failed: " + found.loc[failed, "failed"].astype(str)
        values.loc[raised] = rule.loc[raised]
        out.loc[raised, ["llm_enabled", "llm_provider", "llm_model", "llm_mode"]] = [False, "none", "", "none"]
        out.loc[raised, "llm_notes"] = "call broke"
    again = (out["llm_mode"] == "text") & out["llm_enabled"] & batch["no_street"].fillna(False).astype(bool) & (values["street_address"] == "")
    second = batch[again].assign(request="vision")
    if len(second):
        found = _answers(model, second)
        out.loc[second.index, "llm_calls"] += 1
        whole = found.index[~found["raised"].astype(bool)]
        filled = _completed(rule.loc[whole], found.loc[whole])
        lost = found.loc[whole].index[found.loc[whole, "failed"].notna()]
        filled.loc[lost] = rule.loc[lost]
        for f in S.FIELDS:
            values.loc[whole, f] = values.loc[whole, f].where(values.loc[whole, f] != "", filled[f])
        out.loc[whole, "llm_mode"] = "vision_fallback"
    return _answered(out, values)


def _answered(out: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([out.astype({"llm_calls": "int32", "llm_enabled": bool}), values.add_prefix("llm_")], axis=1)


def requested(policy: str, reasons: Column) -> Column:
    """What the first pass asks about: nothing, the text, or the image."""
    if policy == "off":
        return F.lit("none")
    return F.lit("vision") if policy == "force_vision" else F.when(F.size(reasons) > 0, "vision").otherwise("text")


def _unasked() -> dict[str, Column]:
    """What ``_respond`` gives where no model is to be asked: the rules' values, without a call and without a Python worker."""
    out = {"enabled": F.lit(False), "provider": F.lit("none"), "model": F.lit(""), "notes": F.lit("off by policy"), "mode": F.lit("none"), "calls": F.lit(0)}
    return out | {f: F.coalesce(strip(F.col(f)), F.lit("")) for f in S.FIELDS}


def ask(rows: DataFrame, key: str | None = None, opener: Callable[[], LanguageModel | None] | None = None, policy: str = "auto") -> DataFrame:
    """``rows`` with the model's values (``llm_<field>``), whether it was there, how it was asked, how often, and notes.

    ``rows`` has the fields as the rules read them, ``trigger_reasons``,
    ``street_rejected``, ``ocr_text`` and, for a model that sees it, ``image``.
    Without an opener the model is off.
    """
    kept = [c for c in rows.columns if not c.startswith("llm_")]
    if opener is None or policy == "off":
        return rows.select(*kept, *[c.alias(f"llm_{n}") for n, c in _unasked().items()])

    @F.pandas_udf(ANSWER)
    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model = None if (batch["request"] == "none").all() else opened(str(key), opener)
            yield _respond(batch.reset_index(drop=True), model)

    street = blank(F.col("street_address")) | F.coalesce("street_rejected", F.lit(False))
    request = requested(policy, F.col("trigger_reasons"))
    more = ["image"] if "image" in rows.columns else []
    asked = F.struct(request.alias("request"), street.alias("no_street"), "ocr_text", *more, *S.FIELDS)
    # Asking costs money and may answer otherwise next time, so Spark must not repeat it.
    return rows.select(*kept, answered.asNondeterministic()(asked).alias("_llm")).select(*kept, "_llm.*")


def predict(rows: DataFrame, key: str, opener: Callable[[], Tagger], max_pieces: int = MAX_PIECES) -> DataFrame:
    """``rows`` with ``ner``, a map of field to (value, confidence, alternates), and ``ner_version``.

    Sub-words become words by the first of each, words become spans, and of a field's
    spans the likeliest gives the value.  Words that were cut off, and texts that the
    tagger fails on, have no prediction.
    """

    def one(model: Tagger, words: list[str]) -> tuple[list[int | None], list[list[float]]] | None:
        try:
            return model.tag([words], max_pieces)[0]
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf("struct<word_ids array<int>, logits array<array<double>>, version string>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [list(t) if t is not None else [] for t in batch]
            full = [t for t in texts if t]
            model = opened(key, opener) if full else None
            try:
                found = iter(model.tag(full, max_pieces) if model else [None] * len(full))
            except Exception:  # noqa: BLE001
                found = iter([one(model, t) for t in full])
            each = [next(found) if t else None for t in texts]
            yield pd.DataFrame({"word_ids": [None if x is None else list(x[0]) for x in each], "logits": [None if x is None else x[1] for x in each], "version": model.version if model else None}, dtype=object)

    rows = staged(rows, {"_tokens": tagging.tokenize(F.col("ocr_text"))})
    rows = rows.withColumn("_pieces", tagged("_tokens"))
    rows = staged(rows, {"_tags": tagging.word_tags(F.size("_tokens"), F.col("_pieces.word_ids"), F.col("_pieces.logits")), "ner_version": F.col("_pieces.version")})
    rows = staged(rows, {"_spans": tagging.spans_of(F.col("_tags"))})
    rows = staged(rows, {"ner": tagging.fields_of_spans(F.col("_tokens"), F.col("_spans"))})
    return rows.drop("_tokens", "_pieces", "_tags", "_spans")
