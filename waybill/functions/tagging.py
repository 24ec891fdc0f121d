"""Tokens, tags and spans for training and decoding a field tagger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.text import extract_all, let, staged

TOKEN = r"[A-Za-z0-9#&'.\-]+|[^\p{L}\p{N}_\s]"


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters, digits and ``#&'.-``, or single other marks; accented letters are no token."""
    return extract_all(F.coalesce(text, F.lit("")), TOKEN)


def plain(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}_]", ""))


def decode(tags: DataFrame) -> DataFrame:
    """Spans of (id, pos, tag, prob): an inside tag that continues nothing opens a span, an unknown entity is outside.

    Runs are found by a running count of span starts for each id.
    """
    known = F.array(*[F.lit(t) for t in dict.fromkeys(t[2:] for t in S.TAGS if t != "O")])
    entity = F.when(F.col("tag").rlike("^[BI]-") & F.array_contains(known, F.substring("tag", 3, 100)), F.substring("tag", 3, 100))
    order = Window.partitionBy("id").orderBy("pos")
    rows = tags.withColumn("entity", entity).withColumn("before", F.lag("entity").over(order))
    starts = F.col("entity").isNotNull() & (F.startswith("tag", F.lit("B-")) | ~F.col("before").eqNullSafe(F.col("entity")))
    rows = rows.withColumn("span", F.sum(starts.cast("int")).over(order)).where("entity is not null")
    return rows.groupBy("id", "span", "entity").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.round(F.avg("prob"), 6).alias("mean_prob")).drop("span")


def best(spans: DataFrame) -> DataFrame:
    """The likeliest span of each entity, the first of equal ones."""
    top = F.max_by(F.struct("start", "end", "mean_prob"), F.struct(F.col("mean_prob"), -F.col("start")))
    return spans.groupBy("id", "entity").agg(top.alias("s")).select("id", "entity", "s.*")


def value_of(tokens: Column, entity: Column, start: Column, end: Column) -> Column:
    words = F.slice(tokens, start.cast("int") + 1, (end - start).cast("int"))
    return F.when(entity == "TRACKING", F.array_join(words, "")).when(entity == "STATE", F.upper(F.array_join(words, " "))).otherwise(F.array_join(words, " "))


def find_span(tokens: Column, value: Column) -> Column:
    """First place of the value's tokens: exact, then without case, then without punctuation; null if absent."""
    return let(_forms(tokens), lambda hay: _span(hay, _joined(tokenize(value))))


def _forms(tokens: Column) -> Column:
    """Tokens as texts in which a blank stands before and after each, as no token has one: as they are, in lower case, without marks."""
    return let(_joined(tokens), _cased)


def _joined(tokens: Column) -> Column:
    return let(F.array_join(tokens, " "), lambda x: F.when(x == "", " ").otherwise(F.concat(F.lit(" "), x, F.lit(" "))))  # no token is empty


def _plain(exact: Column) -> Column:
    return F.lower(F.regexp_replace(exact, r"[^\p{L}\p{N}_ ]+", ""))


def _cased(exact: Column) -> Column:
    return F.struct(exact.alias("exact"), F.lower(exact).alias("lower"), _plain(exact).alias("plain"))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _place(side: Column, needle: Column, otherwise: Column) -> Column:
    """Start and end of the needle's tokens in the side, each found once; else the other way, which is not gone where this one finds."""
    def found(at: Column) -> Column:
        start = let(_blanks(F.left(side, at - 1)), lambda n: F.struct(n.alias("start"), (n + _blanks(needle) - 1).alias("end")))
        return F.when(at > 0, start).otherwise(otherwise)

    return F.when(needle == " ", otherwise).otherwise(let(F.position(needle, side), found))


def _span(hay: Column, wanted: Column) -> Column:
    def placed(exact: Column) -> Column:
        bare = let(F.regexp_replace(_plain(exact), " +", " "), lambda x: _place(hay["plain"], x, F.lit(None).cast("struct<start:int,end:int>")))
        return _place(hay["exact"], exact, let(F.lower(exact), lambda x: _place(hay["lower"], x, bare)))

    return let(wanted, placed)


def encode(rows: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(id, tokens, labels) and the carried columns from (id, text, truth): longest values first, nothing overwritten.

    Values claim positions; a position goes to the claim of the longest value, and a
    shorter value keeps those of its positions that are left.  All of it happens inside
    the row, the tokens of the text and of each value being found once; there is no shuffle.
    """
    rows = staged(rows.select("id", "text", "truth", *[c for c in carried if c not in ("text", "truth")]), {"tokens": tokenize(F.col("text"))})
    rows = staged(rows, {"_hay": _forms(F.col("tokens"))})

    def claim(i: int, f: str) -> Column:
        begins, goes_on = F.lit(f"B-{S.TAG_OF[f]}").alias("begins"), F.lit(f"{'I' if S.TAG_OF[f] in S.LONG_TAGS else 'B'}-{S.TAG_OF[f]}").alias("goes_on")
        won = lambda v, s: F.when(s.isNotNull(), F.struct((-F.length(v)).alias("rank"), F.lit(i).alias("no"), s["start"].alias("first"), s["end"].alias("end"), begins, goes_on))
        return let(F.element_at("truth", F.lit(f)), lambda v: F.when(v.isNotNull(), let(_span(F.col("_hay"), _joined(tokenize(v))), lambda s: won(v, s))))

    claims = F.array_sort(F.filter(F.array(*[claim(i, f) for i, f in enumerate(S.FIELDS)]), lambda c: c.isNotNull()))
    rows = staged(rows, {"_claims": claims})

    def label(i: Column) -> Column:
        won = F.get(F.filter("_claims", lambda c: (c["first"] <= i) & (i < c["end"])), 0)
        return let(won, lambda c: F.when(c.isNull(), "O").when(c["first"] == i, c["begins"]).otherwise(c["goes_on"]))

    return rows.select("id", "tokens", F.transform("tokens", lambda t, i: label(i)).alias("labels"), *carried)


def match_rates(encoded: DataFrame) -> DataFrame:
    """By field: annotated values, and those whose tag occurs in the labels; ``encoded`` carries its ``truth``."""
    tag_of = F.create_map(*[x for f, t in S.TAG_OF.items() for x in (F.lit(f), F.lit(t))])
    each = encoded.select("labels", F.explode("truth").alias("field", "value")).where(F.coalesce("value", F.lit("")) != "")
    return each.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.array_contains("labels", F.concat(F.lit("B-"), F.element_at(tag_of, F.col("field"))))).alias("found"))


def token_accuracy(rows: DataFrame) -> DataFrame:
    """Share of equal tags over (predicted, expected) arrays; -100 and missing ones are left out."""
    pairs = rows.select(F.inline(F.arrays_zip("predicted", "expected"))).where("expected is not null and expected <> '-100'")
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("expected")).alias("n_correct"))


def word_tags(n_words: Column, word_ids: Column, logits: Column) -> Column:
    """(tag, prob) of each word: that of its first sub-word, or outside with 0 where it was cut off."""
    at = lambda w: F.array_position(word_ids, w.cast("int")).cast("int")
    tags = F.array(*[F.lit(t) for t in S.TAGS])
    share = lambda x, top: 1 / F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))  # noqa: E731  the softmax of the greatest
    best = lambda x, top: F.struct(F.coalesce(F.get(tags, F.array_position(x, top).cast("int") - 1), F.lit("O")).alias("tag"), F.coalesce(share(x, top), F.lit(0.0)).alias("prob"))
    one = lambda w: let(F.get(logits, at(w) - 1), lambda x: let(F.array_max(x), lambda top: best(x, top)))
    return F.when(n_words > 0, F.transform(F.sequence(F.lit(0), n_words - 1), one)).otherwise(F.array().cast("array<struct<tag:string,prob:double>>"))


def word_predictions(rows: DataFrame) -> DataFrame:
    """(id, pos, tag, prob) of each word, from (id, n_words, word_ids, logits).

    ``logits`` has an array for each sub-word, in the order of ``TAGS``; ``word_ids``
    is null for special tokens.
    """
    tags = word_tags(F.col("n_words"), F.col("word_ids"), F.col("logits"))
    return rows.select("id", F.posexplode(tags).alias("pos", "p")).select("id", "pos", "p.tag", "p.prob")


def spans_of(tags: Column) -> Column:
    """What ``decode`` finds, inside one row: an array of (entity, start, end, total), in order."""
    span = "struct<entity:string,start:int,end:int,total:double>"
    known = F.array(*[F.lit(t) for t in dict.fromkeys(t[2:] for t in S.TAGS if t != "O")])
    named = lambda t: F.when(t["tag"].rlike("^[BI]-") & F.array_contains(known, F.substring(t["tag"], 3, 100)), F.substring(t["tag"], 3, 100))
    words = F.transform(tags, lambda t, i: F.struct(named(t).alias("entity"), t["tag"].startswith("B-").alias("begins"), i.alias("i"), t["prob"].alias("prob")))

    def step(a: Column, w: Column) -> Column:
        last = F.get(a["spans"], F.size(a["spans"]) - 1)
        fresh = w["begins"] | ~a["open"].eqNullSafe(w["entity"])
        start = F.when(fresh, w["i"]).otherwise(last["start"])
        total = F.when(fresh, w["prob"]).otherwise(last["total"] + w["prob"])
        made = F.struct(w["entity"].alias("entity"), start.alias("start"), (w["i"] + 1).alias("end"), total.alias("total"))
        before = F.when(fresh, a["spans"]).otherwise(F.slice(a["spans"], 1, F.greatest(F.size(a["spans"]) - 1, F.lit(0))))
        grown = F.when(w["entity"].isNull(), a["spans"]).otherwise(F.concat(before, F.array(made)))
        return F.struct(grown.cast(f"array<{span}>").alias("spans"), w["entity"].alias("open"))

    start = F.struct(F.array().cast(f"array<{span}>").alias("spans"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(words, start, step, lambda a: a["spans"])


def fields_of_spans(tokens: Column, spans: Column) -> Column:
    """Map of field to (value, confidence, alternates): the likeliest span of each, the first of equal ones."""
    mean = lambda s: s["total"] / (s["end"] - s["start"])

    def one(field: str, entity: str) -> Column:
        own = F.transform(F.filter(spans, lambda s: s["entity"] == entity), lambda s: F.struct(mean(s).alias("mean"), (-s["start"]).alias("minus"), s["start"].alias("start"), s["end"].alias("end")))
        return let(F.struct(F.array_max(own).alias("best"), F.size(own).alias("n")), lambda x: named(field, entity, x))

    def named(field: str, entity: str, x: Column) -> Column:
        value = F.trim(value_of(tokens, F.lit(entity), x["best"]["start"], x["best"]["end"]))
        entry = F.struct(value.alias("value"), F.round(x["best"]["mean"], 4).alias("confidence"), (x["n"] - 1).alias("alternates"))
        return F.when((x["n"] > 0) & (value != ""), F.struct(F.lit(field).alias("key"), entry.alias("value")))

    return F.map_from_entries(F.filter(F.array(*[one(f, e) for f, e in S.TAG_OF.items()]), lambda x: x.isNotNull()))


def span_f1(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(entity, n_expected, n_predicted, n_common, precision, recall, f1) of spans, and ``micro`` over all.

    Both frames have tags (id, pos, tag, prob).  A span counts if its entity, start and
    end are the same; spans of both meet in one full outer join on these.
    """
    keys = ["id", "entity", "start", "end"]
    a, b = (decode(t).select(*keys, F.lit(True).alias(side)) for t, side in ((expected, "_a"), (predicted, "_b")))
    met = a.join(b, keys, "full")
    counts = [F.count_if(F.col("_a").isNotNull()), F.count_if(F.col("_b").isNotNull()), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())]
    out = met.rollup("entity").agg(*[c.alias(n) for c, n in zip(counts, ("n_expected", "n_predicted", "n_common"), strict=True)])
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return out.select(
        F.coalesce("entity", F.lit("micro")).alias("entity"), "n_expected", "n_predicted", "n_common", share(F.col("n_common"), F.col("n_predicted")).alias("precision"),
        share(F.col("n_common"), F.col("n_expected")).alias("recall"), share(2 * F.col("n_common"), F.col("n_expected") + F.col("n_predicted")).alias("f1"),
    )


def aligned_labels(word_ids: Column, labels: Column, max_pieces: int = 256) -> Column:
    """Label numbers of the first ``max_pieces`` sub-words: -100 for special tokens, the word's own for its first, an inside label for the rest."""
    number = F.create_map(*[x for i, t in enumerate(S.TAGS) for x in (F.lit(t), F.lit(i))])
    outside = F.lit(0)

    def one(word: Column, i: Column) -> Column:
        tag = F.get(labels, word)
        first = F.coalesce(F.get(word_ids, i - 1) != word, F.lit(True))
        inside = F.element_at(number, F.concat(F.lit("I-"), F.substring(tag, 3, 100)))
        own = F.coalesce(F.element_at(number, tag), outside)
        return F.when(word.isNull(), -100).when(first | ~F.startswith(tag, F.lit("B-")), own).otherwise(F.coalesce(inside, own))

    return F.transform(F.slice(word_ids, 1, max_pieces), one)
