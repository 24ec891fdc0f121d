"""Many passages in many texts: which text contains which passage, by an index of words.

A passage of three words or more has inner words, which are whole words of every
text that has it.  A few of them, those that fewest passages have, are looked for
in the texts; what is found is dealt by word once, for counting and for the search:
the passage is looked up by the one that the texts have least often.  A passage of
one or two words begins or ends inside a word of the text; it is matched with the
distinct words of all texts first, by the character run of at most three that fewest
distinct words have.  Both give (word, passage) triggers, which meet the texts' words
in a join by word; only texts and passages that meet are compared in full.

Nothing is paired by a product: each passage has one key, chosen by count, so a word
that every text has is a key only where a passage has no other among those looked for.
What texts send is words that passages ask for, and all their distinct words only where
a passage is short; the text itself meets its passages at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: Inner words of a passage that are looked for in the texts; which ones decides no result, only how many texts are compared.
PROBES = 8


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "")


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, n)))


def _rarest(keys: DataFrame, counts: DataFrame, key: str, carried: list[str], ties: list[str]) -> DataFrame:
    """Of each item's keys the one with the smallest count; keys that no text has end the search for it."""
    counted = keys.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = counted.groupBy("item_id").agg(F.min_by(F.struct(key, "n", *carried), F.struct("n", *ties, key)).alias("best"))
    return best.select("item_id", "best.*").where("n > 0").drop("n")


def _probes(long: DataFrame) -> DataFrame:
    """(item_id, word): of each passage the inner words that fewest passages have, longer ones first.

    Windows and no joins, so that Spark knows by the passages' own size whether every task can have the words.
    """
    inner = long.select("item_id", F.explode(F.array_distinct(F.slice("parts", 2, F.size("parts") - 2))).alias("word"))
    shared = inner.withColumn("m", F.count("*").over(Window.partitionBy("word")))
    order = Window.partitionBy("item_id").orderBy("m", F.length("word").desc(), "word")
    return shared.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PROBES).select("item_id", "word")


def _by_inner_word(texts: DataFrame, long: DataFrame) -> DataFrame:
    """(doc_id, item_id) of texts that have the key of a passage of three words or more."""
    probes = _probes(long)
    words = texts.select("doc_id", F.explode(F.split("t", " ")).alias("word"))
    # Dealt once: counts and pairs read the same exchange, as both need both columns.
    hits = words.join(probes.select("word").distinct(), "word", "left_semi").repartition("word")
    counts = hits.groupBy("word").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    return hits.join(_rarest(probes, counts, "word", [], ["last"]), "word").select("doc_id", "item_id")


def _by_part_of_a_word(texts: DataFrame, short: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, item_id) of texts with a word that a passage of one or two words may begin or end in."""
    words = texts.select("doc_id", F.explode(_words("t")).alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n"))
    runs = F.flatten(F.array(*[F.when(F.length("word") >= w, _grams(F.col("word"), F.lit(w))).otherwise(F.array().cast("array<string>")) for w in widths]))
    indexed = known.select("word", F.explode(runs).alias("gram"))
    keys = short.select("item_id", "needle", "side", F.explode(_grams(F.col("needle"), F.col("width"))).alias("gram"))
    chosen = _rarest(keys, indexed.groupBy("gram").agg(F.count("*").alias("n")), "gram", ["needle", "side"], [])
    fits = F.when(F.col("side") == "inside", F.contains("word", "needle")).when(F.col("side") == "start", F.startswith("word", "needle")).otherwise(F.endswith("word", "needle"))
    triggers = indexed.join(chosen, "gram").where(fits).select("word", "item_id")
    return words.join(triggers, "word").select("doc_id", "item_id")


def _needles(parts: DataFrame) -> DataFrame:
    """Passages of one or two words by their longer word and the side of it that a text's word may go on at."""
    first, last = F.get("parts", 0), F.get("parts", F.size("parts") - 1)
    one, begins = F.size("parts") == 1, F.length(last) > F.length(first)
    short = parts.where(F.size("parts") <= 2).select("item_id", F.when(begins, last).otherwise(first).alias("needle"), F.when(one, "inside").when(begins, "start").otherwise("end").alias("side"))
    return short.withColumn("width", F.least(F.length("needle"), F.lit(GRAM)))


def found_in(texts: DataFrame, items: DataFrame, form: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(doc_id, item_id) of every text that contains a passage; from (doc_id, t) and (item_id, v), compared in ``form``: words parted by one blank.

    Null and empty passages are in no text; rows that repeat a key count once, rows without a key do not.
    """
    items = items.select("item_id", form(F.col("v")).alias("v")).where("v <> ''").distinct()
    texts = texts.where("doc_id is not null")  # for all branches, so that they share their exchanges
    formed = texts.select("doc_id", form(F.col("t")).alias("t"))
    parts = items.withColumn("parts", F.split("v", " "))
    short = _needles(parts)
    widths = short.agg(F.array_sort(F.collect_set("width")).alias("w")).first()["w"]  # of 1 to GRAM
    pairs = _by_inner_word(formed, parts.where(F.size("parts") > 2))
    if widths:
        pairs = pairs.unionByName(_by_part_of_a_word(formed, short, widths))
    # One row a text that meets passages, so that its form is made once, and of no other text.
    met = pairs.join(items, "item_id").groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "v")).alias("met"))
    compared = texts.join(met, "doc_id").select("doc_id", form(F.col("t")).alias("t"), "met")
    found = compared.select("doc_id", F.explode(F.filter("met", lambda x: F.contains("t", x["v"]))).alias("x"))
    return found.select("doc_id", "x.item_id").distinct()
