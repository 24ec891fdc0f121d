"""Passages in texts against a plain search."""

import random

from pyspark.sql import functions as F

from waybill.operators import passages


def both(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    what = spark.createDataFrame(list(enumerate(items)), "item_id long, v string")
    found = passages.found_in(docs, what)
    want = {(d, i) for d, t in enumerate(texts) for i, v in enumerate(items) if t and v and v in t}
    return found, want


def test_passages_that_begin_and_end_inside_words(spark):
    texts = ["ALPHA BETA GAMMA DELTA", "BETA GAMMA", "XALPHA BETAY", "A B C D E", "ABCDE", None, "", "GAMMADELTA EPSILON", "THE THE THE", "ÉÉ ÀB"]
    items = ["PHA BETA GAM", "HA BE", "TA GA", "A", "B", "BCD", "E", "C D", "THE THE THE", "", None, "NOWHERE AT ALL", "DELTA E", "É À", "ALPHA", "ALPHA", "GAMMA DELTA X"]
    found, want = both(spark, texts, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted(want)


def test_random_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("AB") for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    items = [t[i : i + rng.randrange(1, 25)].strip() for t in texts for i in (rng.randrange(len(t)), 0)] + [" ".join(word() for _ in range(4)) for _ in range(40)]
    found, want = both(spark, texts, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted(want) and len(want) > 300


def test_ten_thousand_passages_of_one_word_meet_by_keys(spark):
    """Every text has the hot word; every passage is a word; nothing is paired by a product."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("COMMON "), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("W"), (F.col("id") * 31 + k).cast("string"), F.lit("Z"))))).alias("t"))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(F.lit("W"), F.col("id").cast("string"), F.lit("Z")).alias("v"))
    found = passages.found_in(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = found.groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in got) == sum(31 if 31 * d + 30 < 10_000 else max(0, 10_000 - 31 * d) for d in range(400))
    assert passages.found_in(docs.limit(0), items).count() == passages.found_in(docs, items.limit(0)).count() == 0


def test_a_passage_is_looked_up_by_the_word_that_texts_have_least_often(spark):
    """Hot words of a passage bring no text to it; a text that repeats the key meets it once in the result."""
    hot = " ".join(f"HOT{k}" for k in range(5))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{hot} "), F.when(F.col("id") % 100 == 0, "RARE RARE ").otherwise(""), F.lit(hot)).alias("t"))
    items = spark.createDataFrame([(1, "HOT3 HOT4 RARE RARE HOT0 HOT1"), (2, "HOT0 HOT1 NOWHERE HOT3"), (3, "OT3 HOT4 HOT0 HO")], "item_id long, v string")
    long = items.withColumn("parts", F.split("v", " "))
    met = passages._by_inner_word(docs, long).distinct().groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in met} == {1: 3, 3: 300}
    got = sorted(tuple(r) for r in passages.found_in(docs, items).collect())
    assert got == sorted([(d, 1) for d in (0, 100, 200)] + [(d, 3) for d in range(300) if d % 100])


def test_texts_and_passages_are_compared_in_a_form(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "One, two; three"), (2, "one two three four"), (3, None), (None, "one two three")], "doc_id long, t string")
    items = spark.createDataFrame([(7, "NE TWO THR"), (8, "E T"), (9, "x"), (None, "one")], "item_id long, v string")
    found = passages.found_in(docs, items, lambda x: F.replace(F.replace(F.upper(x), F.lit(","), F.lit("")), F.lit(";"), F.lit("")))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]
