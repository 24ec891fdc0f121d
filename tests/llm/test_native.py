"""Mixing, url rules, chat views and the rule ledger against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waybill.llm import chat_views, mixing, rule_ledger, url_filter
from waybill.llm.queries import URL_RULES


def leaves_of(rows):
    return {(r.domain, r.lang, r.source): r for r in rows.collect()}


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s1", 1000), ("b", "x", "s1", 1000)], "domain string, lang string, source string, tokens long")
    plan = mixing.MixPlan(budget_share=0.4, max_epochs=1)
    got = leaves_of(mixing.leaf_budgets(leaves, plan))
    total = 0.4 * 3010
    # s1 can take 10 of its quarter; its sibling takes the rest, and no other leaf gains.
    assert got["a", "x", "s1"].budget == 10
    assert got["a", "x", "s2"].budget == int(total / 4 - 10)
    assert got["a", "y", "s1"].budget == int(total / 4) and got["b", "x", "s1"].budget == int(total / 2)


def test_shortage_of_a_whole_branch_goes_up(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 20), ("b", "x", "s1", 1000)], "domain string, lang string, source string, tokens long")
    got = leaves_of(mixing.leaf_budgets(leaves, mixing.MixPlan(budget_share=0.5, max_epochs=2, weights={"domain": {"a": 3.0}})))
    assert (got["a", "x", "s1"].budget, got["a", "x", "s2"].budget) == (20, 40)
    assert got["b", "x", "s1"].budget == 455 and got["a", "x", "s1"].epochs == 2
    none = leaves_of(mixing.leaf_budgets(leaves, mixing.MixPlan(weights={"domain": {"a": 0.0}, "source": {"s1": -1.0}})))
    assert none["a", "x", "s2"].budget == 0 and none["b", "x", "s1"].budget == 0


def test_prefixes_meet_their_budgets(spark):
    rows = [(i, "w " * (1 + i % 9), "x" if i % 3 else None, f"s{i % 4}", "kept") for i in range(400)] + [(900, None, "x", "s1", "kept"), (901, "", "x", "s1", "kept"), (902, "long " * 5000, "x", "s1", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    plan = mixing.MixPlan(budget_share=0.7, max_epochs=3, weights={"source": {"s2": 5.0}})
    out = mixing.select_documents(docs, F.lit("d"), plan).collect()
    budgets = leaves_of(mixing.leaf_budgets(docs.withColumn("domain", F.lit("d")).groupBy("domain", "lang", "source").agg(F.sum(mixing.word_tokens()).alias("tokens")), plan))
    taken = defaultdict(int)
    for r in out:
        taken[r.domain, r.lang, r.source] += r.take_tokens
        assert r.take_tokens <= r.n_tokens
    assert {k: v.budget for k, v in budgets.items() if v.budget} == {k: v for k, v in taken.items() if v}
    again = mixing.select_documents(docs.repartition(7), F.lit("d"), plan).collect()
    assert sorted((r.doc_id, r.epoch, r.take_tokens) for r in out) == sorted((r.doc_id, r.epoch, r.take_tokens) for r in again)
    assert mixing.select_documents(docs.limit(0), F.lit("d"), plan).count() == 0
    repeated = mixing.select_documents(docs.where("doc_id < 2").unionAll(docs.where("doc_id < 2")), F.lit("d"), mixing.MixPlan(max_epochs=1))
    assert repeated.count() == 4


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("HTTPS://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://m.www.example.com/en/7", "m.www.example.com", "/en/7", "www.example.com/en/"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
        ("http://x.com", "x.com", "", None),
        ("http://x.net/fr/1://b", "x.net", "/fr/1://b", "net/fr/"),
        ("http://ÀB.net?/es/", "Àb.net", "", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
        ("://", "", "", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    row = url_filter.judge(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string"), URL_RULES).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)
    assert row.verdict == ({r.name: r.verdict for r in URL_RULES}[rule] if rule else "allow")


def test_url_model_learns_from_the_rules(spark):
    rows = [(i, f"http://good{i % 7}.com/page/{i}") for i in range(300)] + [(i, f"http://evil{i % 7}.net/fr/casino{i}") for i in range(300, 600)]
    rows += [(1000, "http://good3.org/page/9"), (1001, "http://evil3.org/zz/casino77"), (1002, "http://x.org/" + "casino" * 20_000), (1003, None), (1001, "http://evil3.org/zz/casino77")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("rule is null").collect()
    verdicts = {r.page_id: r.verdict for r in got}
    assert (verdicts[1000], verdicts[1001], verdicts[1002]) == ("allow", "block", "block") and len(got) == 5
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def exact_scores(taught, asked, params):
    """Scores of the ``asked`` texts by two plain models of (text, accepted, copies)."""
    grams, totals = [Counter(), Counter()], [Counter(), Counter()]
    for url, accepted, copies in taught:
        for i in range(len(url)):
            for k in range(min(i, params.order) + 1):
                grams[accepted][url[i - k : i + 1]] += copies
                totals[accepted][url[i - k : i]] += copies

    def p(kind, gram):
        shorter = p(kind, gram[1:]) if len(gram) > 1 else 1 / url_filter.ALPHABET
        return (grams[kind][gram] + params.weight * shorter) / (totals[kind][gram[:-1]] + params.weight)

    def ratio(gram):
        return math.log(p(1, gram) / p(0, gram))

    return {u: sum(ratio(u[max(0, i - params.order) : i + 1]) for i in range(len(u))) / len(u) for u in asked}


def test_url_scores_equal_a_plain_model_of_all_ngrams(spark):
    rng, params = random.Random(3), url_filter.UrlParams()
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789é😀") for _ in range(30))
    urls = [f"http://{word()}.com/{word()}" for _ in range(700)] + [f"http://{word()}.net/fr/{word()}" for _ in range(700)]
    urls += urls[:40] * 3 + (asked := [f"http://{word()}.org/{word()}" for _ in range(60)] + [u.replace(".com/", ".org/") for u in urls[:60]])
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.score for r in url_filter.judge(pages, URL_RULES).where("rule is null").collect()}
    fold = F.pmod(F.xxhash64(F.lit(params.seed), F.expr("substring(url, 8)")), F.lit(5))
    folds = {r.url: r.fold for r in pages.select("url", fold.alias("fold")).distinct().collect()}
    taught = [(u[7:], ".com/" in u, n) for u, n in Counter(urls).items() if u not in asked and folds[u]]
    assert len({u[i : i + 5] for u, _, _ in taught for i in range(len(u) - 4)}) > 50_000
    want = exact_scores(taught, [u[7:] for u in asked], params)
    assert set(got) == set(asked)
    assert all(abs(got[u] - want[u[7:]]) < 1e-9 for u in asked)


def test_url_threshold_counts_copies(spark):
    rows = spark.createDataFrame([(0.5, 1, 0), (0.1, 1, 0), (0.3, 0, 1), (-0.5, 0, 1)], "score double, y long, n long")
    cut = lambda few: url_filter.threshold(rows.withColumn("y", F.when(F.col("score") == 0.1, few * F.col("y")).otherwise(F.col("y"))), url_filter.UrlParams())
    assert cut(9) < 0.1 < 0.3 < url_filter.threshold(rows.withColumn("n", F.when(F.col("score") == 0.3, 9 * F.col("n")).otherwise(F.col("n"))), url_filter.UrlParams())


def test_chat_views(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 2, None, None), (1, None, "system", "be good"), (2, 0, "system", "alone"), (None, 0, "user", "x")]
    turns += [(3, k, "ab"[k % 2], f"t{k}") for k in range(100)]
    out = chat_views.perspectives(spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, segment int")).collect()
    views = defaultdict(list)
    for r in out:
        views[r.conv_id, r.perspective].append(r)
    assert {k for k in views} == {(1, "user"), (1, "assistant"), (1, "unknown"), (None, "user"), (3, "a"), (3, "b")}
    for (conv, who), rows in views.items():
        rows.sort(key=lambda r: r.seq)
        text = "".join(r.segment for r in rows)
        assert [r.seq for r in rows] == list(range(len(rows)))
        for r in rows:
            assert text[r.start : r.end] == r.segment
            assert (r.loss_end > r.loss_start) == (r.speaker == who)
            if r.speaker == who:
                assert text[r.loss_start : r.loss_end].endswith("<|im_end|>") and r.role == "assistant"
    first = "".join(r.segment for r in views[1, "assistant"])
    assert first == "<|im_start|>system\nbe good<|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    assert len(views[3, "a"]) == 100
    assert chat_views.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def measures(text):
    x = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_ledger_measures_and_policies(spark):
    texts = [None, "", " \t\x0b ", "a b c d e", "a b c d e a b c d e", "x " * 30_000, "one\ntwo\none\n\n\none\n \n", "é ß 😀 #*$%&|<>", "a b c d", "# # # # # # # # # # # #", "x y z " * 4, "Fine words here stand in a row. They end well, with a stop."]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, failed string")
    rows = rule_ledger.apply_policy(rule_ledger.ledger(docs), rule_ledger.POLICIES["v2"])
    got = {r.doc_id: r for r in rows.collect()}
    for i, text in enumerate([*texts, texts[3]]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(text), text
        assert bool(r.failed & 3) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert got[11].kept and not got[9].kept
    table = {r.rule: r for r in rule_ledger.ablation(rows, rule_ledger.POLICIES["v2"]).collect()}
    for name in rule_ledger.POLICIES["v2"].rejecting:
        without = rule_ledger.Policy("w", tuple(n for n in rule_ledger.POLICIES["v2"].rejecting if n != name))
        assert table[name].kept_without == rule_ledger.apply_policy(rows, without).where("kept").count()
    assert rule_ledger.ledger(docs.limit(0)).count() == 0
