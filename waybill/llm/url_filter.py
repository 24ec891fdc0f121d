"""URL filters: host and path rules, and a character language-model ratio for the rest.

Method.  A rule (allow or block, host, path) fits its host with all subdomains
when the path starts with the rule's; the longest fitting rule decides.  URLs
that rules decide are the training texts: two smoothed variable-order Markov
models, one of accepted and one of rejected URLs, are counted from all of them.
A model of order ``k`` gives ``p(c | context) = (n(context, c) + weight *
p_shorter) / (n(context) + weight)``, down to order 0, which leans on a uniform
distribution; a context that a class has not seen leaves its shorter one's
probability.  A URL's score is the mean over its characters of the log ratio of the
two models' probabilities.  The
threshold comes from a fifth of the rule-decided URLs, which the counts leave
out: the middle of the gap in scores with the best balanced accuracy.

Scale.  All steps are DataFrame functions.  Equal urls are first made one row with
their number of copies.  N-grams are counted under their own text with map-side
sums, and context totals under the real context, so the model has a row for each
n-gram of the corpus and grows with it.  Counts, contexts, shorter n-grams and
ratios meet in joins by shuffle, unless Spark knows a written table to be small;
a context or a shorter n-gram has at most one partner for each letter.  N-grams
that only undecided urls have are carried along with counts of 0.

Defined cases.  A null url, or one without ``://``, has an empty host and path
and no rule.  A null or empty url scores 0.  Very long URLs are read whole.
Repeated rows are judged each.  Without rule-decided URLs of both classes every
ratio is 0 and the threshold 0, so the verdict is allow.  An empty table gives an
empty result.  Extra columns are kept; those with the name of an output column
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.naming import unused
from waybill.llm.workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = 256.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlParams:
    order: int = 4
    weight: float = 2.0
    step: float = 0.02
    seed: int = 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _characters(urls: DataFrame, params: UrlParams, *kept: str) -> DataFrame:
    """A row for each character of ``_url``: ``g`` is the text of up to ``order + 1`` characters that it ends."""
    split = urls.select(*kept, F.split("_url", "").alias("_cs")).where("size(_cs) > 0 and _cs[0] <> ''")
    width = params.order + 1
    return split.select(*kept, F.explode(F.expr(f"transform(sequence(1, size(_cs)), i -> array_join(slice(_cs, greatest(1, i - {params.order}), least(i, {width})), ''))")).alias("g"))


def model(urls: DataFrame, params: UrlParams, workspace: Workspace) -> DataFrame:
    """From (_url, y, n), the copies of a url in each class: (g, ratio) for every n-gram of the urls.

    Urls with neither copies of one nor of the other only ask for ratios.
    """
    counts = [F.sum("y").alias("y"), F.sum("n").alias("n")]
    longest = _characters(urls, params, "y", "n").groupBy("g").agg(*counts)
    ends = longest.select("y", "n", F.explode(F.expr("transform(sequence(1, char_length(g)), k -> right(g, k))")).alias("g"))
    grams = ends.groupBy("g").agg(*counts).withColumn("c", F.expr("left(g, char_length(g) - 1)"))
    grams = workspace.save(grams)
    contexts = grams.groupBy("c").agg(F.sum("y").alias("ys"), F.sum("n").alias("ns"))
    grams = workspace.save(grams.join(contexts, "c"))
    smooth = lambda n, q, total: (F.col(n) + params.weight * F.col(q)) / (F.col(total) + params.weight)
    uniform = F.lit(1 / ALPHABET)
    level = grams.where("char_length(g) = 1").withColumns({"qy": uniform, "qn": uniform})
    both, levels = (F.col("ys") > 0) & (F.col("ns") > 0), []
    for k in range(params.order + 1):
        if k:
            below = levels[-1].select(F.col("g").alias("shorter"), F.col("py").alias("qy"), F.col("pn").alias("qn"), "both")
            level = grams.where(f"char_length(g) = {k + 1}").withColumn("shorter", F.expr(f"right(g, {k})")).join(below, "shorter")
        else:
            level = level.withColumn("both", both)  # the totals of order 0 are those of the classes
        level = level.select("g", "both", smooth("y", "qy", "ys").alias("py"), smooth("n", "qn", "ns").alias("pn"))
        levels.append(workspace.save(level))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("g", F.when(F.col("both"), F.log(F.col("py") / F.col("pn"))).otherwise(F.lit(0.0)).alias("ratio"))


def scored(urls: DataFrame, ratios: DataFrame, key: str, params: UrlParams) -> DataFrame:
    """(key, score) for each row of (key, _url); rows without a character are left out."""
    return _characters(urls, params, key).join(ratios, "g").groupBy(key).agg((F.sum("ratio") / F.count("*")).alias("score"))


def threshold(rows: DataFrame, params: UrlParams) -> float:
    """From (score, y, n), n copies of each class: the score with the best mean of both classes' accuracies, 0 without both."""
    bins = rows.select(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / params.step))).alias("bin"), "y", "n")
    counts = bins.groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    share = F.try_divide(F.coalesce(F.sum("n").over(below), F.lit(0)), F.sum("n").over(every)) - F.try_divide(F.coalesce(F.sum("y").over(below), F.lit(0)), F.sum("y").over(every))
    below_bin = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))
    gains = counts.withColumn("gain", share).withColumn("cut", (F.col("bin") + below_bin) / 2)  # the middle of the gap below
    best = gains.where("gain is not null").orderBy(F.desc("gain"), F.abs("cut"), "cut").first()
    return float(best["cut"]) * params.step if best else 0.0


def judge(pages: DataFrame, rules: Sequence[Rule], params: UrlParams = UrlParams()) -> DataFrame:
    """``pages`` with host, path, rule, score, rule_verdict (or null) and verdict."""
    url = F.col("url")
    rows = pages.drop("host", "path", "rule", "rule_verdict", "verdict", "score").withColumns({"host": host_of(url), "path": path_of(url)})
    (key,) = unused(rows, "key")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "rule_verdict": verdict})
    text = F.lower(F.coalesce(F.regexp_replace(url, "(?s)^.*?://", ""), F.lit("")))
    workspace = Workspace(pages.sparkSession, "urls")
    yes, no = F.count_if(F.col("rule_verdict") == "allow"), F.count_if(F.col("rule_verdict") == "block")
    urls = rows.groupBy(text.alias("_url")).agg(yes.alias("_yes"), no.alias("_no"), F.count_if(F.col("rule_verdict").isNull()).alias("_undecided"))
    urls = urls.withColumn("_fold", F.pmod(F.xxhash64(F.lit(params.seed), "_url"), F.lit(5)))
    taught = lambda n: F.when(F.col("_fold") != 0, F.col(n)).otherwise(F.lit(0))
    urls = workspace.save(urls.withColumns({"y": taught("_yes"), "n": taught("_no"), "_id": F.monotonically_increasing_id()}))
    ratios = model(urls, params, workspace)
    asked = urls.where("_undecided > 0 or _fold = 0 and _yes + _no > 0")
    scores = workspace.save(urls.join(scored(asked, ratios, "_id", params), "_id").select(F.col("_url").alias(key), "score", "_undecided", (F.col("_yes") - F.col("y")).alias("y"), (F.col("_no") - F.col("n")).alias("n")))
    cut = threshold(scores.where("y + n > 0"), params)
    decided = rows.where("rule_verdict is not null").withColumn("score", F.lit(None).cast("double"))
    undecided = rows.where("rule_verdict is null").withColumn(key, text)
    out = decided.unionByName(undecided.join(scores.where("_undecided > 0").select(key, "score"), key, "left").drop(key))
    by_model = F.when(F.coalesce(F.col("score"), F.lit(0.0)) >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn("verdict", F.coalesce("rule_verdict", by_model))
