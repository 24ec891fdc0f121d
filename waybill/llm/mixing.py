"""Mixing sources to target weights, by hierarchical budgeting.

Method.  Leaves are (domain, language, source).  A token budget flows down the
tree: siblings share their parent's budget in proportion to their weights, and a
node can take no more than ``max_epochs`` times the tokens below it.  What a node
cannot take goes to its siblings by weight, and only what the siblings cannot
take either goes up, as the parent's own capacity is the sum of its children's.
The share of a node is ``least(capacity, level * weight)``, where the level of a
family is ``max((budget - capacity of fuller siblings) / weight of the others)``
over its siblings in order of capacity per weight: windows, no iteration.

A leaf then takes whole epochs of its documents while its budget lasts, and from
the last epoch the token-prefix in the order of a seeded hash of (seed, epoch,
doc_id).  The document that crosses the budget is taken for the tokens left.

Scale.  Everything is DataFrame functions.  The texts are only mapped, once for the
tokens, which are written beside the ids, and once for the result; shuffles
carry sums for (leaf, hash bucket).  The cut inside a leaf is found in three
steps, of 256 coarse hash buckets, the 256 fine ones of the bucket in which the
budget ends, and that one's documents, so a source with a third of all rows is
spread evenly and no window sees more than 256 sums of a leaf.  The leaf table joins by broadcast when it has been counted to
hold at most ``BROADCAST_LEAVES`` rows, else by a plain join.

Defined cases.  Null text: no tokens; such documents are taken with the epoch
they fall in.  Null or unlisted keys have weight 1; weights below 0 count as 0
and a node of weight 0 takes nothing.  Rows that repeat a doc_id in one leaf
share a place in the order and are cut together, in which case the leaf may pass
its budget by their tokens.  A budget above all capacity takes all epochs.  Very
long documents count whole.  An empty table gives an empty result.  Extra
columns are kept by ``select_documents``; names that clash are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.naming import unused
from waybill.llm.workspace import Workspace

LEAF = ("domain", "lang", "source")
BROADCAST_LEAVES = 20_000
_WORDS = "size(filter(split(text, '[ \\\\t-\\\\r]+'), w -> w <> ''))"


@dataclass(frozen=True)
class MixPlan:
    budget_share: float = 1.0
    max_epochs: int = 3
    seed: int = 42
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def weight(self, level: str) -> Column:
        listed = self.weights.get(level, {})
        found = F.lit(1.0)
        for key, value in listed.items():
            found = F.when(F.col(level) == key, F.lit(float(value))).otherwise(found)
        return F.greatest(found, F.lit(0.0))


def word_tokens() -> Column:
    """Tokens of ``text`` for the budget: its words."""
    return F.coalesce(F.expr(_WORDS), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    """The seeded place of a document in an epoch: 16 hex digits, in text order."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 16)


def _fill(nodes: DataFrame, parent: list[str], level: str, plan: MixPlan) -> DataFrame:
    """Share ``budget`` of each parent among its children (columns: ..., cap, budget)."""
    w = nodes.withColumn("w", plan.weight(level)).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0.0)))
    w = w.withColumn("rate", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0)))
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = family.orderBy("rate", F.col(level).asc_nulls_first())
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", F.try_divide(F.col("budget") - before, left))
    w = w.withColumn("level", F.max("level").over(family))
    return w.withColumn("budget", F.least("cap", F.greatest(F.col("level"), F.lit(0.0)) * F.col("w"))).drop("w", "rate", "level")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """From (domain, lang, source, tokens): ``budget``, whole ``epochs`` and ``rest`` of each leaf."""
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(float(plan.max_epochs)))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(plan.budget_share)).alias("budget"))
    out = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).join(total)
    out = _fill(out, [], "domain", plan).select("domain", "budget")
    for parent, level in ((["domain"], "lang"), (["domain", "lang"], "source")):
        keys = [*parent, level]
        down = caps.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        up = out.toDF(*[f"_{c}" if c in parent else c for c in out.columns])
        same = [down[c].eqNullSafe(up[f"_{c}"]) for c in parent]
        down = down.join(up, same[0] if len(same) == 1 else same[0] & same[1]).select(*keys, "cap", "tokens", "budget")
        filled = _fill(down, parent, level, plan)
        out = filled.select(*keys, "budget", *(["tokens"] if level == "source" else []))
    out = out.withColumn("budget", F.floor("budget").cast("long"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    return out.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _with_leaves(docs: DataFrame, leaves: DataFrame, few: bool) -> DataFrame:
    """``docs`` with the columns of their leaf; broadcast only if the table was counted to be small."""
    names = unused(docs, *LEAF)
    side = leaves.withColumnsRenamed(dict(zip(LEAF, names, strict=True)))
    on = functools.reduce(Column.__and__, [docs[c].eqNullSafe(side[n]) for c, n in zip(LEAF, names, strict=True)])
    return docs.join(F.broadcast(side) if few else side, on).drop(*names)


def _first_over(sums: DataFrame, by: str) -> DataFrame:
    """Of each leaf's rows (leaf, ``by``, n, left), the one in which the tokens left run out, with what is left there."""
    along = Window.partitionBy(*LEAF).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).where("before < left and before + n >= left")
    return ends.select(*LEAF, F.col(by).alias("end"), (F.col("left") - F.col("before")).alias("left"))


def _cuts(docs: DataFrame, plan: MixPlan) -> tuple[DataFrame, bool]:
    """Leaf rows with ``cut``, the last order key taken, and ``last_take``, the tokens taken there."""
    space = Workspace(docs.sparkSession, "mixing")
    lean = space.save(docs.select("doc_id", *LEAF, word_tokens().alias("n_tokens")))
    leaves = space.save(leaf_budgets(lean.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), plan))
    few = leaves.count() <= BROADCAST_LEAVES
    placed = _with_leaves(lean, leaves.where("rest > 0"), few).withColumn("key", order_key(plan.seed, F.col("epochs")))
    fine = space.save(placed.groupBy(*LEAF, F.substring("key", 1, 4).alias("fine")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("left")))
    coarse = fine.groupBy(*LEAF, F.substring("fine", 1, 2).alias("coarse")).agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    ends = space.save(_first_over(coarse, "coarse"))
    ends = space.save(_first_over(_with_leaves(fine.drop("left"), ends, few).where("substring(fine, 1, 2) = end"), "fine"))
    last = _with_leaves(placed, ends, few).where("substring(key, 1, 4) = end")
    cut = _first_over(last.groupBy(*LEAF, "key").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left")), "key")
    cut = cut.select(*[F.col(c).alias(f"_{c}") for c in LEAF], F.col("end").alias("cut"), F.col("left").alias("last_take"))
    same = leaves["domain"].eqNullSafe(cut["_domain"]) & leaves["lang"].eqNullSafe(cut["_lang"]) & leaves["source"].eqNullSafe(cut["_source"])
    out = space.save(leaves.join(cut, same, "left").select(*[leaves[c] for c in LEAF], "epochs", "cut", "last_take"))
    space.drop(lean, fine)
    return out, few


def select_documents(docs: DataFrame, domain: Column, plan: MixPlan = MixPlan()) -> DataFrame:
    """``docs``, a row for every epoch in which a document is taken, with ``domain``, ``epoch``, ``n_tokens`` and ``take_tokens``."""
    rows = docs.drop("epoch", "n_tokens", "take_tokens").withColumn("domain", domain)
    epochs, cut, last_take, key, times = own = unused(rows, "epochs", "cut", "last_take", "key", "times")
    leaves, few = _cuts(rows.select("doc_id", "text", *LEAF), plan)
    taken = _with_leaves(rows, leaves.withColumnsRenamed({"epochs": epochs, "cut": cut, "last_take": last_take}), few)
    taken = taken.withColumn(key, order_key(plan.seed, F.col(epochs)))
    last = F.when(F.col(key) <= F.col(cut), F.col(epochs) + 1).otherwise(F.col(epochs))
    taken = taken.withColumn(times, last).where(F.col(times) > 0).withColumn("n_tokens", word_tokens())
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    cropped = (F.col("epoch") == F.col(epochs)) & (F.col(key) == F.col(cut))
    taken = taken.withColumn("take_tokens", F.when(cropped, F.least("n_tokens", last_take)).otherwise(F.col("n_tokens")))
    return taken.drop(*own)
