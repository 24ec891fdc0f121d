"""Prefix trie of conversations, merged family first.

Method.  Conversation ``c`` belongs to the family of ``c - c mod 5``.  It is rebuilt
as the first ``h`` turns of the family's base conversation, followed by its own
turns after its first ``h``, with ``h = crc32(c) mod 9``.  Families are cogrouped by
base id, each with its base conversation; the task rebuilds them and builds the
family's small trie, one row for each distinct prefix with a bit for each of the
(at most five) members that share it.  Only these combined nodes are shuffled by
their prefix for the global merge.

A prefix is known by its depth and two 64-bit sums of its turns' hashes, each mixed
with its place.  Every node is owned by its smallest member, and a conversation
owns the nodes of its path from some depth on, so sums over subtrees need no
descent: with the bytes ``B`` of the turns that a member does not own,
``saved_tokens`` of a node is the sum over its members of what of ``B`` lies at or
below it; leaves and children count those that their owner brings.  One join of a
family's nodes with the few numbers of its members and one sum by prefix give all
totals.

Scale.  Texts are hashed where they are read and never shuffled.  A prefix that a
third of all conversations share is summed before the shuffle, at least five to
one inside families.  Families of more than ``family_turns`` turns do not go into
one task: their turns get their places from counts of blocks of turn numbers, are
hashed in segments of ``segment`` turns, and sums of earlier segments are carried by
the table of segments.  Ends of a node are joined as text in blocks of 1024 ids and
hashed as a stream of blocks, so memory does not follow the number of ends.

Defined cases.  Rows without a conv_id belong to no conversation and are left out.
Null role or text is empty.  Turns without a number come first; turns of equal
number are ordered by a hash of their content, so repeated rows are repeated
turns.  Negative ids take the remainder from 0 to 4.  A conversation may be rebuilt
without turns; it is then a member of the root alone.  Very long texts count by
their bytes.  An empty table gives an empty result, without a root.  Extra columns
are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.workspace import Workspace

FAMILY = 5
HEADS = 9
NODE = ("depth", "k1", "k2")
_NODES = "base long, depth long, k1 long, k2 long, p1 long, p2 long, members long, ends long, size long, total long"
_SEGMENT = "base long, conv long, segment long, n long, a1 long, a2 long, b1 long, b2 long, size long"
_LOW = np.uint64(2**32 - 1)


@dataclass(frozen=True)
class TrieParams:
    """Turns of a family that one task may take, turns of a segment beyond that, and ids of a block of ends."""

    family_turns: int = 20_000
    segment: int = 4_096
    block: int = 1_024


def _mixed(x: np.ndarray) -> np.ndarray:
    """Uniform bits from 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A turn's hash as it counts at its place."""
    return _mixed(hashes ^ _mixed((places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))


def taken_heads(conv: int) -> int:
    """How many first turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _turns(table: pa.Table) -> dict[int, np.ndarray]:
    """The ordered turns of each conversation: rows (hash, hash, bytes)."""
    if not table.num_rows:
        return {}
    conv = table["conv"].to_numpy()
    unnumbered = table["turn"].is_null().to_numpy()
    turn = table["turn"].fill_null(0).to_numpy()
    data = np.stack([table[c].to_numpy() for c in ("x1", "x2", "size")], 1).view(np.uint64).reshape(-1, 3)
    order = np.lexsort((data[:, 1], data[:, 0], turn, ~unnumbered, conv))
    convs, starts = np.unique(conv[order], return_index=True)
    return {int(c): part for c, part in zip(convs, np.split(data[order], starts[1:]), strict=True)}


def _trie(base: int, rebuilt: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
    """The distinct prefixes of a family's rebuilt conversations, the root among them."""
    parts = []
    for conv, turns in rebuilt.items():
        n = len(turns)
        rows = np.zeros((n + 1, 8), np.uint64)  # depth, k1, k2, p1, p2, size, total, end
        rows[:, 0] = places = np.arange(n + 1)
        for k in (0, 1):
            rows[1:, 1 + k] = np.cumsum(_placed(turns[:, k], places[:-1]), dtype=np.uint64)
            rows[1:, 3 + k] = rows[:-1, 1 + k]
        rows[1:, 5] = turns[:, 2]
        rows[:, 6] = np.cumsum(rows[:, 5], dtype=np.uint64)
        rows[n, 7] = 1
        bit = np.full((n + 1, 1), 1 << (conv - base), np.uint64)
        parts.append(np.hstack([rows, bit, rows[:, 7:8] * bit]))
    rows = np.vstack(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)])
    bits = np.bitwise_or.reduceat(rows[:, 8:], starts, axis=0)
    rows = rows[starts]
    named = dict(zip(("depth", "k1", "k2", "p1", "p2"), rows[:, :5].T, strict=True))
    return named | {"members": bits[:, 0], "ends": bits[:, 1], "size": rows[:, 5], "total": rows[:, 6]}


def _family(own: pa.Table, bases: pa.Table) -> pa.Table:
    """The nodes of one family, from the turns of its other conversations and those of its base."""
    conv = (own if own.num_rows else bases)["conv"][0].as_py()
    base = conv - conv % FAMILY
    head = _turns(bases).get(base)
    rebuilt = {} if head is None else {base: head}
    for conv, turns in _turns(own).items():
        h = taken_heads(conv)
        rebuilt[conv] = turns[h:] if head is None else np.vstack([head[:h], turns[h:]])
    nodes = _trie(base, rebuilt)
    names = [field.split(" ")[0] for field in _NODES.split(", ")]
    base_column = np.full(len(nodes["depth"]), base, np.int64)
    return pa.table([base_column if c == "base" else nodes[c].view(np.int64) for c in names], names)


def _hashed(conversations: DataFrame) -> DataFrame:
    """Turns as two hashes and a number of bytes, with the base of their family."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        *(F.xxhash64(F.lit(k), role, text).alias(f"x{k}") for k in (1, 2)),
        F.octet_length(text).cast("long").alias("size"),
    )
    return rows.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(FAMILY)))


def _sums(table: pa.Table, carried: pa.Table | None = None) -> pa.Table:
    """A segment's sums; or, with those of the segments before it, the nodes of its prefixes."""
    order = np.argsort(table["place"].to_numpy())
    column = {c: table[c].to_numpy()[order] for c in ("place", "x1", "x2", "size", "last")}
    conv, base = table["conv"][0].as_py(), table["base"][0].as_py()
    k1, k2 = (_placed(column[c].view(np.uint64), column["place"]) for c in ("x1", "x2"))
    if carried is None:
        halves = [int((k.sum(dtype=np.uint64) >> shift) & _LOW) for k in (k1, k2) for shift in (np.uint64(32), np.uint64(0))]
        row = [base, conv, table["segment"][0].as_py(), len(order), *halves, int(column["size"].sum())]
        return pa.table([[x] for x in row], [field.split(" ")[0] for field in _SEGMENT.split(", ")])
    before = {c: carried[c][0].as_py() for c in ("a1", "a2", "b1", "b2", "size")}
    start = [np.uint64(((before[f"{c}1"] << 32) + before[f"{c}2"]) % 2**64) for c in "ab"]
    sums = [np.cumsum(k, dtype=np.uint64) + s for k, s in zip((k1, k2), start, strict=True)]
    parents = [np.r_[s, x[:-1]] for x, s in zip(sums, start, strict=True)]
    bit = np.full(len(order), 1 << (conv - base), np.int64)
    columns = [np.full(len(order), base), column["place"] + 1, *(x.view(np.int64) for x in (*sums, *parents)), bit, bit * column["last"], column["size"], before["size"] + np.cumsum(column["size"])]
    return pa.table(columns, [field.split(" ")[0] for field in _NODES.split(", ")])


def _large(rows: DataFrame, params: TrieParams) -> DataFrame:
    """The nodes of families too large for one task."""
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / params.block), F.lit(-(2**62))))
    counted = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "x1", "x2")
    ranked = rows.withColumn("row", F.row_number().over(inside)).join(offsets, ["conv", "block"]).withColumn("r", F.col("row") + F.col("offset") - 1)
    heads = ranked.where((F.col("conv") == F.col("base")) & (F.col("r") < HEADS - 1)).select("base", F.col("r").alias("place"), "x1", "x2", "size")
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS))
    convs = ranked.groupBy("base", "conv").agg(F.count("*").alias("own")).withColumn("h", F.when(F.col("conv") == F.col("base"), F.lit(0)).otherwise(h))
    convs = convs.join(heads.groupBy("base").agg(F.count("*").alias("there")), "base", "left")
    convs = convs.withColumn("heads", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("n", F.col("heads") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    copied = convs.join(heads, "base").where("place < heads").select("base", "conv", "n", "place", "x1", "x2", "size")
    kept = ranked.join(convs.select("conv", "h", "heads", "n"), "conv").where("r >= h").withColumn("place", F.col("r") - F.col("h") + F.col("heads"))
    rebuilt = copied.unionByName(kept.select(*copied.columns))
    rebuilt = rebuilt.withColumn("segment", F.floor(F.col("place") / params.segment)).withColumn("last", (F.col("place") == F.col("n") - 1).cast("long")).drop("n")
    sums = rebuilt.groupBy("conv", "segment").applyInArrow(lambda segment: _sums(segment), _SEGMENT)
    before = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "segment", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("a1", "a2", "b1", "b2", "size")))
    carried = carried.toDF(*carried.columns)
    below = rebuilt.groupBy("conv", "segment").cogroup(carried.groupBy("conv", "segment")).applyInArrow(_sums, _NODES)
    bit = F.expr("shiftleft(1L, cast(conv - base as int))")
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "p1", "p2")]
    roots = convs.select("base", *zero, bit.alias("members"), F.when(F.col("n") == 0, bit).otherwise(F.lit(0)).alias("ends"), *(F.lit(0).cast("long").alias(c) for c in ("size", "total")))
    merged = below.unionByName(roots).groupBy("base", *NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.bit_or("members").alias("members"), F.bit_or("ends").alias("ends"), F.min("size").alias("size"), F.min("total").alias("total"))
    return merged.select(*below.columns)


def family_nodes(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """One row for each distinct prefix of each family, with bits of its members and of those that end there."""
    rows = _hashed(conversations)
    large = rows.groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") > params.family_turns).select("base")
    some = not large.isEmpty()
    small = rows.join(large, "base", "left_anti") if some else rows
    is_base = F.col("conv") == F.col("base")
    bases = small.where(is_base).toDF(*small.columns)  # columns of its own, as both sides come from one frame
    built = small.where(~is_base).groupBy("base").cogroup(bases.groupBy("base")).applyInArrow(_family, _NODES)
    return built.unionByName(_large(rows.join(large, "base", "left_semi"), params)) if some else built


def _lowest(bits: Column) -> Column:
    """The place of the lowest bit of five."""
    return F.when(bits.bitwiseAND(1) > 0, 0).when(bits.bitwiseAND(2) > 0, 1).when(bits.bitwiseAND(4) > 0, 2).when(bits.bitwiseAND(8) > 0, 3).otherwise(4)


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, whose blocks follow one another."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for key, ids in zip(zip(*(batch[c].to_pylist() for c in NODE), strict=True), batch["ids"].to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _end_rows(done)
    if node is not None:
        yield _end_rows([(*node, state.hexdigest())])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])


def ends_digest(ends: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every node where conversations end."""
    blocks = ends.groupBy(*NODE, F.floor(F.col("conv") / params.block).alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    blocks = blocks.select(*NODE, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(_ends_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """Every node of the global trie: its smallest member, depth, parent, counts, saved tokens and ends."""
    space = Workspace(conversations.sparkSession, "trie")
    families = space.save(family_nodes(conversations, params))
    bit = [F.shiftright("members", i).bitwiseAND(1) == 1 for i in range(FAMILY)]
    end = [F.shiftright("ends", i).bitwiseAND(1) == 1 for i in range(FAMILY)]
    low = (F.col("base") + _lowest(F.col("members"))).alias("conv_id")

    each = F.explode(F.filter(F.array(*(F.when(e, F.lit(i)) for i, e in enumerate(end))), lambda i: i.isNotNull()))
    ends = families.where("ends <> 0").select("base", *NODE, "total", each.alias("i")).withColumn("conv", F.col("base") + F.col("i"))
    nodes = families.select(*NODE, low, "size", "total", (F.col("members") != F.col("ends")).alias("more")).groupBy(*NODE)
    nodes = nodes.agg(F.min("conv_id").alias("conv"), F.min(F.col("total") - F.col("size")).alias("above"), F.max("more").alias("more"))
    owned = nodes.groupBy("conv").agg(F.min("depth").alias("first"), F.min_by("above", "depth").alias("above"), F.max(~F.col("more")).alias("leaf"))
    members = ends.join(owned, "conv", "left").select("base", "i", F.coalesce("first", F.lit(2**62)).alias("first"), F.coalesce("above", "total").alias("above"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    wide = members.groupBy("base").agg(*(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for c in ("first", "above", "leaf") for i in range(FAMILY)))

    above = F.col("total") - F.col("size")

    def over_members(value) -> Column:
        return sum((F.when(bit[i], value(i)).otherwise(F.lit(0)) for i in range(FAMILY)), F.lit(0)).cast("long")

    counted = families.join(wide, "base").select(
        *NODE, "p1", "p2", low, F.bit_count("members").alias("n_convs"),
        over_members(lambda i: (~end[i] & (F.col(f"first{i}") <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        over_members(lambda i: F.col(f"leaf{i}").cast("long")).alias("n_leaves"),
        over_members(lambda i: F.greatest(F.col(f"above{i}") - above, F.lit(0))).alias("saved_tokens"),
        over_members(lambda i: (F.col(f"first{i}") < F.col("depth")).cast("long")).alias("inside"),
    )
    totals = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = space.save(counted.groupBy(*NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), *totals, (F.max("inside") > 0).alias("inside")))

    # The owner of a node owns its parent too, but for the first node it owns: only those look their parent up.
    root = merged.where("depth = 0").agg(F.min("conv_id")).first()[0]
    near = F.when(F.col("inside"), F.col("conv_id")).when(F.col("depth") == 1, F.lit(root).cast("long"))
    here = merged.where("inside or depth < 2").withColumn("parent_conv_id", near)
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    there = merged.where("not inside and depth >= 2").join(parents, ["depth", "p1", "p2"])
    out = here.unionByName(there.select(*here.columns)).join(ends_digest(ends, params), list(NODE), "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"), "k1", "k2")
