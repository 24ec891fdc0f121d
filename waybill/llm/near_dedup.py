"""MinHash near-deduplication by a chosen-path set similarity join.

Method.  A document's set is its distinct word shingles, and each set is embedded
as minwise tokens.  In each of several independent trees the root branches the
documents by one selected token; a larger node branches on, by tokens that a hash
of its path selects, and nodes of at most ``SMALL`` documents (``SMALL_WIDE`` in
the second round) are compared exhaustively.  A node selects one token, or with probability ``1/t - 1`` two, so
that a pair at the threshold ``t`` has one common child on average: such pairs
survive, and less similar ones die out.  In the first round sketches are compared,
with a margin of five standard deviations below the threshold, and every
candidate is confirmed on the two full sets; in the second the full sets
themselves meet in the nodes.

The trees come in two rounds.  The first takes all documents and branches once;
its trees are twice what a recall of ``1 - MISS`` needs, so that a document may
stand in a few large nodes and still meet its partners in small ones (``spare``).
Documents in more large nodes, and those of small nodes that are left with many
doubtful pairs, enter a second round of more trees and longer sketches, again
from the roots; as both ends of a pair that the first round leaves open are
among them, no link is lost between the rounds.  The number of trees follows from
the chance that a pair at the threshold survives all branchings, whose number
follows from the largest node of the first round.

Only links between different components matter, so work shrinks as links are
confirmed, and no step puts out more than a few rows for each member of a node.
Equal sets are one class from the start.  In the first round's large nodes each
member is compared with one pivot, the member most like about ``SAMPLE`` others.
In a small node a spanning forest of the likeliest pairs is confirmed first; then
the node is compared again, and only pairs whose ends are still apart are
candidates, if they are at most ``FEW`` a member.  A node whose members are all
connected goes no further.  A node of the second round is compared exactly, with
a running union of its components, and puts out a spanning forest of confirmed
links.  Nodes that are still large after ``ROUNDS`` branching steps, or whose sets
are more than ``UNIT_HASHES`` together, are compared in blocks, any two of which
meet in one unit.

Scale.  Texts are read by maps, and moved only for candidates, by a join with the
candidate ids (broadcast only if counted to be at most ``BROADCAST_IDS``).  Rows
of the trees hold a node, an id and a sketch of 128 bytes, 512 in the second
round.  Group sizes, pivots and components come from aggregates with map-side sums
and from joins that adaptive execution splits; no group is collected but those of
small nodes, of about 1 MB, and the second round's units, of about 32 MB.

Defined cases.  Null, empty and blank texts have the empty set and link with
nothing.  Very long texts are read whole.  Rows that repeat a doc_id with one text
are one node of the links; with different texts each is judged by its own.  A null doc_id links with nothing and is kept.  Ties cannot occur:
the smallest doc_id of a component is kept.  An empty table gives an empty
result.  Extra columns stay in ``keep_one``; those with the name of an output
column are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.components import components
from waybill.llm.naming import unused
from waybill.llm.workspace import Workspace

TOKENS, WIDE = 128, 512
SMALL, SMALL_WIDE, SAMPLE, FEW = 1024, 2048, 32, 4
UNIT_HASHES = 4_000_000
SHRINK, ROUNDS = 0.75, 24
MISS = 1e-6
BROADCAST_IDS = 1_000_000
_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class DedupParams:
    """``shingle`` words a shingle; link if ``100 * both >= percent * either``."""

    shingle: int = 5
    percent: int = 80
    seed: int = 11

    @property
    def threshold(self) -> float:
        return self.percent / 100

    def trees(self, depth: int) -> int:
        """Trees in which a pair at the threshold survives ``depth`` branchings with probability ``1 - MISS``."""
        two = min(1.0, 1 / self.threshold - 1)
        lives = 1.0
        for level in reversed(range(depth)):
            meets = self.threshold * lives
            lives = meets if level == 0 else (1 - two) * meets + two * (1 - (1 - meets) ** 2)
        return max(1, math.ceil(math.log(MISS) / math.log(1 - lives))) if lives < 1 else 1

    @property
    def roots(self) -> int:
        """Trees of the first round: twice what recall needs, so that a few large nodes can be done without."""
        return min(TOKENS, 2 * self.trees(1))

    @property
    def spare(self) -> int:
        """In how many trees a document may stand in a large node while the other trees still reach ``1 - MISS``.

        If a share ``f`` of its tokens leads to large nodes, the rest of two sets at
        the threshold ``t`` is alike by ``(t - f) / (1 - f)`` at least.
        """
        n = self.roots
        rest = lambda k: max(0.0, (self.threshold - k / n) / (1 - k / n))
        return max(k for k in range(n) if (1 - rest(k)) ** (n - k) <= MISS or k == 0)

    def floor(self, tokens: int) -> float:
        """The least estimate from so many tokens that is still a candidate."""
        return self.threshold - 5 * math.sqrt(self.threshold * (1 - self.threshold) / tokens)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (_P, pow(_P, -1, 2**64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _chunks(texts: list[str]) -> Iterator[list[bytes]]:
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
        if chunk and size + len(raw) > _BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(raw)
        size += len(raw) + 1
    if chunk:
        yield chunk


def shingle_sets(texts: list[str], shingle: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    for chunk in _chunks(texts):
        raw = np.frombuffer(b" ".join(chunk) + b" ", np.uint8)
        word = (raw != 32) & ((raw < 9) | (raw > 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        size = 1 << max(10, len(raw).bit_length())
        up, down = _powers(size)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        lengths = np.array([len(x) + 1 for x in chunk])
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.searchsorted(starts, offsets)
        rolled = np.zeros(max(len(words) - shingle + 1, 0), np.uint64)
        for k in range(shingle):
            rolled = mix(rolled * np.uint64(_P) + words[k : k + len(rolled)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= shingle:
                yield np.unique(rolled[a : b - shingle + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for k in range(a, b):
                    one = mix(one * np.uint64(_P) + words[k : k + 1])
                yield mix(one + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


@functools.lru_cache(2)
def _functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(seed).integers(0, 2**32, (2, WIDE, 1), dtype=np.uint64).astype(np.uint32)
    return made[0] | np.uint32(1), made[1]


def tokens_of(hashes: np.ndarray, seed: int, count: int) -> np.ndarray:
    """The minwise token of a set under each of the first ``count`` functions."""
    a, b = (x[:count] for x in _functions(seed))
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        values = x[None, i : i + 4096] * a + b
        values ^= values >> np.uint32(15)
        best = np.minimum(best, (values * np.uint32(0x85EBCA77)).min(axis=1))
    return best


def _short(tokens: np.ndarray) -> bytes:
    """A byte for each token: equal tokens have equal bytes, others by chance."""
    return ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def describe(docs: DataFrame, params: DedupParams) -> DataFrame:
    """(doc_id, n, digest, sketch, roots): the set's size and digest, its sketch, and its node in each tree."""
    chosen = np.random.default_rng(params.seed + 1).permutation(TOKENS)[: params.roots]
    salts = mix(np.arange(1, len(chosen) + 1, dtype=np.uint64) * np.uint64(_P))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"], shingle_sets(list(batch["text"]), params.shingle), strict=True):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if not len(found):
                    rows.append((doc_id, 0, digest, None, None))
                    continue
                tokens = tokens_of(found, params.seed, TOKENS)
                roots = mix(salts ^ mix(tokens[chosen].astype(np.uint64) + salts)).astype(np.int64)
                rows.append((doc_id, len(found), digest, _short(tokens), roots))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "sketch", "roots"])

    # Ids travel as text: pandas turns whole numbers beside nulls into floats.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(described, "doc_id string, n long, digest binary, sketch binary, roots array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated likeness from the share of equal bytes, chance hits taken out."""
    same = (left == right).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of these sizes can reach the threshold at all."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _likely_pairs(labels: np.ndarray, sizes: np.ndarray, s: np.ndarray, params: DedupParams) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different labels whose sketches are alike enough, the likeliest first."""
    floor, rows, others, alike = params.floor(s.shape[1]), [], [], []
    for i in range(len(labels) - 1):
        j = i + 1 + np.flatnonzero((labels[i + 1 :] != labels[i]) & _possible(sizes[i + 1 :], sizes[i], params.percent))
        like = _agreement(s[j], s[i])
        near = like >= floor
        rows.append(np.full(near.sum(), i, np.int32))
        others.append(j[near].astype(np.int32))
        alike.append(like[near].astype(np.float32))
    if not rows:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    order = np.argsort(-np.concatenate(alike), kind="stable")
    return np.concatenate(rows)[order], np.concatenate(others)[order]


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the label pairs, in order, join two trees."""
    tops: dict[int, int] = {}
    joins = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        while (t := tops.get(a, a)) != a:
            a = t
        while (t := tops.get(b, b)) != b:
            b = t
        if a != b:
            tops[a] = b
            joins[k] = True
    return joins


def _compare(groups: DataFrame, params: DedupParams, what: str) -> DataFrame:
    """(u, v) for likely pairs of different labels in small nodes.

    ``forest``: a spanning forest of the likeliest.  ``few``: every pair of a node
    with at most ``FEW`` a member; of other nodes the members in such pairs, as (u, u).
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, labels, sizes, sketches in zip(*(batch.column(c) for c in ("docs", "labels", "sizes", "sketches")), strict=True):
                docs, labels, sizes = (x.values.to_numpy() for x in (docs, labels, sizes))
                s = np.frombuffer(b"".join(sketches.as_py()), np.uint8).reshape(len(docs), -1)
                i, j = _likely_pairs(labels, sizes, s, params)
                if what == "forest":
                    joins = _forest(labels[i], labels[j])
                    i, j = i[joins], j[joins]
                elif len(i) > FEW * len(docs):
                    i = j = np.unique(np.concatenate((i, j)))
                u, v = np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return groups.mapInArrow(compared, "u long, v long")


def _branches(node: np.ndarray, s: np.ndarray, two: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for one step down from each row's node: one branch, or with probability ``two`` a second one."""
    rows, width = np.arange(len(node)), s.shape[1]
    first = (mix(node + np.uint64(1)) % np.uint64(width)).astype(np.int64)
    more = rows[(mix(node + np.uint64(5)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < two]
    second = (first[more] + 1 + (mix(node[more] + np.uint64(2)) % np.uint64(width - 1)).astype(np.int64)) % width
    child = lambda r, at, salt: mix(mix(node[r] + np.uint64(salt)) ^ mix(s[r, at].astype(np.uint64) + np.uint64(977)))
    return np.concatenate((rows, more)), np.concatenate((child(rows, first, 3), child(more, second, 4)))


def _children(rows: DataFrame, params: DedupParams) -> DataFrame:
    """(node, doc): the members of nodes (with their ``steps`` and sketches) so many branchings further down."""
    two = 1 / params.threshold - 1

    def branched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(len(batch), -1)
            at, node, left = np.arange(len(batch)), batch["node"].to_numpy(np.int64).astype(np.uint64), batch["steps"].to_numpy(np.int64)
            done: list[tuple[np.ndarray, np.ndarray]] = []
            while len(at):
                row, child = _branches(node, s[at], two)
                at, node, left = at[row], child, left[row] - 1
                done.append((at[left == 0], node[left == 0]))
                at, node, left = at[left > 0], node[left > 0], left[left > 0]
            for at, node in done:
                yield pd.DataFrame({"node": node.astype(np.int64), "doc": batch["doc"].to_numpy()[at]})

    return rows.select("node", "doc", "sketch", "steps").mapInPandas(branched, "node long, doc long")


def _company(rows: DataFrame) -> DataFrame:
    """The rows of nodes with two members or more."""
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), "node")


def _labelled(rows: DataFrame, labels: DataFrame | None, key: str, name: str) -> DataFrame:
    """``rows`` with the component label of column ``key``, which is its own label when it has no link yet."""
    if labels is None:
        return rows.withColumn(name, F.col(key))
    side = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(side, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", key)).drop("_node", "_label")


def _confirmed(pairs: DataFrame, docs: DataFrame, params: DedupParams) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id")
    near = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    near = near.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            good = []
            others = shingle_sets(list(batch["text_v"]), params.shingle)
            for u, v, text, other in zip(batch["u"], batch["v"], batch["text_u"], others, strict=True):
                if text != known[0]:
                    known = (text, next(shingle_sets([text], params.shingle)))
                both = len(np.intersect1d(known[1], other, assume_unique=True))
                if 100 * both >= params.percent * (len(known[1]) + len(other) - both):
                    good.append((u, v))
            yield pd.DataFrame(good, columns=["u", "v"])

    return near.select("u", "v", "text_u", "text_v").mapInPandas(confirmed, "u long, v long")


class _Links:
    """Confirmed links so far, as labels; adding links joins components."""

    def __init__(self, docs: DataFrame, params: DedupParams, space: Workspace) -> None:
        self.docs, self.params, self.space, self.labels = docs, params, space, None

    def join(self, found: DataFrame) -> None:
        """Add confirmed links (u, v)."""
        if self.labels is not None:
            found = found.unionByName(self.labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
        self.labels = components(found, self.space)

    def add(self, pairs: DataFrame) -> None:
        """Confirm those pairs whose ends are still apart."""
        apart = self.space.save(_labelled(_labelled(pairs.select("u", "v").distinct(), self.labels, "u", "_lu"), self.labels, "v", "_lv").where("_lu <> _lv").select("u", "v"))
        if not apart.isEmpty():
            self.join(_confirmed(apart, self.docs, self.params))
        self.space.drop(apart)


def _open_nodes(rows: DataFrame, links: _Links) -> DataFrame:
    """``rows`` with label and ``members``, of those nodes whose members are not all connected."""
    labelled = _labelled(rows, links.labels, "doc", "label")
    nodes = labelled.groupBy("node").agg(F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return links.space.save(labelled.join(nodes.where("lo <> hi").select("node", "members"), "node"))


def _bytes_of(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), width)


def _with_pivots(large: DataFrame) -> DataFrame:
    """Rows of large nodes with the pivot's doc, label, size and sketch."""
    sampled = F.pmod(F.xxhash64("node", "doc"), F.col("members")) < SAMPLE
    samples = large.where(sampled).groupBy("node").agg(F.collect_list("sketch").alias("others"))

    @F.pandas_udf("double")
    def centrality(sketches: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([float(_agreement(_bytes_of(o, TOKENS), np.frombuffer(s, np.uint8)).mean()) if o is not None and len(o) else 0.0 for s, o in zip(sketches, others, strict=True)])

    scored = large.join(samples, "node", "left").select("node", "doc", "label", "n", "sketch", centrality("sketch", "others").alias("score"))
    pivots = scored.groupBy("node").agg(F.max(F.struct("score", "doc", "label", "n", "sketch")).alias("p"))
    return large.join(pivots.select("node", F.col("p.doc").alias("pivot"), F.col("p.label").alias("pivot_label"), F.col("p.n").alias("pivot_n"), F.col("p.sketch").alias("pivot_sketch")), "node")


def _star_pairs(large: DataFrame, params: DedupParams) -> DataFrame:
    """(u, v): likely pairs of a large node's pivot and its members of other components."""
    sized = (F.col("label") != F.col("pivot_label")) & (100 * F.least("n", "pivot_n") >= params.percent * F.greatest("n", "pivot_n"))

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_agreement(_bytes_of(a, TOKENS), _bytes_of(b, TOKENS)), dtype="float64")

    near = _with_pivots(large).where(sized).where(likeness("sketch", "pivot_sketch") >= params.floor(TOKENS))
    return near.select(F.least("pivot", "doc").alias("u"), F.greatest("pivot", "doc").alias("v")).where("u <> v")


def _groups(small: DataFrame) -> DataFrame:
    member = F.sort_array(F.collect_list(F.struct("doc", "label", "n", "sketch")))
    return small.groupBy("node").agg(member.alias("m")).select(F.col("m.doc").alias("docs"), F.col("m.label").alias("labels"), F.col("m.n").alias("sizes"), F.col("m.sketch").alias("sketches"))


def _full_sets(docs: DataFrame, ids: DataFrame, params: DedupParams) -> DataFrame:
    """(doc, n, sketch, hashes) for the documents of ``ids`` (doc): ``WIDE`` tokens and the whole set."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(ids) if few else ids, "doc")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = zip(batch["doc"], shingle_sets(list(batch["text"]), params.shingle), strict=True)
            rows = [(doc, len(x), _short(tokens_of(x, params.seed, WIDE)), x.tobytes()) for doc, x in found if len(x)]
            yield pd.DataFrame(rows, columns=["doc", "n", "sketch", "hashes"])

    made = texts.select("doc", "text").mapInPandas(sets, "doc long, n long, sketch binary, hashes binary")
    return made.dropDuplicates(["doc", "n", "sketch"])


def links_inside(docs: np.ndarray, labels: np.ndarray, hashes: list[bytes], percent: int) -> tuple[list[int], list[int]]:
    """Confirmed links between the labels of one unit: a spanning forest, so fewer than there are labels.

    Sets are compared in order of size with all larger ones that can reach the
    threshold and are not yet connected to them, by exact intersections.
    """
    sizes = np.array([len(h) // 8 for h in hashes])
    order = np.argsort(sizes, kind="stable")
    docs, sizes, known = docs[order], sizes[order], np.unique(labels[order], return_inverse=True)[1]
    vocabulary, ids = np.unique(np.frombuffer(b"".join(hashes[k] for k in order), np.uint64), return_inverse=True)
    ids, ends = ids.astype(np.int32), np.cumsum(sizes)
    mine, left, right = np.zeros(len(vocabulary), bool), [], []
    last = np.searchsorted(percent * sizes, 100 * sizes, side="right")  # sets from here on are too large
    for i in range(len(docs) - 1):
        apart = known[i + 1 : last[i]] != known[i]
        if not apart.any():
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        mine[own] = True
        both = np.add.reduceat(mine[ids[ends[i] : ends[last[i] - 1]]], ends[i : last[i] - 1] - ends[i], dtype=np.int64)
        mine[own] = False
        near = i + 1 + np.flatnonzero(apart & (100 * both >= percent * (sizes[i] + sizes[i + 1 : last[i]] - both)))
        joined, first = np.unique(known[near], return_index=True)
        if len(near):
            left += [int(docs[i])] * len(joined)
            right += docs[near[first]].tolist()
            known[np.isin(known, joined)] = known[i]
    return left, right


def _units(rows: DataFrame) -> DataFrame:
    """(node, lo, hi, doc, label, hashes): nodes in units of bounded size, in which any two members of a node meet.

    A node too large for one unit is dealt into blocks, and every two blocks make a unit.
    """
    nodes = rows.groupBy("node").agg(F.ceil(F.greatest(F.count("*") / SMALL_WIDE, F.sum("n") / UNIT_HASHES)).cast("int").alias("parts"))
    parts = F.when(F.col("parts") > 1, 2 * F.col("parts")).otherwise(F.lit(1))  # a unit holds two blocks
    dealt = rows.join(nodes.withColumn("parts", parts), "node").withColumn("block", F.pmod(F.xxhash64("doc", "node"), F.col("parts")).cast("int"))
    other = F.expr("if(parts = 1, array(0), filter(sequence(0, parts - 1), x -> x <> block))")
    return dealt.withColumn("other", F.explode(other)).select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "label", "hashes")


def _linked(rows: DataFrame, params: DedupParams) -> DataFrame:
    """(u, v): exact links between the components of each node's members (node, doc, label, n, hashes)."""
    member = F.collect_list(F.struct("doc", "label", "hashes")).alias("m")
    units = _units(rows).groupBy("node", "lo", "hi").agg(member).select(F.col("m.doc").alias("docs"), F.col("m.label").alias("labels"), F.col("m.hashes").alias("hashes"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, labels, hashes in zip(*(batch.column(c) for c in ("docs", "labels", "hashes")), strict=True):
                u, v = links_inside(docs.values.to_numpy(), labels.values.to_numpy(), hashes.as_py(), params.percent)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return units.mapInArrow(linked, "u long, v long")


def _second_round(members: DataFrame, docs: DataFrame, links: _Links, params: DedupParams, depth: int) -> None:
    """Trees over the members (doc) that the first round leaves open; whole sets meet in their leaves.

    Nodes that no token splits are compared as they are, in more units.
    """
    space = links.space
    sets = space.save(_full_sets(docs, members, params))
    trees = F.explode(F.sequence(F.lit(1), F.lit(params.trees(depth))))
    rows = members.withColumn("tree", trees).select("doc", F.xxhash64(F.lit(params.seed), "tree").alias("node"), F.lit(1).alias("steps"))
    leaves = []
    for step in range(ROUNDS):
        below = space.save(_children(rows.join(sets.select("doc", "sketch"), "doc"), params))
        level = _open_nodes(below, links)
        space.drop(below)
        done = F.col("members") <= SMALL_WIDE
        leaves.append(level if step == ROUNDS - 1 else level.where(done))
        large = level.where(~done)
        if large.isEmpty():
            break
        steps = F.greatest(F.lit(1), F.floor(F.log2(F.col("members") / SMALL_WIDE) / 2 + 0.5)).cast("int")
        rows = large.select("node", "doc", steps.alias("steps"))
    every = functools.reduce(DataFrame.unionByName, leaves).select("node", "doc", "label")
    links.join(_linked(every.join(sets.select("doc", "n", "hashes"), "doc"), params))


def link_classes(classes: DataFrame, docs: DataFrame, params: DedupParams, space: Workspace) -> DataFrame | None:
    """(node, label) over classes (doc, n, sketch, roots), or None if nothing can link."""
    links = _Links(docs, params, space)
    roots = _company(classes.select("doc", "n", F.explode("roots").alias("node")))
    level = _open_nodes(roots.join(classes.select("doc", "sketch"), "doc").select("node", "doc", "n", "sketch"), links)
    small, large = F.col("members") <= SMALL, F.col("members") > SMALL
    links.add(_compare(_groups(level.where(small)), params, "forest").unionByName(_star_pairs(level.where(large), params)))
    again = _open_nodes(level.select("node", "doc", "n", "sketch"), links)
    found = space.save(_compare(_groups(again.where(small)), params, "few").distinct())
    links.add(found.where("u <> v"))
    crowded = again.where(large).groupBy("doc").agg(F.count("*").alias("k")).where(F.col("k") > params.spare).select("doc")
    members = space.save(found.where("u = v").select(F.col("u").alias("doc")).unionByName(crowded).distinct())
    if not members.isEmpty():
        largest = again.join(members, "doc").groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        depth = 2 + math.ceil(math.log(max(1.0, largest / SMALL_WIDE)) / -math.log(SHRINK))
        _second_round(members, docs, links, params, depth)
    return links.labels


def near_duplicates(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    space = Workspace(docs.sparkSession, "near-dedup")
    described = space.save(describe(docs, params))
    full = described.where("n > 0 and doc_id is not null")
    classes = space.save(full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots")))
    labels = link_classes(classes, docs, params, space)
    tops = _labelled(classes.select("digest", "doc"), labels, "doc", "top").select(F.col("digest").alias("_digest"), "top")
    linked = full.select("doc_id", "n", "digest").join(tops, F.col("digest") == F.col("_digest")).select("doc_id", "n", F.col("top").alias("component_id"))
    single = described.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(single)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """The rows of ``docs`` whose document is kept."""
    (gone,) = unused(docs, "gone")
    judged = near_duplicates(docs, params)
    others = judged.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")
