"""Best-fit packing of token pieces, by the linear grouping scheme.

Method.  A document's ids, ended by ``end_id``, are cut into pieces of at most
``capacity`` tokens (only the first may be shorter).  Lengths above
``capacity / small_part`` are large: sorted, they fall into ``groups`` groups of
equal cardinality, and every length is rounded up to its group's largest.  For
these few sizes the configurations with the fewest sequences are found by a linear
programme over all of them (column generation); they are used in whole times, and
the few pieces left over are completed by knapsacks.  Actual pieces then take the
places of the rounded ones, which opens gaps; the pieces of configurations that
have room for another large one, and the small ones, go, largest first, where they
fit best, and fill new sequences when they fit nowhere.

Scale.  All pieces of one length are alike, so the plan needs only the number of
pieces of each length: at most ``capacity`` numbers reach the driver, whatever
the input.  The plan is a list of runs, each saying which pieces of a length
(by rank) go to which sequences.  A run ends where a configuration, a length or a
gap does, so there are at most a few for each length and group, whatever the
input (some 15,000 slots at the defaults), and the plan may go to every task, where
slots are found by binary search.  Ranks inside a length are row numbers inside
``salts`` seeded salts plus the salts' running counts, so one very common length
is spread over many tasks; the table of these counts has at most ``capacity *
salts`` rows.  Tokens are made in one map; only (doc_id, piece, length, checksum)
rows move.

Tokenizing.  A file that describes a plain byte-level vocabulary, which is checked
in full, is read by ``tiktoken``, some five times as fast; any other goes to the
``tokenizers`` library.

Defined cases.  Null text is empty; an empty text is the end id alone.  Very long
texts are cut, never shortened.  Rows that repeat a doc_id are packed each.
Ties in rank are broken by checksum.  An empty table gives an empty result.
``pack_documents`` leaves extra columns out; ``pack`` keeps them, but for those
with the name of an output column.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waybill.llm.naming import unused
from waybill.llm.workspace import checkpointed

RANK_BITS = 46
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class PackParams:
    capacity: int = 1024
    end_id: int = 2
    groups: int = 64
    small_part: int = 4
    steps: int = 5_000
    salts: int = 256


def bytes_of(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Tokens in the byte-level alphabet as bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items()}


def is_plain_byte_level(spec: dict) -> bool:
    """Whether ids follow from the ranks of byte strings alone: a byte-level BPE, merged in the order of its ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel":
        return False
    if split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if any(model.get(x) for x in options) or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return False
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {token: rank for token, rank in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = [vocabulary.get(a + b, -1) for a, b in merges]
    single = {token for token in vocabulary if len(token) == 1}
    made = {a + b for a, b in merges}
    return len(single) == 256 and ranks == sorted(set(ranks)) and made | single == set(vocabulary) and max(vocabulary[t] for t in single) < min(ranks, default=256)


@functools.lru_cache(2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """From a text to its ids, without special tokens of its own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not is_plain_byte_level(spec):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = bytes_of({token: rank for token, rank in spec["model"]["vocab"].items() if token not in special})
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode(text, allowed_special="all")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    first = total % capacity or capacity
    ends = range(first, total + 1, capacity)
    return [(0 if e == first else e - capacity, first if e == first else capacity) for e in ends]


def tokenize(docs: DataFrame, path: str, params: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """A row for each piece of every whole text; with ``ids`` if asked for."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array(encode(text or "") + [params.end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), params.capacity)):
                    own = ids[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int64))[: 6 if with_ids else 5])
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            yield pd.DataFrame(rows, columns=names)

    # Ids travel as text: pandas turns whole numbers beside nulls into floats.
    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(pieces, PIECES + (", ids array<long>" if with_ids else ""))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass
class Run:
    """``count`` equal sequences: slots are (length, first rank); slot ``i`` of sequence ``j`` takes rank ``first + j``."""

    count: int
    slots: list[tuple[int, int]]

    @property
    def used(self) -> int:
        return sum(length for length, _ in self.slots)

    def split(self, at: int) -> tuple[Run, Run]:
        return Run(at, self.slots), Run(self.count - at, [(length, rank + at) for length, rank in self.slots])


def grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Equal-cardinality groups of lengths, longest first: how many pieces are rounded up to each group's largest."""
    total, seen, out = sum(counts.values()), 0, dict[int, int]()
    top, group = 0, -1
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            now = seen * groups // total
            if now > group:
                top, group = length, now
            n = min(left, -(-(now + 1) * total // groups) - seen)
            out[top] = out.get(top, 0) + n
            left, seen = left - n, seen + n
    return out


def knapsack(sizes: list[int], counts: list[int], room: int, first: int) -> list[int]:
    """How many of each size from index ``first`` on fill ``room`` best, larger ones preferred."""
    last = np.full(room + 1, -1)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    for g in range(first, len(sizes)):
        size = sizes[g]
        if size > room or not counts[g]:
            continue
        front = reach
        for _ in range(min(counts[g], room // size)):
            new = np.zeros(room + 1, bool)
            new[size:] = front[:-size]
            new &= ~reach
            if not new.any():
                break
            reach, front = reach | new, new
            last[new] = g
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    used = [0] * len(sizes)
    while at:
        used[last[at]] += 1
        at -= sizes[last[at]]
    return used


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The uses of each size that fit a sequence and have the greatest worth together."""
    layers, choices = [np.full(capacity + 1, -np.inf)], []
    layers[0][0] = 0.0
    before = np.arange(capacity + 1)[None, :] - sizes[:, None]
    for _ in range(capacity // int(sizes.min())):
        values = np.where(before >= 0, layers[-1][np.maximum(before, 0)] + worth[:, None], -np.inf)
        choices.append(values.argmax(axis=0))
        layers.append(values.max(axis=0))
    n, at = np.unravel_index(int(np.argmax(layers)), (len(layers), capacity + 1))
    value, used = float(layers[n][at]), np.zeros(len(sizes), np.int64)
    while n:
        g = int(choices[n - 1][at])
        used[g] += 1
        n, at = n - 1, at - int(sizes[g])
    return value, used


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int) -> list[tuple[float, list[int]]]:
    """(times, uses of each size): fewest sequences that take every size as often as it occurs, in fractions.

    The linear programme over all configurations, by column generation: the basis
    starts from configurations of one size and takes in the one of the greatest
    worth under the duals, until none is worth more than a sequence.
    """
    columns, costs = list(np.diag(capacity // sizes).astype(np.float64)), np.ones(len(sizes))
    for _ in range(steps):
        basis = np.array(columns).T
        worth = np.linalg.solve(basis.T, costs)
        if worth.min() < -1e-9:  # more than the demand may be taken
            entering, cost = -np.eye(len(sizes))[int(worth.argmin())], 0.0
        else:
            value, used = best_configuration(sizes, worth, capacity)
            if value <= 1 + 1e-7:
                break
            entering, cost = used.astype(np.float64), 1.0
        times, change = np.linalg.solve(basis, np.column_stack([demand, entering])).T
        able = change > 1e-9
        out = int(np.argmin(np.where(able, np.maximum(times, 0) / np.where(able, change, 1.0), np.inf)))
        columns[out], costs[out] = entering, cost
    times = np.linalg.solve(np.array(columns).T, demand)
    return [(float(t), [int(x) for x in c]) for t, c, cost in zip(times, columns, costs, strict=True) if cost and t > 0]


def configurations(sizes: list[int], counts: list[int], params: PackParams) -> list[tuple[int, list[int]]]:
    """(times, uses of each size) that take all pieces: the programme's, in whole times, and the rest by knapsacks."""
    left, out = list(counts), []

    def use(times: int, used: list[int]) -> None:
        times = min([times, *(left[g] // u for g, u in enumerate(used) if u)])
        if times > 0:
            out.append((times, used))
            left[:] = [n - times * u for n, u in zip(left, used, strict=True)]

    if sizes:
        for times, used in fractional(np.array(sizes), np.array(counts, np.float64), params.capacity, params.steps):
            use(int(times + 1e-6), used)
    for first in range(len(sizes)):
        while left[first]:
            spare = list(left)
            spare[first] -= 1
            used = knapsack(sizes, spare, params.capacity - sizes[first], first)
            used[first] += 1
            use(left[first], used)
    return out


def substitute(planned: list[tuple[int, list[int]]], sizes: list[int], counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Runs with actual lengths in the place of rounded sizes, and the ranks of each length that are used.

    The fullest configurations come first.  A slot takes the longest piece of at
    most its size; the last slot of a sequence takes the longest that the room
    really left admits, so rounding is lost in few sequences.
    """
    left, ranks, out = dict(counts), dict.fromkeys(counts, 0), []
    lengths = sorted(counts)

    def longest(most: int, taken: list[int]) -> int | None:
        at = bisect.bisect_right(lengths, most) - 1
        while at >= 0 and left[lengths[at]] <= taken.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else None

    for times, used in sorted(planned, key=lambda p: -sum(u * s for u, s in zip(p[1], sizes, strict=True))):
        slots = [s for s, u in zip(sizes, used, strict=True) for _ in range(u)]
        while times:
            taken: list[int] = []
            for k, size in enumerate(slots):
                found = longest(size if k < len(slots) - 1 else capacity - sum(taken), taken)
                if found is not None:
                    taken.append(found)
            if not taken:
                break
            n = min([times, *(left[x] // taken.count(x) for x in taken)])
            run = Run(n, [])
            for x in taken:
                run.slots.append((x, ranks[x]))
                ranks[x] += n
                left[x] -= n
            out.append(run)
            times -= n
            if len(lengths) > 64 and sum(not left[x] for x in lengths) > len(lengths) // 2:
                lengths = [x for x in lengths if left[x]]
    return out, ranks


def plan(counts: dict[int, int], params: PackParams) -> list[Run]:
    """Runs of sequences that hold every piece of the given length counts."""
    full = counts.get(params.capacity, 0)
    runs = [Run(full, [(params.capacity, 0)])] if full else []
    limit = params.capacity // params.small_part
    large = {k: n for k, n in counts.items() if limit < k < params.capacity and n}
    sizes = grouped(large, params.groups)
    planned = configurations(list(sizes), list(sizes.values()), params)
    tight = params.capacity - limit  # what leaves room for one more large piece is left to best fit
    planned = [(times, used) for times, used in planned if sum(u * s for u, s in zip(used, sizes, strict=True)) >= tight]
    filled, ranks = substitute(planned, list(sizes), large, params.capacity)
    rest = {k: (ranks.get(k, 0), n - ranks.get(k, 0)) for k, n in counts.items() if k < params.capacity and n > ranks.get(k, 0)}
    return runs + _best_fit(filled, rest, params.capacity)


def _best_fit(runs: list[Run], small: dict[int, tuple[int, int]], capacity: int) -> list[Run]:
    by_gap: dict[int, list[Run]] = {}
    for run in runs:
        by_gap.setdefault(capacity - run.used, []).append(run)
    for length in sorted(small, reverse=True):
        rank, left = small[length]
        while left:
            gap = min((g for g, r in by_gap.items() if g >= length and r), default=None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(left, each)
                if whole:
                    by_gap.setdefault(capacity - each * length, []).append(Run(whole, [(length, rank + i * whole) for i in range(each)]))
                if rest:
                    by_gap.setdefault(capacity - rest * length, []).append(Run(1, [(length, rank + each * whole + i) for i in range(rest)]))
                break
            run = by_gap[gap].pop()
            if run.count > left:
                run, other = run.split(left)
                by_gap[gap].append(other)
            by_gap.setdefault(gap - length, []).append(Run(run.count, [*run.slots, (length, rank)]))
            rank, left = rank + run.count, left - run.count
    return [run for same in by_gap.values() for run in same]


def pack(pieces: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; of its columns only ``length`` must be there."""
    spark, rows = pieces.sparkSession, pieces.drop("sequence_id", "offset")
    salt, row, rank, before, place, key_length, key_salt = unused(rows, "salt", "row", "rank", "before", "place", "key_length", "key_salt")
    keys = [c for c in ("doc_id", "piece", "ids_crc32") if c in rows.columns]
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*keys) if keys else F.monotonically_increasing_id(), F.lit(params.salts)))
    counted = checkpointed(salted.groupBy("length", salt).agg(F.count("*").alias("n")))  # at most capacity x salts rows
    counts = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence = [], 0
    for run in plan(counts, params):
        offset = 0
        for length, first in run.slots:
            slots.append((length, first, sequence - first, offset))
            offset += length
        sequence += run.count
    slots.sort()
    lengths, firsts, shifts, offsets = np.array(slots, np.int64).reshape(-1, 4).T
    shared = spark.sparkContext.broadcast(((lengths << RANK_BITS) + firsts, shifts, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        starts, shift, offset = shared.value
        at = np.searchsorted(starts, (length.to_numpy(np.int64) << RANK_BITS) + ranks.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": ranks.to_numpy(np.int64) + shift[at], "offset": offset[at]})

    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select(F.col("length").alias(key_length), F.col(salt).alias(key_salt), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    order = Window.partitionBy("length", salt).orderBy(*(keys or [F.lit(0)]))
    ranked = salted.withColumn(row, F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(bases), (F.col("length") == F.col(key_length)) & (F.col(salt) == F.col(key_salt)))
    ranked = ranked.withColumn(rank, F.col(row) + F.col(before)).withColumn(place, placed("length", rank))
    out = ranked.withColumns({"sequence_id": F.col(f"{place}.sequence_id"), "offset": F.col(f"{place}.offset")})
    return out.drop(salt, row, rank, before, place, key_length, key_salt)


def pack_documents(docs: DataFrame, tokenizer: str, params: PackParams = PackParams()) -> DataFrame:
    """Tokenize and pack whole documents; the pieces are checkpointed, as they are read twice."""
    return pack(checkpointed(tokenize(docs, tokenizer, params)), params)


def sequences(docs: DataFrame, tokenizer: str, params: PackParams = PackParams()) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, at most ``capacity`` each."""
    packed = pack(checkpointed(tokenize(docs, tokenizer, params, with_ids=True)), params)
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
