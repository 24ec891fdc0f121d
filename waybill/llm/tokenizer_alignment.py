"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Method.  Every text is encoded by a byte-level vocabulary (A, of a space and the
text) and by a piece vocabulary (B, which adds that space itself).  Both are cut
at the byte offsets where tokens of both end; tokens whose byte ranges overlap are
linked.  A pair of ids is one packed 64-bit key, ``a << 32 | b``.  ``np.unique``
counts the keys of the documents of each partition; these partial counts are range
partitioned by key, sorted, and runs of equal keys are summed.  Each range becomes a
shard, two flat files of keys and counts in the folder that driver and executors
share.  Lookups map the shards into memory and search them with ``searchsorted``.

Scale.  A text is encoded once; its distinct keys and how often each occurs are kept
beside its numbers (byte planes of sorted keys, which pack well), and texts are never
shuffled.  A pair that every document has is one row for each partition and flush
of ``flush`` keys.  The driver holds the list of shards and one number for each id
of A, both bounded (by partitions and by the vocabulary).  A lookup goes through
the distinct keys of a batch in order and reads only the pages it needs, so memory
follows the batch, not the table.  A shard is named by the attempt that wrote it and
listed by the attempt that ended, so lost executors and repeated tasks leave no
shard half written; a folder that is no file system of the machine is read through
``pyarrow.fs``, one range of keys at a time.

Defined cases.  A text that is null, empty, or that a vocabulary does not give back
byte for byte has no tokens: zeros and ''.  Special tokens inside texts are plain
text.  Very long texts are encoded whole.  Rows that repeat a doc_id are documents
each, and count each.  Ties for the highest count of an A id all count as best.  A
null doc_id stays null.  An empty table gives an empty result.  Extra columns are
left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waybill.llm.packing import PATTERN, bytes_of, is_plain_byte_level
from waybill.llm.workspace import Workspace, shared_folder

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
LISTED = "shard string, first long, last long, length long, a long, best long"
_SPACE = "▁"


@dataclass(frozen=True)
class AlignParams:
    """Keys that a task holds before it gives out partial counts."""

    flush: int = 4_000_000


@dataclass(frozen=True)
class Side:
    """A vocabulary in use: from a text to its ids, and the bytes of every id; ``exact`` if these are the text's by construction."""

    encode: Callable[[str], list[int]]
    bytes_of: list[bytes]
    lengths: np.ndarray
    exact: bool

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _side(encode: Callable[[str], list[int]], by_id: list[bytes], exact: bool = False) -> Side:
    return Side(encode, by_id, np.array([len(b) for b in by_id], np.int64), exact)


@functools.lru_cache(2)
def _names(n: int) -> list[str]:
    """Decimal ids below ``n``, each with the three signs that may follow it."""
    return [f"{i}{after}" for i in range(n) for after in ",|;"]


@functools.lru_cache(2)
def byte_side(path: str) -> Side:
    """A byte-level vocabulary, fed with a space and the text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = bytes_of({token: rank for token, rank in spec["model"]["vocab"].items() if token not in special})
    by_id = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for token, rank in ranks.items():
        by_id[rank] = token
    if is_plain_byte_level(spec):
        fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return _side(lambda text: fast.encode_ordinary(" " + text), by_id, exact=True)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return _side(lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids, by_id)


@functools.lru_cache(2)
def piece_side(path: str) -> Side:
    """A piece vocabulary, which adds the space itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    by_id = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        by_id.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return _side(lambda text: model.encode(text), by_id)


@dataclass(frozen=True)
class Alignment:
    """The tokens of a text on both sides, where they stand among the tokens of all groups, and the links in order of their bytes."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    place_a: np.ndarray
    place_b: np.ndarray
    n_groups: int
    links: np.ndarray

    def groups(self) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group, by a table of ids with what follows them."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        last = lambda g: np.diff(g, append=-1) != 0
        out[self.place_a] = 3 * self.a + last(self.group_a)
        out[self.place_b] = 3 * self.b + 2 * last(self.group_b)
        names = _names(1 << int(max(self.a.max(), self.b.max())).bit_length())
        return "".join(map(names.__getitem__, out.tolist()))[:-1]


def align(text: str | None, first: Side, second: Side) -> Alignment | None:
    """The alignment of a text; none where a side does not give the text's bytes back."""
    if not text:
        return None
    wanted = b" " + text.encode()
    ids = first.encode(text), second.encode(text)
    a, b = (np.array(x, np.int64) for x in ids)
    ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    if not len(a) or not len(b) or ends_a[-1] != len(wanted) or ends_b[-1] != len(wanted):
        return None
    if any(not side.exact and side.joined(x) != wanted for side, x in zip((first, second), ids, strict=True)):
        return None
    end_a, end_b = np.zeros((2, len(wanted) + 1), np.int32)  # by bytes: whether a token ends there
    end_a[ends_a] = end_b[ends_b] = 1
    end_both = end_a & end_b
    before_a, before_b, before_both = (np.cumsum(x) - x for x in (end_a, end_b, end_both))  # how many end earlier
    cuts = np.flatnonzero(end_a | end_b)  # between two cuts lie one token of A and one of B, and no other cut has both
    links = a[before_a[cuts]] << 32 | b[before_b[cuts]]
    shared = np.flatnonzero(end_both)
    group_a, group_b = before_both[ends_a], before_both[ends_b]
    place_a = np.arange(len(a)) + np.append(0, before_b[shared] + 1)[group_a]
    place_b = np.arange(len(b)) + (before_a[shared] + 1)[group_b]
    return Alignment(a, b, group_a, group_b, place_a, place_b, len(shared), links)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of the bytes of their differences."""
    steps = np.diff(keys, prepend=0).astype(">u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel()
    return np.cumsum(steps.astype(np.int64))


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Counts and group hash of every text, with its distinct pair keys and how many links have each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_side(byte_path), piece_side(piece_path)
        empty = (0, 0, 0, 0, "", b"", b"")
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = align(text.as_py(), first, second)
                if found is None:
                    rows.append(empty)
                    continue
                keys, times = np.unique(found.links, return_counts=True)
                digest = hashlib.sha256(found.groups().encode()).hexdigest()
                rows.append((len(found.a), len(found.b), found.n_groups, len(found.links), digest, packed(keys), times.astype("<u4").tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2, strict=True)] if rows else None
            if columns:
                yield pa.record_batch([batch["doc_id"], *columns], [f.split(" ")[0] for f in ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, ALIGNED)


def partial_counts(rows: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """(key, n): how many documents of a part of a partition have a pair."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty(0, np.int64)], 0

        def counts() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([keys, n.astype(np.int64)], ["key", "n"])

        for batch in batches:
            for pairs in batch["pairs"]:
                held.append(unpacked(pairs.as_py()))
                size += len(held[-1])
                if size > params.flush:
                    yield counts()
                    held, size = held[:1], 0
        yield counts()

    return rows.select("pairs").where("length(pairs) > 0").mapInArrow(counted, "key long, n long")


class Shards:
    """Sorted counts in flat files; lookups of sorted keys."""

    def __init__(self, folder: str, listed: list[tuple[str, int, int]]) -> None:
        """``listed``: name, first and last key of every shard, in order of keys."""
        self.folder, self.listed = folder, listed

    @staticmethod
    def local(folder: str) -> str | None:
        """The folder's place in the machine's own file system, if it is there."""
        if folder.startswith("file:"):
            return "/" + folder.removeprefix("file:").lstrip("/")
        return folder if folder.startswith("/") else None

    @staticmethod
    def opened(folder: str, name: str) -> np.ndarray:
        """A flat file of 64-bit numbers, mapped into memory where the folder is local."""
        if (place := Shards.local(folder)) is not None:
            return np.memmap(os.path.join(place, name), "<i8", "r")
        store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), "<i8")

    @staticmethod
    def created(folder: str, name: str) -> BinaryIO:
        """A new flat file to write to."""
        if (place := Shards.local(folder)) is not None:
            os.makedirs(place, exist_ok=True)
            return open(os.path.join(place, name), "wb")
        store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which are there."""
        out = np.zeros(len(keys), np.int64)
        for name, first, last in self.listed:
            i, j = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if i < j:
                own = Shards.opened(self.folder, f"{name}.keys")
                at = np.searchsorted(own, keys[i:j])
                if (own[at] != keys[i:j]).any():
                    raise LookupError("a pair has no count")
                out[i:j] = Shards.opened(self.folder, f"{name}.counts")[at]
        return out


def summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted partial counts with runs of one key summed, also where batches meet."""
    key, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate([key, batch["key"].to_numpy()])
        counts = np.concatenate([n, batch["n"].to_numpy()])
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        yield keys[:-1], counts[:-1]
        key, n = keys[-1:], counts[-1:]
    yield key, n


def write_shards(partial: DataFrame, folder: str) -> DataFrame:
    """A row for each A id of each shard: the shard, its range of keys and length, and the id's highest count there."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        first, last, length, best = 0, 0, 0, dict[int, int]()
        with Shards.created(folder, f"{name}.keys") as key_file, Shards.created(folder, f"{name}.counts") as count_file:
            for keys, counts in summed_runs(batches):
                if not len(keys):
                    continue
                first, last, length = first if length else keys[0], keys[-1], length + len(keys)
                key_file.write(keys.astype("<i8").tobytes())
                count_file.write(counts.astype("<i8").tobytes())
                owners = keys >> 32
                starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
                for a, n in zip(owners[starts].tolist(), np.maximum.reduceat(counts, starts).tolist(), strict=True):
                    best[a] = max(n, best.get(a, 0))
        if length:
            n = len(best)
            yield pa.record_batch([[name] * n, *(np.full(n, x, np.int64) for x in (first, last, length)), np.array(list(best), np.int64), np.array(list(best.values()), np.int64)], [f.split(" ")[0] for f in LISTED.split(", ")])

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(written, LISTED)


def document_frequencies(rows: DataFrame, space: Workspace, params: AlignParams = AlignParams()) -> tuple[Shards, np.ndarray]:
    """The shards of all pairs' document counts, and the highest count of every A id (0 for those that do not occur)."""
    folder = shared_folder(rows.sparkSession, "pair-counts")
    listed = space.save(write_shards(partial_counts(rows, params), folder))
    shards = [(r["shard"], r["first"], r["last"]) for r in listed.groupBy("shard").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first").collect()]
    tops = listed.groupBy("a").agg(F.max("best").alias("best")).collect()  # at most one row for each id of A
    highest = np.zeros(1 + max((r["a"] for r in tops), default=0), np.int64)
    for r in tops:
        highest[r["a"]] = r["best"]
    return Shards(folder, shards), highest


def with_counts(rows: DataFrame, shards: Shards, highest: np.ndarray) -> DataFrame:
    """Aligned rows with ``n_best`` and ``count_sum`` in the place of their keys."""
    shared = rows.sparkSession.sparkContext.broadcast(highest)  # one number for each id of A

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [unpacked(x.as_py()) for x in batch["pairs"]]
            times = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in batch["times"]] or [np.empty(0, "<u4")]).astype(np.int64)
            ends = np.cumsum([0, *map(len, keys)])
            distinct, at = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)
            counts = shards.counts(distinct)
            best = counts == shared.value[distinct >> 32]
            sums = [np.r_[0, np.cumsum(x)] for x in (times * best[at], times * counts[at])]
            totals = [x[ends[1:]] - x[ends[:-1]] for x in sums]
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *totals, batch["groups_sha256"]], [f.split(" ")[0] for f in COUNTED.split(", ")])

    return rows.mapInArrow(looked_up, COUNTED)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, params: AlignParams = AlignParams()) -> DataFrame:
    """The alignment of every document, judged by the counts of all."""
    space = Workspace(docs.sparkSession, "alignment")
    rows = space.save(aligned(docs, byte_path, piece_path))
    return with_counts(rows, *document_frequencies(rows, space, params))


def pair_counts(spark: SparkSession, shards: Shards) -> DataFrame:
    """(a, b, n): the whole table of counts, read from its shards in as many tasks."""
    folder = shards.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["shard"].to_pylist():
                keys, counts = (Shards.opened(folder, f"{name}.{x}") for x in ("keys", "counts"))
                for i in range(0, len(keys), 100_000):
                    part = np.array(keys[i : i + 100_000])
                    yield pa.record_batch([part >> 32, part & (2**32 - 1), np.array(counts[i : i + 100_000])], ["a", "b", "n"])

    names = spark.createDataFrame([(name,) for name, _, _ in shards.listed], "shard string")
    return names.repartition(max(1, len(shards.listed)), "shard").mapInArrow(read, "a long, b long, n long")
