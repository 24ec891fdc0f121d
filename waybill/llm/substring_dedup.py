"""Repeated passages across documents, by compaction of a De Bruijn graph of words.

Method.  Every window of ``window`` words is an edge from the node of its first
``window - 1`` words to that of its last; it is known by 128 bits, those of its first
node and of the whole.  Edges meet in a join on their node, which gives each edge
that several documents have its source: the smallest (doc_id, place) of all, and
says where several edges leave a node.  A document's windows then lie along paths.
A path goes on while the next window's source is the next window of the same source
text and no second edge leaves the node between them; a path of many edges is so
compacted to one span, (place, length) here and at its source.  The source
coordinates bear each other out: a long span is one whose sources run in step, and
``spans`` gives them for the words to be compared at both ends
(``with_both_texts``).  A window is removed if its source has a smaller doc_id.

Scale.  Texts are read once and written as cells: rows of some ``cell_bytes`` of
texts, compressed, in a table bucketed by cell, so that no later step moves a text.
Edges are too many to move all, so cells first exchange anchors: of the
``anchor``-word runs inside a window the one with the smallest hash, which equal
windows share and neighbouring windows mostly too.  Only windows whose anchor occurs in
two documents become edges.  Anchors and edges are summed up inside a cell before
they move (one entry for each, with the smallest document), so what a third of all
rows have in common is one entry for a cell, and they move as packed columns for
each (range of hashes, cell); answers go back to the cells that asked.  A group is a
range of hashes or a cell, both of bounded size: the number of ranges follows the
number of cells.

Defined cases.  Null text has no words; texts of fewer words than a window stay as
they are.  Documents with a null doc_id are neither smaller nor larger than others:
they stay whole and nothing is removed for them.  Rows that repeat a doc_id are
judged each, and never removed for one another.  A window that repeats inside one
document only stays.  Very long texts are read whole; a cell holds one at least.  An
empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.workspace import Workspace, remove, shared_folder

_BYTE = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)  # a number for every byte, the same everywhere
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_EDGE = ("<u8", "<u8", "<i8", "<u4", "<u4", "u1")  # node, whole, doc_id, row, place, several documents
_ANSWER = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u4", "u1")  # node, whole, source doc_id, cell, row, place, branch
_SPAN = "struct<start:int,windows:int,source_doc:long,source_cell:long,source_row:int,source_start:int>"
DEDUPED = f"doc_id long, cell long, row int, n_words long, n_removed long, kept_sha256 string, spans array<{_SPAN}>"


@dataclass(frozen=True)
class SubstringParams:
    """Words of a window and of an anchor, bytes of a cell's texts, and cells' worth of entries in a range of hashes."""

    window: int = 13
    anchor: int = 5
    cell_bytes: int = 4 * 2**20
    cells_in_range: int = 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(first_sorted: bool, columns: list[np.ndarray]) -> bytes:
    """Columns of one length as compressed planes of bytes, a sorted first one by its differences."""
    parts = []
    for k, column in enumerate(columns):
        if first_sorted and not k:
            column = np.diff(column, prepend=column.dtype.type(0))
        parts.append(np.ascontiguousarray(column).view(np.uint8).reshape(-1, column.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def spread(first_sorted: bool, data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of ``squeezed``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        column = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel()
        out.append(np.cumsum(column, dtype=column.dtype) if first_sorted and not out else column)
        at += n * size
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    data = np.frombuffer(text, np.uint8)
    word = ~_BLANK[data]
    edges = np.diff(word, prepend=False, append=False)
    places = np.flatnonzero(edges)
    starts, ends = places[::2], places[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = np.flatnonzero(word)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(len(inside)) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP), dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[data[inside]] * powers[within], firsts) + lengths.astype(np.uint64))


def rolled(words: np.ndarray, n: int, step: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(step) + words[i : i + len(out)]
    return mixed(out)


class Cell:
    """The texts of a cell with the hashes of their words."""

    def __init__(self, payload: bytes, params: SubstringParams) -> None:
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
        self.params, self.ids, self.texts = params, table["doc_id"].to_pylist(), [t.encode() if t else b"" for t in table["text"].to_pylist()]
        hashes, held, size = [], [], 0
        for text in self.texts:  # some texts at once, so that columns of bytes stay small
            held.append(text)
            size += len(text)
            if size > 2**18:
                hashes += self._each(held)
                held, size = [], 0
        hashes += self._each(held)
        self.counts = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.words = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.row = np.repeat(np.arange(len(self.texts)), self.counts)

    @staticmethod
    def _each(texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        counts = [len(t.split()) for t in texts]
        return np.split(word_hashes(b"\n".join(texts)), np.cumsum(counts)[:-1])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of every window of documents with an id, and its anchor."""
        k = self.params.window
        last = len(self.words) - k + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        known = np.array([i is not None for i in self.ids])
        at = np.flatnonzero((self.row[:last] == self.row[k - 1 :]) & known[self.row[:last]])
        short = rolled(self.words, self.params.anchor, 0x100000001B3)
        least = short[:last].copy()
        for i in range(1, k - self.params.anchor + 1):
            np.minimum(least, short[i : i + last], out=least)
        return at, least[at]

    def edges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node and the whole of the windows that begin at ``at``."""
        k = self.params.window
        return rolled(self.words, k - 1, 0xD6E8FEB86659FD93)[at], rolled(mixed(self.words ^ _STEP), k, 0xA0761D6478BD642F)[at]

    def docs(self, at: np.ndarray) -> np.ndarray:
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        return ids[self.row[at]]


def write_cells(docs: DataFrame, params: SubstringParams, folder: str) -> tuple[DataFrame, str]:
    """The table of cells in a folder, bucketed by cell, and its name."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[str | None] = []
        size = 0

        def cell() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.table([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            payload = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            return pa.record_batch([pa.array([first + n], pa.int64()), pa.array([payload], pa.binary())], ["cell", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= params.cell_bytes:
                    yield cell()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield cell()

    spark = docs.sparkSession
    name = f"cells_{uuid.uuid4().hex}"
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, "cell long, payload binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells.write.format("parquet").bucketBy(buckets, "cell").option("path", folder).saveAsTable(name)
    return spark.table(name), name


def _by_range(ranges: int, cell: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Columns in order of their 64-bit keys, cut into ranges of the keys."""
    cuts = np.searchsorted(keys, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
    bounds = [0, *cuts.tolist(), len(keys)]
    full = [i for i in range(ranges) if bounds[i] < bounds[i + 1]]
    payloads = [squeezed(True, [c[bounds[i] : bounds[i + 1]] for c in columns]) for i in full]
    return pa.record_batch([pa.array(full, pa.int32()), pa.array([cell] * len(full), pa.int64()), pa.array(payloads, pa.binary())], ["part", "cell", "payload"])


def _anchors(params: SubstringParams, ranges: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch["cell"].to_pylist(), batch["payload"], strict=True):
                cell = Cell(payload.as_py(), params)
                at, anchors = cell.windows()
                docs = cell.docs(at)
                changed = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (docs[1:] != docs[:-1])][: len(at)])
                anchors, docs = anchors[changed], docs[changed]
                order = np.lexsort((docs, anchors))
                anchors, docs = anchors[order], docs[order]
                starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]][: len(anchors)])
                lasts = np.r_[starts[1:], len(anchors)][: len(starts)] - 1
                yield _by_range(ranges, number, anchors[starts], [anchors[starts], (docs[starts] != docs[lasts]).astype(np.uint8)])

    return made


def _shared_anchors(asked: pa.Table) -> pa.Table:
    """For each cell its anchors that another cell or two of its own documents have."""
    cells, parts = asked["cell"].to_pylist(), [spread(True, p.as_py(), ("<u8", "u1")) for p in asked["payload"]]
    distinct, inverse, n = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[inverse[np.concatenate([p[1] for p in parts]).astype(bool)]] = True
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    answers = [p[0][shared[inverse[i:j]]] for p, i, j in zip(parts, ends, ends[1:], strict=False)]
    return pa.table([pa.array(cells, pa.int64()), pa.array([squeezed(True, [a]) for a in answers], pa.binary())], ["cell", "answer"])


def _edges(params: SubstringParams, ranges: int):
    def made(cells: pa.Table, answers: pa.Table) -> pa.Table:
        """The distinct edges of a cell whose anchors are shared, each with its smallest document."""
        out = []
        for number, payload in zip(cells["cell"].to_pylist(), cells["payload"], strict=True):
            cell = Cell(payload.as_py(), params)
            at, anchors = cell.windows()
            shared = np.sort(np.concatenate([np.empty(0, np.uint64), *(spread(True, a.as_py(), ("<u8",))[0] for a in answers["answer"])]))
            if not len(shared):
                continue
            place = np.minimum(np.searchsorted(shared, anchors), len(shared) - 1)
            at = at[shared[place] == anchors]
            (node, whole), docs = cell.edges(at), cell.docs(at)
            order = np.lexsort((at, docs, whole, node))
            node, whole, docs, at = node[order], whole[order], docs[order], at[order]
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (whole[1:] != whole[:-1])][: len(at)])
            lasts = np.r_[starts[1:], len(at)][: len(starts)] - 1
            rows = cell.row[at[starts]]
            places = at[starts] - cell.starts[rows]
            columns = [node[starts], whole[starts], docs[starts], rows.astype("<u4"), places.astype("<u4"), (docs[starts] != docs[lasts]).astype(np.uint8)]
            out.append(_by_range(ranges, number, node[starts], columns))
        return pa.Table.from_batches(out, _RANGED)

    return made


_RANGED = pa.schema([("part", pa.int32()), ("cell", pa.int64()), ("payload", pa.binary())])


def _sources(asked: pa.Table) -> pa.Table:
    """For each cell the source of its edges that it has in a document after the source's, and whether others leave their node."""
    cells, parts = asked["cell"].to_pylist(), [spread(True, p.as_py(), _EDGE) for p in asked["payload"]]
    node, whole, doc, row, place, several = (np.concatenate(c) for c in zip(*parts, strict=True))
    cell = np.repeat(np.array(cells, np.int64), [len(p[0]) for p in parts])
    order = np.lexsort((place, row, cell, doc, whole, node))
    node, whole, doc, row, place, several, cell = (x[order] for x in (node, whole, doc, row, place, several, cell))
    fresh_node = np.r_[True, node[1:] != node[:-1]]
    fresh = fresh_node | np.r_[True, whole[1:] != whole[:-1]]
    starts = np.flatnonzero(fresh)
    edge = np.cumsum(fresh) - 1
    lasts = np.r_[starts[1:], len(node)] - 1
    repeated = (doc[starts] != doc[lasts]) | np.maximum.reduceat(several, starts).astype(bool)
    group = np.cumsum(fresh_node)[starts] - 1
    branch = np.bincount(group, repeated)[group] > 1
    source = starts[edge]
    wanted = repeated[edge] & ((doc > doc[source]) | several.astype(bool))
    by_cell = np.argsort(cell[wanted], kind="stable")
    columns = [x[wanted][by_cell] for x in (node, whole, doc[source], cell[source], row[source], place[source], branch[edge].astype(np.uint8))]
    owners = cell[wanted][by_cell]
    names, firsts = np.unique(owners, return_index=True)
    bounds = [*firsts.tolist(), len(owners)]
    payloads = [squeezed(True, [c[i:j] for c in columns]) for i, j in zip(bounds, bounds[1:], strict=False)]
    return pa.table([pa.array(names, pa.int64()), pa.array(payloads, pa.binary())], ["cell", "answer"])


def _matched(node: np.ndarray, whole: np.ndarray, known_node: np.ndarray, known_whole: np.ndarray) -> np.ndarray:
    """For each edge its place among the known ones, or -1."""
    nodes, wholes = np.concatenate([known_node, node]), np.concatenate([known_whole, whole])
    order = np.lexsort((np.arange(len(nodes)), wholes, nodes))  # a known edge comes before its equals
    fresh = np.r_[True, (np.diff(nodes[order]) != 0) | (np.diff(wholes[order]) != 0)]
    heads = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    out = np.empty(len(nodes), np.int64)
    out[order] = np.where(heads < len(known_node), heads, -1)
    return out[len(known_node) :]


def _judged(params: SubstringParams):
    def made(cells: pa.Table, answers: pa.Table) -> pa.Table:
        """Every document of a cell with its removed words and the spans they lie in."""
        out: list[dict] = []
        for number, payload in zip(cells["cell"].to_pylist(), cells["payload"], strict=True):
            cell = Cell(payload.as_py(), params)
            parts = [spread(True, a.as_py(), _ANSWER) for a in answers["answer"]]
            known = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.empty(0, k) for k in _ANSWER]
            at, _ = cell.windows()
            if len(known[0]):
                node, whole = cell.edges(at)
                nodes = np.sort(known[0])
                near = nodes[np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)] == node
                at, node, whole = at[near], node[near], whole[near]
                found = _matched(node, whole, known[0], known[1])
                at, found = at[found >= 0], found[found >= 0]
                later = cell.docs(at) > known[2][found]
                at, found = at[later], found[later]
            else:
                at, found = at[:0], np.empty(0, np.int64)
            doc, home, row, place, branch = (known[k][found] for k in range(2, 7))
            covered = np.zeros(len(cell.words) + 1, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + params.window, -1)
            removed = np.cumsum(covered)[:-1] > 0
            own = cell.row[at]
            in_step = (np.diff(at) == 1) & (own[1:] == own[:-1]) & (home[1:] == home[:-1]) & (row[1:] == row[:-1]) & (np.diff(place.astype(np.int64)) == 1) & (branch[1:] == 0)
            heads = np.flatnonzero(np.r_[True, ~in_step][: len(at)])
            sizes = np.diff(np.r_[heads, len(at)])
            spans: dict[int, list[dict]] = {}
            for h, n in zip(heads.tolist(), sizes.tolist(), strict=True):
                spans.setdefault(int(own[h]), []).append({"start": int(at[h] - cell.starts[own[h]]), "windows": n, "source_doc": int(doc[h]), "source_cell": int(home[h]), "source_row": int(row[h]), "source_start": int(place[h])})
            for r, (doc_id, text) in enumerate(zip(cell.ids, cell.texts, strict=True)):
                words = text.split()
                gone = removed[cell.starts[r] : cell.starts[r] + cell.counts[r]]
                if r in spans:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append({"doc_id": doc_id, "cell": number, "row": r, "n_words": int(cell.counts[r]), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(b" ".join(words)).hexdigest(), "spans": spans.get(r, [])})
        return pa.Table.from_pylist(out, _JUDGED)

    return made


_JUDGED = pa.schema([
    ("doc_id", pa.int64()), ("cell", pa.int64()), ("row", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("source_doc", pa.int64()), ("source_cell", pa.int64()), ("source_row", pa.int32()), ("source_start", pa.int32())]))),
])


def repeated_passages(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """Every document with its number of words, of removed words, the hash of what is kept, and the spans removed."""
    spark = docs.sparkSession
    space, folder = Workspace(spark, "substrings"), shared_folder(spark, "cells")
    cells, name = write_cells(docs, params, folder)
    try:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells.select("cell").count() // params.cells_in_range))
        asked = cells.mapInArrow(_anchors(params, ranges), "part int, cell long, payload binary")
        shared = asked.groupBy("part").applyInArrow(_shared_anchors, "cell long, answer binary")
        edges = cells.groupBy("cell").cogroup(shared.groupBy("cell")).applyInArrow(_edges(params, ranges), "part int, cell long, payload binary")
        sources = edges.groupBy("part").applyInArrow(_sources, "cell long, answer binary")
        again = spark.table(name)
        judged = again.groupBy("cell").cogroup(sources.groupBy("cell")).applyInArrow(_judged(params), DEDUPED)
        return space.save(judged)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)


def spans(judged: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """(doc_id, start, words, source_doc, source_start) of every removed span, in words from 0."""
    rows = judged.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start"), (F.col("s.windows") + params.window - 1).alias("words"), F.col("s.source_doc").alias("source_doc"), F.col("s.source_start").alias("source_start"))


def with_both_texts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with their words here (``text``) and at their source (``source_text``); for documents of distinct ids."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cut(start: str):
        return F.array_join(F.slice("w", F.col(start) + 1, F.col("words")), " ")

    split = docs.select("doc_id", words.alias("w"))
    here = found.join(split, "doc_id").select(*found.columns, cut("start").alias("text"))
    there = here.join(split.withColumnRenamed("doc_id", "source_doc"), "source_doc")
    return there.select(*here.columns, cut("source_start").alias("source_text"))
