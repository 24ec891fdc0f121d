"""WARC: archives packaged in ZIP files, written and range-read.

Method.  A package is a ZIP file whose members are stored, not deflated: a WARC
file of separately gzipped records and an index with each record's place.  The
reader parses the end of central directory (the ZIP64 one where its fields
overflow), the central directory and the local headers by hand, finds the two
members, and range-reads single records from the file's own bytes; nothing is
extracted or unpacked as a whole.

Pages with equal payloads of at least ``least`` bytes are written once: the one
with the smallest page_id is a response, the others are revisits that refer to
it and carry the digest and length of the full payload in their headers.

Scale.  Payloads' digests are counted with map-side sums, and only those that repeat
meet the pages, in a broadcast if they are counted to be at most ``BROADCAST_KEYS``,
else in a join, which adaptive execution splits where one payload is very common.
Every task writes packages of its own
under fresh names, closed at ``max_bytes`` or ``max_records``; the list of
finished packages is checkpointed, so a package of a lost or repeated task is
never read.  Reading deals spans of at most ``span`` bytes of records to tasks,
whose number follows from the bytes of all packages: no task reads more than some
``TASK_BYTES``, and small archives are still dealt to all cores.
Packages go to any store that pyarrow's file systems open by URI.

Defined cases.  A null html is an empty payload; equal rows that repeat the
smallest page_id are all responses; a null page_id or url comes back as null (a
page_id of null is never referred to).  Very long payloads are one record.
An empty table gives no package and an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.workspace import checkpointed

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
BROADCAST_KEYS, TASK_BYTES = 500_000, 2**27
_EPOCH = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_file(uri: str, mode: str) -> Any:
    """A file of any store that pyarrow knows, for ``r`` (seekable) or ``w``."""
    store, path = arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store.open_input_file(path) if mode == "r" else store.open_output_stream(path)


def make_folder(uri: str) -> None:
    store, path = arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    store.create_dir(path, recursive=True)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def _record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One gzipped WARC record; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_EPOCH}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """WARC headers, payload, and the full payload's length by the HTTP headers."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return headers, payload, size


def _read_at(f: Any, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError("the package is cut off")
    return got


def directory(f: Any, size: int) -> dict[str, tuple[int, int]]:
    """Start and length of every stored member, from the central directory (ZIP64 where needed)."""
    tail_at = max(0, size - 65_557)
    tail = _read_at(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _read_at(f, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = _read_at(f, struct.unpack("<Q", locator[8:16])[0], 56)
        count, length, start = struct.unpack("<3Q", record64[32:56])
    central, at = _read_at(f, start, length), 0
    found = {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, unpacked = *struct.unpack("<H", central[at + 10 : at + 12]), *struct.unpack("<2I", central[at + 20 : at + 28])
        n_name, n_extra, n_comment = struct.unpack("<3H", central[at + 28 : at + 34])
        (local,) = struct.unpack("<I", central[at + 42 : at + 46])
        name = central[at + 46 : at + 46 + n_name].decode()
        extra, place = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while place + 4 <= len(extra):
            kind, width = struct.unpack("<2H", extra[place : place + 4])
            if kind == 1:  # the 64-bit values of the fields that overflow, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[place + 4 : place + 4 + width // 8 * 8]))
                unpacked, packed, local = (next(wide) if x == 0xFFFFFFFF else x for x in (unpacked, packed, local))
            place += 4 + width
        if method == 0:
            own = struct.unpack("<2H", _read_at(f, local + 26, 4))
            found[name] = (local + 30 + sum(own), packed)
        at += 46 + n_name + n_extra + n_comment
    return found


class _Package:
    """A package being written: records go to the WARC member as they come, the index follows."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.out = open_file(self.uri, "w")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, raw: bytes, url: str | None) -> None:
        self.member.write(raw)
        self.index.append(f"{_one_line(url or '-')} 19700101000000 {json.dumps({'offset': self.at, 'length': len(raw)})}\n")
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(self.index))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.uri, size, len(self.index)


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, refers_to): revisits have no html."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    repeated = rows.where(F.col("payload_bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = checkpointed(repeated.select("sha", "first"))
    few = firsts.count() <= BROADCAST_KEYS
    joined = rows.join(F.broadcast(firsts) if few else firsts, "sha", "left")
    refers = F.when((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first")), F.col("first"))
    return joined.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "sha", "refers_to")


def write_packages(pages: DataFrame, folder: str, least: int = 0, max_bytes: int = 2**30, max_records: int = 200_000) -> DataFrame:
    """Write all pages; the finished packages as (uri, size, records), checkpointed."""
    make_folder(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, done = None, []
        for batch in batches:
            for page_id, url, html, size, sha, refers_to in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                package = package or _Package(folder)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                package.add(record(page_id, url, payload, size, digest, refers_to), url)
                if package.at >= max_bytes or len(package.index) >= max_records:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["uri", "size", "records"])

    # Ids travel as text: pandas turns whole numbers beside nulls into floats.
    planned = plan_records(pages, least).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return checkpointed(planned.mapInPandas(write, "uri string, size long, records long"))


def spans(packages: DataFrame, span: int = 2**22, tasks: int = 1) -> DataFrame:
    """(uri, start, lengths), located in so many tasks: runs of neighbouring records, from the packages' own directories and indexes."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, size in zip(batch["uri"], batch["size"], strict=True):
                with open_file(uri, "r") as f:
                    members = directory(f, int(size))
                    start, (index_at, index_size) = members[WARC_MEMBER][0], members[INDEX_MEMBER]
                    places = sorted((x["offset"], x["length"]) for x in (json.loads(line.split(" ", 2)[2]) for line in _read_at(f, index_at, index_size).decode().splitlines()))
                run: list[int] = []
                for offset, length in places:
                    if run and sum(run) + length > span:
                        rows.append((uri, start + offset - sum(run), run))
                        run = []
                    run.append(length)
                if run:
                    rows.append((uri, start + places[-1][0] + places[-1][1] - sum(run), run))
            yield pd.DataFrame(rows, columns=["uri", "start", "lengths"])

    return packages.select("uri", "size").repartition(tasks, "uri").mapInPandas(locate, "uri string, start long, lengths array<long>")


def reading_tasks(packages: DataFrame, span: int) -> int:
    """Tasks for reading all packages: enough for ``TASK_BYTES`` each, and for all cores if there are spans for them."""
    total = packages.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    cores = packages.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // TASK_BYTES), min(-(-total // span), 3 * cores))


def read_packages(packages: DataFrame, with_payload: bool = False, span: int = 2**20) -> DataFrame:
    """Every record of the packages, range-read; a response's digest and length are those of the bytes read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start, lengths in batch.itertuples(index=False):
                rows = []
                with open_file(uri, "r") as f:
                    raw, at = _read_at(f, int(start), int(sum(lengths))), 0
                for length in map(int, lengths):
                    headers, payload, size = parse_record(raw[at : at + length])
                    at += length
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                        raise ValueError(f"a payload of {uri} does not have its digest")
                    page_id, refers = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
                    rows.append((page_id and int(page_id), headers.get("WARC-Target-URI"), kind, size, digest, refers and int(refers), payload)[: 7 if with_payload else 6])
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pd.DataFrame(rows, columns=names[: 7 if with_payload else 6]).astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = reading_tasks(packages, span)
    dealt = spans(packages, span, tasks).repartition(tasks, "uri", "start")
    return dealt.mapInPandas(read, RECORDS + (", payload binary" if with_payload else ""))
