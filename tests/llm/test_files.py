"""Fingerprints, archives and packing: round trips and brute force."""

import base64
import hashlib
import io
import json
import math
import random
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waybill.llm import fingerprints, packing, warc_zip
from waybill.llm.packing import PackParams
from waybill.llm.workspace import shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_fingerprints_pair_each_document_with_the_next(spark):
    rng = random.Random(1)
    texts = {i * 5: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 200))) for i in range(120)}
    texts |= {1: None, 3: "", 7: "é😀", 9: "x" * 300_000, 11: texts[10]}
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs, ranges=16).collect()}
    order = sorted(texts, reverse=True)
    assert set(got) == set(texts)
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = texts[i] or "", texts[following] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.pack(fingerprints.sketch(text)) and r.edited_fingerprint == fingerprints.pack(fingerprints.sketch(edited))
        assert 0 <= r.near_next <= 1 and abs(r.near_edited - fingerprints.likeness(fingerprints.sketch(text), fingerprints.sketch(edited))) < 1e-12
    assert got[10].fingerprint == got[11].fingerprint != got[0].fingerprint
    long = [r for i, r in got.items() if i % 5 == 0 and r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


def test_fingerprints_of_short_texts_show_edits():
    rng, width = random.Random(2), fingerprints.DEFAULT.shingle
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shingles = lambda t: {("\0" * (width - 1) + t)[i : i + width] for i in range(len(t))}
    errors = []
    for n in [*range(3, 100)] * 3:
        old, other = text(n), text(n)
        new = fingerprints.edited(old, other)
        exact = len(shingles(old) & shingles(new)) / len(shingles(old) | shingles(new))
        got = fingerprints.likeness(fingerprints.sketch(old), fingerprints.sketch(new))
        errors.append(abs(got - exact))
        assert errors[-1] < (1e-12 if n < fingerprints.DEFAULT.least else 0.35)  # four deviations of 16 hashes of each
        assert got > fingerprints.likeness(fingerprints.sketch(old), fingerprints.sketch(other)) and (got < 1 or old == new)
    assert sum(errors) / len(errors) < 0.08


def test_merged_sketches_are_those_of_all_shingles():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 40, 64, 65, 200, 900, 1100, 5000)]
    for a in texts:
        for b in texts:
            whole = fingerprints.sketch(a + "\n" + b)  # has a few shingles more, across the join
            merged = fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b))
            both = min(fingerprints.bound(merged), fingerprints.bound(whole))
            assert len({h for h in {*merged.tolist()} ^ {*whole.tolist()} if h <= both}) <= 2 * fingerprints.DEFAULT.shingle
            assert len(merged) >= min(fingerprints.DEFAULT.least, len(a), len(b))


def test_hot_ids_keep_one_order(spark):
    """Each row is the next of exactly one other, in the order of (doc_id, hash, text), though one id and null are in many ranges."""
    rows = [(5, f"five {k}") for k in range(80)] + [(None, f"none {k}") for k in range(60)] + [(k, f"own {k}") for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(docs, ranges=16).collect()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]), reverse=True)
    following = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.text: r.next_text for r in got} == following and len(got) == len(rows)


def test_contained_texts_are_found_at_every_length():
    rng = random.Random(12)
    whole = " ".join(f"w{rng.randrange(10**5)}" for _ in range(3000))
    for n, least, mean in ((30, 0.0, 0.7), (60, 0.0, 0.8), (200, 0.6, 0.95), (1000, 0.95, 0.99)):
        found = []
        for _ in range(100):
            at = rng.randrange(len(whole) - n)
            got = fingerprints.containment(fingerprints.sketch(whole[at : at + n]), fingerprints.sketch(whole))
            if n < 200 and math.isnan(got):  # no hash of so short a part lies below the fraction: unknown, not 0
                continue
            found.append(got)
        assert min(found) >= least and sum(found) / len(found) > mean and len(found) > 60
    strange = "".join(rng.choice("ABCDEFGH") for _ in range(500))
    assert fingerprints.containment(fingerprints.sketch(strange), fingerprints.sketch(whole)) == 0.0


def test_the_fraction_rules_most_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    kept = [fingerprints.sketch(t) for t in texts]
    assert sum(int((k < fingerprints.DEFAULT.bound).sum()) >= fingerprints.DEFAULT.least for k in kept) >= 0.9 * len(texts)


def test_fingerprints_of_odd_tables(spark):
    shape = "doc_id long, text string"
    one = fingerprints.compare_with_next(spark.createDataFrame([(4, "abcdef")], shape)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    again = fingerprints.compare_with_next(spark.createDataFrame([(4, "abc"), (4, "abd"), (4, "abd"), (None, "zz")], shape)).collect()
    assert len(again) == 4
    assert fingerprints.compare_with_next(spark.createDataFrame([], shape)).count() == 0


def test_containment_of_unequal_documents():
    rng = random.Random(2)
    small = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    large = small + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(8000))
    a, b = fingerprints.sketch(small), fingerprints.sketch(large)
    assert fingerprints.containment(a, b) > 0.9 and fingerprints.likeness(a, b) < 0.2
    assert fingerprints.likeness(fingerprints.merge(a, b), b) > 0.95
    assert list(fingerprints.unpack(fingerprints.pack(a))) == list(a)


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i % 5}", f"<p>{i % 6}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (102, "u", "é" * 200_000), (103, "u", "line\r\n\r\nline"), (103, "u", "line\r\n\r\nline"), (None, "u", "<p>0</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    packages = warc_zip.write_packages(pages.repartition(3), shared_folder(spark, "t"), least=0, max_records=7)
    got = warc_zip.read_packages(packages, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    by_id = {}
    for i, url, html in rows:
        by_id[i] = (html or "").encode()
    for r in got:
        payload = by_id[r.page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = first[payload.decode()]
        revisit = r.page_id is not None and r.page_id > top
        assert (r.record_type, r.refers_to) == (("revisit", top) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else payload)
    assert packages.count() >= 9
    empty = warc_zip.write_packages(pages.limit(0), shared_folder(spark, "t"))
    assert empty.count() == 0 and warc_zip.read_packages(empty).count() == 0


def test_least_payload_stays_a_response(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc_zip.read_packages(warc_zip.write_packages(pages, shared_folder(spark, "t"), least=3)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_directory_reads_zip64_and_skips_deflated():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("b", "world")
        z.writestr(zipfile.ZipInfo("c"), "x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = raw.getvalue()
    found = warc_zip.directory(io.BytesIO(data), len(data))
    assert {k: data[s : s + n] for k, (s, n) in found.items()} == {"a": b"hello", "b": b"world"}
    # The same archive with its end record overflowing into a ZIP64 one.
    end = data.rindex(b"PK\x05\x06")
    count, size, start = struct.unpack("<H2I", data[end + 10 : end + 20])
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    big = data[:end] + record + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.directory(io.BytesIO(big), len(big)) == found


def test_ids_are_those_of_the_tokenizer(spark):
    slow, fast = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    odd = ["", "  a\n\n b  \n", " <|endoftext|> x", "é　 x  ", "don't I'LL 12345 \t\t x\r\n\r\n", "\x00\x1c\x85 y", "😀😀 👩‍👩‍👧 ñ", "a" * 3000, " " * 500, "x  \n  y", "\n\n\n"]
    texts = odd + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert all(slow.encode(t, add_special_tokens=False).ids == fast(t) for t in texts)


def test_other_vocabularies_go_to_the_tokenizers_library(tmp_path):
    spec = json.load(open(TOKENIZER))
    assert packing.is_plain_byte_level(spec)
    merges = spec["model"]["merges"]
    changed = [{**spec, "normalizer": {"type": "Lowercase"}}, {**spec, "model": {**spec["model"], "merges": [merges[1], merges[0], *merges[2:]]}}, {**spec, "pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}]
    for k, other in enumerate(changed):
        assert not packing.is_plain_byte_level(other)
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(other))
        text = "  The THE thing\n\nÉtat 12"
        assert packing.encoder(str(path))(text) == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def least_sequences(counts, capacity=1024):
    """The Martello-Toth lower bound on the number of sequences."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - k)
        large = {x: n for x, n in counts.items() if capacity // 2 < x <= capacity - k}
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best


def test_packing_places_every_piece_once(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"t{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 60, 300, 900, 2000])))) for i in range(150)] + [(500, None), (501, ""), (1, "again"), (502, "z " * 20_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, offset int")
    got = packing.pack_documents(docs, TOKENIZER).collect()
    slow = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in rows:
        ids = slow.encode(text or "", add_special_tokens=False).ids + [2]
        assert sum(n for _, n in packing.cut(len(ids), 1024)) == len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
            assert n == 1024 or k == 0
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.02 * least_sequences(Counter(w[3] for w in want)) + 2
    joined = packing.sequences(docs.where("doc_id < 20"), TOKENIZER)
    assert joined.where(F.size("ids") > 1024).count() == 0
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_plan_is_bounded_and_complete():
    rng = random.Random(6)
    counts = {k: rng.randrange(0, 5000) for k in range(1, 1025)}
    runs = packing.plan(counts, PackParams())
    used = {}
    for run in runs:
        assert run.used <= 1024
        for length, rank in run.slots:
            used.setdefault(length, []).append((rank, rank + run.count))
    for length, n in counts.items():
        spans = sorted(used.get(length, []))
        assert [a for a, _ in spans] == [0, *[b for _, b in spans]][: len(spans)] and (spans[-1][1] if spans else 0) == n
    assert sum(len(r.slots) for r in runs) < 10_000
    assert sum(r.count for r in runs) <= 1.01 * least_sequences(counts)


def test_groups_are_few_and_their_programme_is_tight():
    rng, params = random.Random(7), PackParams()
    counts = {k: rng.randrange(1, 3000) for k in range(257, 1024)}
    sizes = packing.grouped(counts, params.groups)
    assert len(sizes) <= params.groups and sum(sizes.values()) == sum(counts.values())
    longest = sorted((k for k, n in counts.items() for _ in range(n)), reverse=True)
    rounded = sorted((k for k, n in sizes.items() for _ in range(n)), reverse=True)
    assert all(a <= b for a, b in zip(longest, rounded, strict=True))
    assert max(sizes.values()) - min(sizes.values()) <= max(counts.values())
    planned = packing.configurations(list(sizes), list(sizes.values()), params)
    for g, n in enumerate(sizes.values()):
        assert sum(times * used[g] for times, used in planned) == n
    assert all(sum(u * s for u, s in zip(used, sizes, strict=True)) <= params.capacity for _, used in planned)
    assert sum(times for times, _ in planned) <= least_sequences(sizes) * 1.002 + params.groups
