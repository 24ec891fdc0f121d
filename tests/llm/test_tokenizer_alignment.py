"""Tokenizer alignment against plain counting over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waybill.llm import tokenizer_alignment as ta
from waybill.llm.workspace import Workspace, shared_folder

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "one", "naïve café — 你好 😀", "a<|endoftext|>b</s>c <0x41>", "▁ kept?", "two  blanks\n\nand lines\t", "x" * 5000, "é" * 300, "A plain text of some words.", "A plain text of some words.", "\x00\x07", "ﬁ ligature"]


def plain(texts):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in alphabet} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in alphabet)}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def pieces(text):
        for i in model.encode(text):
            p = model.id_to_piece(i)
            yield i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    docs, df = [], Counter()
    for text in texts:
        wanted = b" " + (text or "").encode()
        a = [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = list(pieces(text)) if text else []
        if not text or b"".join(t for _, t in a) != wanted or b"".join(t for _, t in b) != wanted:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(t) for _, t in a]).tolist(), np.cumsum([len(t) for _, t in b]).tolist()
        links, j = [], 0
        for (i, t), end in zip(a, ends_a, strict=True):
            while ends_b[j] <= end - len(t):
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(b[k][1]) < end:
                links.append((i, b[k][0]))
                k += 1
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(str(i) for i, _ in a[x:p]) + "|" + ",".join(str(i) for i, _ in b[y:q]))
            x, y = p, q
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        df.update(set(links))
    best = defaultdict(int)
    for (i, _), n in df.items():
        best[i] = max(best[i], n)
    out = [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(df[x] == best[x[0]] for x in d[3]), sum(df[x] for x in d[3]), d[4]) for d in docs]
    return out, df


def rows_of(frame):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r.doc_id: tuple(r[c] for c in names) for r in frame.collect()}


def test_alignment_equals_plain_alignment(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({c: F.lit("mine") for c in ("key", "n", "pairs", "shard", "n_a")})
    want, df = plain(texts)
    for params in (ta.AlignParams(), ta.AlignParams(flush=50)):
        assert rows_of(ta.align_documents(docs, BYTES, PIECES, params)) == dict(enumerate(want))
    assert want[5][0] > 0 and want[10] == want[11] and want[6] == (0, 0, 0, 0, 0, 0, "")
    space = Workspace(spark, "t")
    shards, highest = ta.document_frequencies(space.save(ta.aligned(docs, BYTES, PIECES)), space, ta.AlignParams(flush=500))
    assert {(r.a, r.b): r.n for r in ta.pair_counts(spark, shards).collect()} == dict(df)
    assert int(highest.max()) == max(df.values())


def test_runs_that_batches_cut_are_summed(spark):
    rows = spark.range(0, 30_000, 1, 4).select((F.col("id") % 7).alias("key"), F.lit(1).cast("long").alias("n"))
    listed = ta.write_shards(rows, shared_folder(spark, "t")).collect()
    assert sum(r.best for r in listed) >= 30_000 // 7 and {r.a for r in listed} == {0}
    folder = shared_folder(spark, "t")
    got = Workspace(spark, "t").save(ta.write_shards(rows, folder)).select("shard", "first", "last").distinct().collect()
    shards = ta.Shards(folder, sorted(((r.shard, r.first, r.last) for r in got), key=lambda x: x[1]))
    assert shards.counts(np.arange(7)).tolist() == [sum(i % 7 == k for i in range(30_000)) for k in range(7)]


def test_shards_of_a_folder_that_is_no_local_path(spark, tmp_path):
    with ta.Shards.created(f"{tmp_path}", "x.keys") as f:
        f.write(np.arange(5, dtype="<i8").tobytes())
    assert ta.Shards.opened(f"file://{tmp_path}", "x.keys").tolist() == [0, 1, 2, 3, 4]
    assert ta.Shards.local("hdfs://host/x") is None and ta.Shards.local("file:///a/b") == "/a/b"


def test_packing_of_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**48, 1000))
    assert (ta.unpacked(ta.packed(keys)) == keys).all() and len(ta.unpacked(ta.packed(keys[:0]))) == 0


def test_alignment_of_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text"), (3, None)], "doc_id long, text string")
    assert set(rows_of(ta.align_documents(docs, BYTES, PIECES))) == {None, 3}
    assert ta.align_documents(docs.limit(0), BYTES, PIECES).count() == 0
