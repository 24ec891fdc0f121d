"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from waybill.llm import chat_views, fingerprints, mixing, near_dedup, packing, prefix_trie, quality_compress, rule_ledger, substring_dedup, tokenizer_alignment, toxicity, url_filter, warc_zip
from waybill.llm.labelled import known_labels
from waybill.llm.oracles import ORACLES
from waybill.llm.workspace import shared_folder

#: Fixed values of the url rules.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
MIX = mixing.MixPlan(
    budget_share=0.8,
    max_epochs=3,
    seed=42,
    weights={"domain": {"web": 2.0, "books": 1.0, "forums": 1.0}, "lang": {"en": 3.0, "de": 2.0}, "source": {"src0": 0.5}},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of_source() -> Column:
    """The domain of a source such as ``src7``: by its number, modulo 3."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"), F.lit(0)) % 3
    return F.when(number == 0, F.lit("web")).when(number == 1, F.lit("books")).otherwise(F.lit("forums"))


def in_fold(modulus: int, remainder: int) -> Column:
    """Whether a document is held out; a null doc_id, which has no label, is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold(3, 1)
    model = toxicity.train(docs, known_labels(labels, "toxic", ~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model, 0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.select_documents(docs, domain_of_source(), MIX).drop("text")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold(5, 0)
    model = quality_compress.train(docs, known_labels(labels, "quality", ~held_out))
    return quality_compress.score(docs.select("doc_id", "text"), model, 0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, near_dedup.DedupParams(shingle=3, percent=85))


def op6_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.perspectives(table(spark, sf_dir, "conversations"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = sum(1 << rule_ledger.BIT[name] for name in rule_ledger.BASE)
    judged = rule_ledger.apply_policy(rows, rule_ledger.POLICIES["v2"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failed")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    packages = warc_zip.write_packages(pages, shared_folder(spark, "warc"), least=0)
    return warc_zip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("k1", "k2")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer_alignment.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_near_dedup": op5_near_dedup,
    "op6_chat_views": op6_chat_views,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc_zip": op8_warc_zip,
    "op9_rule_ledger": op9_rule_ledger,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_substring_dedup": op13_substring_dedup,
}
