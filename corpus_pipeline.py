"""A corpus pipeline: documents to packed token sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet to a folder under the session's checkpoint directory, which driver and
executors share, and reads it again for the next, so a lost executor costs no
more than the tasks of one stage.

1. toxicity: documents scored 0.7 or more by a classifier fitted on ``labels`` go.
2. quality rules: documents that fail a rule of policy ``v2`` go.
3. near_dedup: of documents linked by five-word shingles and a likeness of 0.8 or
   more, the one with the smallest doc_id stays.
4. mixing: documents are taken by domain, language and source up to target
   weights; a source with too little is repeated in further epochs, as rows of
   their own.  The document that crosses a budget is taken whole.
5. packing: pieces of at most 1024 tokens are placed in sequences.

Defined cases follow the operators' own docstrings.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import mixing, near_dedup, packing, rule_ledger, toxicity
from waybill.llm.labelled import known_labels
from waybill.llm.queries import domain_of_source
from waybill.llm.workspace import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIX = mixing.MixPlan(budget_share=1.0, max_epochs=3, seed=42, weights={"domain": {"web": 2.0}, "lang": {"en": 2.0}})

#: SQL cannot express the classifier, the packing or their seeded hashes.
ORACLE_SQL = None


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by the classifier fitted on ``labels``.

    A null or empty text gets the model's prior; rows that repeat are judged each;
    without labels of both classes the score is the smoothed share of toxic ones.
    """
    labels = known_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", F.lit(True))
    scored = toxicity.score(docs, toxicity.train(docs, labels), 0.7)
    return _documents(scored.where("predicted = 0"))


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy ``v2``; null, empty and blank texts have too few words and go."""
    judged = rule_ledger.apply_policy(rule_ledger.ledger(docs), rule_ledger.POLICIES["v2"])
    return _documents(judged.where("kept"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents that with the smallest doc_id, with all rows that repeat it.

    Null, empty and blank texts link with nothing, and stay, as do rows without a doc_id.
    """
    return _documents(near_dedup.keep_one(docs, near_dedup.DedupParams(shingle=5, percent=80)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to their leaf's budget, a row for each epoch that takes them; a null lang or source is a leaf of its own."""
    return _documents(mixing.select_documents(docs, domain_of_source(), MIX))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of all rows; a null or empty text is its end id alone, rows that repeat are packed each."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_by_rules),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
