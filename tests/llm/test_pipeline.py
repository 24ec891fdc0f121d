"""The pipeline on the smallest tables, stage by stage.

Deduplication and packing are held to plain Python, mixing to the budgets of its
leaves; toxicity and rules to their operators, which have tests of their own.
"""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_near_dedup import brute

from waybill.llm import mixing, packing, rule_ledger, toxicity
from waybill.llm.labelled import known_labels
from waybill.llm.near_dedup import DedupParams


def test_pipeline_equals_a_chain_of_its_stages(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stage = {name: spark.read.parquet(f"file://{tmp_path}/pipeline/{name}") for name, _ in corpus_pipeline.STAGES}
    texts = {name: Counter((r.doc_id, r.text) for r in stage[name].collect()) for name in list(stage)[:-1]}

    model = toxicity.train(docs, known_labels(labels, "toxic", F.lit(True)))
    clean = toxicity.score(docs, model, 0.7).where("score < 0.7 or score is null")
    assert texts["toxicity"] == Counter((r.doc_id, r.text) for r in clean.collect())
    assert 0 < texts["toxicity"].total() < docs.count()

    judged = rule_ledger.apply_policy(rule_ledger.ledger(stage["toxicity"]), rule_ledger.POLICIES["v2"])
    assert texts["quality_rules"] == Counter((r.doc_id, r.text) for r in judged.where("kept").collect())

    components = brute(list(texts["quality_rules"]), DedupParams(shingle=5, percent=80))
    assert texts["near_dedup"] == Counter(row for row in texts["quality_rules"] if components[row[0]][1] == row[0])

    leaves = stage["near_dedup"].withColumn("domain", corpus_pipeline.domain_of_source()).groupBy("domain", "lang", "source").agg(F.sum(mixing.word_tokens()).alias("tokens"))
    budgets = {(r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, corpus_pipeline.MIX).collect() if r.budget}
    taken = defaultdict(list)
    for r in stage["mixing"].select("lang", "source", mixing.word_tokens().alias("n")).collect():
        taken[r.lang, r.source].append(r.n)
    assert set(taken) == set(budgets) and set(texts["mixing"]) <= set(texts["near_dedup"])
    assert all(sum(taken[k]) >= b > sum(taken[k]) - max(taken[k]) for k, b in budgets.items())
    assert max(texts["mixing"].values()) <= corpus_pipeline.MIX.max_epochs

    params, enc = packing.PackParams(), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, sequences = Counter(), defaultdict(list)
    for r in packed:
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for (i, text), copies in texts["mixing"].items():
        want[i] += copies * (len(enc(text or "")) + 1)
    assert tokens == want
    for places in sequences.values():
        places.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= params.capacity
