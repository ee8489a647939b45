from __future__ import annotations

import numpy as np

import corpus_pipeline
from quantspark.llm import mixing, packing

from .helpers import awkward, documents
from .test_decision_list import brute_stats
from .test_simhash import brute_fingerprint, components


def corpus(spark, folder):
    rng = np.random.default_rng(11)
    vocabulary = [f"word{i}" for i in range(500)]
    texts = []
    for i in range(150):
        w = rng.choice(vocabulary, 90).tolist()
        if i % 10 == 0:
            w = [x + "###" for x in w]
        if i % 10 == 1:
            w[5] = "token=abcdef123456"
        texts.append(" ".join(w))
    texts += texts[1:9] + ["short text", "", None, " ".join(["same eight words come here again and again"] * 9)]
    docs = documents(spark, texts, [f"src{i % 3}" for i in range(len(texts))])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{number}")
        docs = spark.read.parquet(f"{folder}/out{number}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    good = {r.doc_id for r in seen["quality_rules"]}
    failed = {i for i, t in enumerate(texts) if (s := brute_stats(t))[0] < 20 or 100 * s[4] > 30 * s[0]}
    assert not good & failed and good >= {i for i in range(150) if i % 10}
    assert not good & set(range(0, 150, 10))
    prints = {i: brute_fingerprint(texts[i]) for i in good}
    assert {r.doc_id for r in seen["simhash_dedup"]} == set(components(prints).values())
    cleaned = {r.doc_id: r.text for r in seen["secret_scan"]}
    assert all("token=" not in t and "[SECRET]" in t for i, t in cleaned.items() if i % 10 == 1 and i < 150)
    assert all(t == texts[i] for i, t in cleaned.items() if i % 10 != 1)
    plan = mixing.mix_digest(spark.read.parquet(f"{folder}/out2")).collect()
    taken = sorted(i for r in plan for i in [r.doc_id] * r.copies)
    assert sorted(r.doc_id for r in seen["source_mix"]) == taken
    want = sorted((i, len(packing.token_ids(cleaned[i]))) for i in taken)
    assert sum(n for _, n in want) == sum(r.length for r in seen["packing"])
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(seen["packing"])


def test_stages_on_awkward_and_empty_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.collect()
            assert name == "packing" or out.columns == docs.columns
