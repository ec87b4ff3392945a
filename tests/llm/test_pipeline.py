"""Each stage against its operator, on the smallest tables."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulselake.llm import decontamination, jaccard_join, quality, toxicity
from pulselake.llm.common import in_fold


def test_stages(spark, sf, read):
    docs, kept = read("documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        if name != "byte_bpe":
            assert after.columns == docs.columns
            assert after.exceptAll(docs).isEmpty()
        kept.append((name, docs, after))
        docs = after
    by = {name: (before, after) for name, before, after in kept}

    labels = read("labels")
    before, after = by["quality"]
    scored = quality.classify(before, labels.selectExpr("doc_id", "quality AS label"), ~in_fold(3, 1))
    assert {r.doc_id for r in scored.filter("score >= 0.5").collect()} == {r.doc_id for r in after.collect()}

    before, after = by["toxicity"]
    models = toxicity.train(before, labels.selectExpr("doc_id", "toxic AS label"), ~in_fold(4, 2))
    texts = before.orderBy("doc_id").collect()
    scores = toxicity.Scorer(models).text_scores([r.text or "" for r in texts])
    assert {r.doc_id for r, x in zip(texts, scores) if x < toxicity.CUT} == {r.doc_id for r in after.collect()}

    before, after = by["jaccard_join"]
    groups = jaccard_join.join_components(before, 5, 80)
    tops = {r.component_id for r in groups.collect()}
    assert {r.doc_id for r in after.collect()} == tops

    before, after = by["decontamination"]
    hit = decontamination.report(decontamination.match(before, read("benchmark"))).filter("contaminated")
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in hit.collect()} == {r.doc_id for r in after.collect()}

    before, after = by["byte_bpe"]
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in after.collect()} == {i: (len(x), digest(x)) for i, x in own.items()}


def test_rows_without_an_id_of_their_own(spark, sf, docs):
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    words = [f"word{i}" for i in range(40)]
    texts = [passage, passage, passage, " ".join(words), " ".join(words), " ".join(words[:-1]), "", "", None, "lone words here"]
    frame = corpus_pipeline.written(docs(texts, [None, 4, 4, 5, 5, 3, 8, 8, None, 4]).withColumn("_id", F.lit(1)), "rows")
    left = corpus_pipeline.uncontaminated(spark, frame, sf)
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted((i or -1, t or "") for i, t in zip([5, 5, 3, 8, 8, None, 4], texts[3:]))
    one = corpus_pipeline.one_of_each_group(spark, frame, sf)
    assert sorted((r.doc_id or -1, r.text or "") for r in one.collect()) == sorted([(4, passage), (3, texts[5]), (8, ""), (8, ""), (-1, ""), (4, texts[9])])


def test_empty_documents(spark, sf, read):
    docs = read("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
