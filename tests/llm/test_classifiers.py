"""Language, quality and toxicity: held-out accuracy and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import language_id, quality, toxicity
from pulselake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_held_out(spark):
    found = QUERIES["op1_language_id"](spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert np.mean([r.ok for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_odd_rows(docs, spark):
    model = language_id.fit(["the cat and the dog", "der hund und die katze"] * 3, ["en", "de"] * 3, landmarks=3)
    df = docs([None, "", "123 !!", "the dog", "der hund", "the dog " * 20000, "the dog"], ids=[0, 1, 2, 3, 4, 5, None])
    got = language_id.predict(df, model, ["doc_id"]).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de", "en", "en"]
    assert [r.score for r in got[:3]] == [0, 0, 0]
    assert language_id.predict(df.limit(0), model, ["doc_id"]).count() == 0
    nothing = language_id.train(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(df, nothing, ["doc_id"]).collect()} == {"und"}


def test_letters_beyond_the_listed_ones_count(monkeypatch):
    monkeypatch.setattr(language_id, "OWN_LETTERS", 3)
    texts, labels = ["кот и собака", "дом и река", "猫と犬", "家と川", "the cat", "a dog"] * 2, ["ru", "ru", "ja", "ja", "en", "en"] * 2
    found, _ = language_id.Scorer(language_id.fit(texts, labels, landmarks=2)).predict(["собака и дом", "川と犬", "the dog"])
    assert found == ["ru", "ja", "en"]


def test_direct_kernel_ridge():
    """With every text a landmark, the Nyström features give what ridge regression on the kernel itself gives."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde "), 30)) + word for word in ("x", "y") for _ in range(12)]
    labels = ["p"] * 12 + ["q"] * 12
    model = language_id.fit(texts, labels, landmarks=12, ridge=0.05)
    sets = [{t[i : i + n] for t in (f" {w} " for w in s.split()) for n in (1, 2, 3) for i in range(len(t) - n + 1) if (n == 3 or " " not in t[i : i + n])} for s in texts]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    centre = np.eye(24) - 1 / 24
    target = np.where(np.array(labels)[:, None] == np.array(["p", "q"]), 1.0, -1.0)
    dual = np.linalg.solve(centre @ kernel @ centre + 0.05 * 24 * np.eye(24), target - target.mean(axis=0))
    wanted = centre @ kernel @ centre @ dual + target.mean(axis=0)
    scorer = language_id.Scorer(model)
    assert np.allclose(scorer.kernel(texts) @ scorer.weights + model.bias, wanted, atol=2e-3)


def test_training_on_columns_that_clash(docs, spark):
    df = docs(["the cat and the dog", "the house"] * 400).withColumn("_id", F.lit(3)).withColumn("rank", F.lit(0))
    assert language_id.train(df, F.lit(True), samples=50).languages == ("en",)


def test_convolution_against_formula(small_network):
    network, language = small_network
    scorer = toxicity.Scorer(small_network)
    texts = ["the nasty and the", "", "and", "vile the and the nasty the"]
    wanted = []
    for text in texts:
        rows = [*scorer.word_rows(text).tolist(), 0, 0, 0]
        pooled = []
        for width, weights, offset in zip(toxicity.WIDTHS, network.filters, network.offsets):
            at = [np.concatenate([network.vectors[r] for r in rows[i : i + width]]) @ weights + offset for i in range(len(rows) - width + 1)]
            pooled.append(np.maximum(np.max(at, axis=0), 0))
        wanted.append(np.concatenate(pooled) @ network.out + network.bias)
    assert np.allclose(scorer.logits(texts), wanted, atol=1e-4)


def test_presence_kernel_by_hand():
    model = language_id.fit(["ab", "cd"], ["x", "y"], landmarks=1)
    scorer = language_id.Scorer(model)
    # ab: a, b, ab, _ab, ab_ and so one text shares all five with itself and none with the other
    assert np.allclose(scorer.kernel(["ab ab", "cd"]), [[5 / 5**0.5, 0], [0, 5 / 5**0.5]])


def test_quality_held_out(spark):
    found = QUERIES["op2_quality"](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    held = found.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)


def test_quality_odd_rows(docs, spark):
    df = docs([None, "", "A plain line.", "x " * 50000, "A plain line."], ids=[0, 1, 2, 3, 2])
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r.score for r in quality.classify(df, none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1), (9, 0), (3, None)], "doc_id bigint, label int")
    got = quality.classify(df, one, F.lit(True)).collect()
    assert len(got) == 5 and {r.score for r in got} == {1.0}
    assert quality.classify(df.limit(0), one, F.lit(True)).count() == 0


def test_quality_density_against_formula():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    counts, sums = np.array([120.0, 80.0]), np.stack([x[:120].sum(0), x[120:].sum(0)])
    model = quality.fit(counts, sums, np.stack([x[:120].T @ x[:120], x[120:].T @ x[120:]]), 0.2, 0.1)

    def density(k):
        away = x - model.means[k]
        inverse = np.linalg.inv(model.covariances[k])
        return model.priors[k] - 0.5 * np.linalg.slogdet(model.covariances[k])[1] - 0.5 * np.einsum("ni,ij,nj->n", away, inverse, away)

    assert np.allclose(quality.Scorer(model).scores(x), 1 / (1 + np.exp(density(0) - density(1))))


@pytest.fixture(scope="module")
def small_network():
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(40)]
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, labels = [], []
    for i in range(300):
        own = [word() for _ in range(10)] + ["and", "the"] * 4
        if i % 3 == 0:
            own.insert(int(rng.integers(0, 10)), ["nasty", "vile"][i % 2])
        texts.append(" ".join(own))
        labels.append(int(i % 3 == 0))
    assert plain
    language = language_id.fit(texts[:20], ["en"] * 20, landmarks=10)
    return toxicity.fit(texts, labels, language, steps=400), language


def test_toxicity_learns_words(docs, small_network):
    df = docs([None, "", "the nasty and the", "the and the", ("the and " * 20000) + "vile", "NASTY, the and"], ids=[0, 1, 2, 3, 4, None])
    got = toxicity.score(df, small_network, ["doc_id"]).collect()
    assert [r.score >= toxicity.CUT for r in got] == [False, False, True, False, True, True]
    assert toxicity.score(df.limit(0), small_network, ["doc_id"]).count() == 0


def test_toxicity_without_labels(docs, spark):
    df = docs(["a", "b"])
    models = toxicity.train(df, spark.createDataFrame([], "doc_id bigint, label int"), F.lit(True))
    assert {r.score for r in toxicity.score(df, models, ["doc_id"]).collect()} == {0.0}


def test_toxicity_query(spark, sf):
    got = QUERIES["op6_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_toxicity_learns_and_sets_thresholds_from_all_labels(docs, spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(8)] + ["and", "the"] * 3 + (["nasty"] if i % 2 else [])) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (7, None), (9999, 0)], "doc_id bigint, label int")
    seen = {}
    refine, whole_cuts = toxicity.refine, toxicity.whole_cuts
    monkeypatch.setattr(toxicity, "refine", lambda known, net: (seen.update(taught=known.count()), refine(known, net))[1])
    monkeypatch.setattr(toxicity, "whole_cuts", lambda known, models: (seen.update(aside=known.count()), whole_cuts(known, models))[1])
    df = docs(texts)
    models = toxicity.train(df, labels, F.lit(True), samples=40)
    assert seen["taught"] + seen["aside"] == 400 and seen["aside"] > 40
    got = toxicity.score(df, models, ["doc_id"]).collect()
    assert np.mean([(r.score >= toxicity.CUT) == (r.doc_id % 2 == 1) for r in got]) > 0.95


def test_toxicity_shuffles_no_texts_and_learns_the_same_whatever_the_join(docs, spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(8)] + ["and", "the"] * 3 + (["nasty"] if i % 2 else [])) for i in range(400)]
    df, labels = docs([*texts, None, ""]), spark.createDataFrame([(i, i % 2) for i in range(402)], "doc_id bigint, label int")
    plans, refine, whole_cuts = [], toxicity.refine, toxicity.whole_cuts
    seen = lambda known: plans.append((known.columns, known._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(toxicity, "refine", lambda known, net: (seen(known), refine(known, net))[1])
    monkeypatch.setattr(toxicity, "whole_cuts", lambda known, other: (seen(known), whole_cuts(known, other))[1])
    nets = []
    try:
        for partitions, broadcast in ((8, "10MB"), (3, "-1")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
            nets.append(toxicity.train(df, labels, F.lit(True), samples=40)[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 4
    assert all("text" not in columns and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for columns, plan in plans)
    one, other = nets
    assert one.cuts == other.cuts and abs(one.bias - other.bias) < 1e-12
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(toxicity._flat(one), toxicity._flat(other)))


def test_toxicity_makes_only_labelled_texts_ready(docs, spark):
    labels = spark.createDataFrame([(i,) for i in (*range(0, 50_000, 10), 5, 5)], "_id bigint")
    bits = spark.sparkContext.broadcast(toxicity.marks(labels))
    net = toxicity.Network(np.zeros(0, np.int64), np.zeros((1, 2), np.float32), [], [], np.zeros(0), 0.0)
    mark = toxicity.hashed("doc_id", labels.schema["_id"].dataType, toxicity.MARKS).alias("mark")
    df = docs(["a b"] * 1000, ids=[*range(999), None]).select("doc_id", "text", mark)
    got = [r.doc_id for r in toxicity.coded(df, net, bits).collect()]
    assert {*range(0, 999, 10), 5} <= set(got) and len(got) < 110
