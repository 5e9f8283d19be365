"""Pipeline searches: shared prefixes, nested trees, one count table for all smoothings."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lurescan.operators import search as SR
from lurescan.operators.models import FEATURES


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        x = rng.integers(0, 4, 6).astype(float)
        y = int(x[0] + x[1] * x[2] + rng.integers(0, 4) > 5)
        rows.append((i, y, i % 3, Vectors.sparse(6, [(j, v) for j, v in enumerate(x) if v]) if i % 2 else Vectors.dense(x)))
    return spark.createDataFrame(rows, ["msg_id", "label", "fold", FEATURES]).cache()


@pytest.fixture(scope="module")
def texts(spark):
    words = ["win", "cash", "now", "meet", "lunch", "report", "free", "call"]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        y = i % 2
        picked = [words[k] for k in rng.integers(0 if y else 3, 8, 12)]
        rows.append((i, y, i % 3, " ".join(picked)))
    return spark.createDataFrame(rows, "msg_id long, label int, fold int, text string").cache()


def predicted(df):
    return {r.msg_id: r.pred for r in df.collect()}


def test_shallow_trees_are_read_off_deep_ones(vectors):
    trees = SR.Trees()
    fitted = trees.fit(vectors, [{"max_depth": None}])
    for depth in (1, 2, 3, 5, 8):
        own = DecisionTreeClassifier(featuresCol=FEATURES, maxDepth=depth, seed=42).fit(vectors).transform(vectors)
        want = predicted(own.select("msg_id", F.col("prediction").cast("int").alias("pred")))
        assert predicted(trees.predict(fitted, vectors, {"max_depth": depth})) == want


def test_small_nodes_are_not_split(vectors):
    tree = SR.Trees().fit(vectors, [{}])["trees"][0]
    x = np.array([r[FEATURES].toArray() for r in vectors.collect()])
    for least in (2, 20, 60):
        shares = tree.shares(x, 30, least)
        at = np.zeros(len(x), int)
        for i in range(len(x)):  # row by row
            while tree.left[at[i]] >= 0 and tree.rows[at[i]] >= least:
                n = at[i]
                at[i] = tree.left[n] if x[i, tree.feature[n]] <= tree.threshold[n] else tree.right[n]
        assert (shares == tree.share[at]).all()
    assert len(set(map(tuple, tree.shares(x, 30, 10_000)))) == 1


def test_forest_equals_its_model(vectors):
    point = {"n_estimators": 7, "max_depth": 4}
    forest = SR.Trees(forest=True)
    fitted = forest.fit(vectors, [point])
    own = RandomForestClassifier(featuresCol=FEATURES, numTrees=7, maxDepth=4, seed=42, featureSubsetStrategy="sqrt").fit(
        vectors.coalesce(1)).transform(vectors)
    assert predicted(forest.predict(fitted, vectors, point)) == predicted(
        own.select("msg_id", F.col("prediction").cast("int").alias("pred")))
    assert len(fitted["trees"]) == 7
    few = list(SR.Trees.scores(fitted, np.zeros((1, 6)), {0: {"n_estimators": 2}, 1: {"n_estimators": 7}}))
    assert [round(float(s.sum())) for _, s in few] == [2, 7]


def test_smoothings_share_one_table(vectors):
    bayes = SR.NaiveBayes()
    fitted = bayes.fit(vectors, [])
    for alpha in (0.1, 1.0, 5.0):
        own = NaiveBayes(featuresCol=FEATURES, smoothing=alpha).fit(vectors).transform(vectors)
        assert predicted(bayes.predict(fitted, vectors, {"alpha": alpha})) == predicted(
            own.select("msg_id", F.col("prediction").cast("int").alias("pred")))


def test_each_prefix_is_fitted_once_a_fold(texts):
    points = SR.grid(max_features=[3, 8], resample=[None, "oversample"], max_depth=[None, 2, 3], min_samples_split=[2, 5])
    found = SR.PipelineSearch([SR.Vectorise(), SR.Resample()], SR.Trees(), "f1", parallelism=2).run(texts, points)
    assert len(points) == 24 and set(found.fitted.values()) == {1}
    names = [name for _, name, _ in found.fitted]
    assert (names.count("Vectorise"), names.count("Resample"), names.count("Trees")) == (6, 12, 12)
    assert all(sum(found.counts[i, f].values()) == 30 for i in range(24) for f in range(3))
    table = found.table(texts.sparkSession).collect()
    assert len(table) == 72 and all(0 <= r.recall <= 1 for r in table)
    best = found.best()
    assert found.mean(best) == max(map(found.mean, range(24)))
    assert found.predict(texts, texts.drop("fold")).count() == 90


def test_fold_scores_equal_fits_by_hand(texts):
    """The vectoriser sees the fold's train rows only."""
    point = {"max_features": 5, "alpha": 1.0}
    found = SR.PipelineSearch([SR.Vectorise(tfidf=False)], SR.NaiveBayes()).run(texts, [point])
    for fold in range(3):
        train, held = texts.where(F.col("fold") != fold).drop("fold"), texts.where(F.col("fold") == fold).drop("fold")
        a, b = SR.Vectorise(tfidf=False)(train, [held], max_features=5)
        model = NaiveBayes(featuresCol=FEATURES, smoothing=1.0).fit(a)
        want = {(r.label, int(r.prediction)): r["count"] for r in model.transform(b).groupBy("label", "prediction").count().collect()}
        assert found.counts[0, fold] == want


def test_metrics_by_hand():
    counts = {(1, 1): 3, (1, 0): 1, (0, 1): 2, (0, 0): 4}
    assert SR.score(counts, "accuracy") == 0.7 and SR.score(counts, "recall") == 0.75 and SR.score(counts, "precision") == 0.6
    assert SR.score(counts, "f1") == pytest.approx(2 / 3) and SR.score(counts, "f1_macro") == pytest.approx((2 / 3 + 8 / 11) / 2)
    assert SR.score({(0, 0): 3}, "f1") == 0.0 and SR.score({}, "accuracy") == 0.0
    with pytest.raises(ValueError):
        SR.score(counts, "other")


def test_draws_and_unknown_settings(texts):
    points = SR.grid(a=[1, 2, 3], b=[1, 2], c=[1, 2, 3, 4])
    assert len(points) == 24 and len(SR.sampled(points, 5)) == 5 and SR.sampled(points, 5) == SR.sampled(points, 5)
    drawn = SR.sampled(points, 8, shared=("a", "b"), per_group=4)
    assert len(drawn) == 8 and len({(p["a"], p["b"]) for p in drawn}) == 2
    with pytest.raises(ValueError):
        SR.PipelineSearch([SR.Vectorise()], SR.NaiveBayes()).run(texts, [{"depth": 1}])


def test_smaller_vocabularies_are_heads_of_one_ranking(spark):
    rows = [(i, i % 2, f"aa bb{i % 3} cc{i % 7} dd{i}") for i in range(40)]
    train = spark.createDataFrame(rows, "msg_id long, label int, text string").cache()
    alone = {k: SR.Vectorise(bundle="email")(train, [], k, 2)[0].collect() for k in (3, 9)}
    shared, ranked = SR.Vectorise(bundle="email"), []
    shared.expect([{"max_features": k, "ngram_max": 2} for k in (3, 9)])
    kept = shared.words(train).cache()
    for k in (3, 9):
        assert shared(kept, [], k, 2)[0].orderBy("msg_id").collect() == sorted(alone[k], key=lambda r: r.msg_id)
        ranked.append(shared._ranked)
    assert ranked[0] is ranked[1]
