"""Trees grown where their rows are: the same splits as Spark's, whole, and bounded in what a task holds."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lurescan.operators import forest as FO
from lurescan.operators import models as MD
from lurescan.operators import search as SR


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        x = np.round(rng.normal(0, 2, 8)) * (rng.random(8) < 0.6)
        y = int(x[0] + x[1] * x[2] + rng.normal(0, 1) > 0.5)
        out.append((i, y, 1.0 + 2 * y, Vectors.sparse(8, [(j, v) for j, v in enumerate(x) if v]) if i % 2 else Vectors.dense(x)))
    return spark.createDataFrame(out, ["msg_id", "label", "weight", "features"]).repartition(3, "msg_id").cache()


def shares(model, df):
    return {r.msg_id: r.p for r in model.transform(df).select("msg_id", vector_to_array("probability").alias("p")).collect()}


@pytest.mark.parametrize("entries", [FO.GROUP_ENTRIES, 400])
@pytest.mark.parametrize("least", [1, 4])
def test_a_tree_is_that_of_spark(rows, monkeypatch, entries, least):
    monkeypatch.setattr(FO, "SPARK_ROWS", 60)
    monkeypatch.setattr(FO, "GROUP_ENTRIES", entries)
    est = DecisionTreeClassifier(maxDepth=12, minInstancesPerNode=least, weightCol="weight", seed=5)
    own, want = FO.fit(est, rows, 600), est.fit(rows.coalesce(1))
    assert isinstance(own, FO.ForestModel) and own.totalNumNodes == want.numNodes
    a, b = shares(own, rows), shares(want, rows)
    assert all(np.allclose(a[i], b[i]) for i in b)
    assert np.allclose(own.featureImportances.toArray(), want.featureImportances.toArray())


@pytest.mark.parametrize("entries", [FO.GROUP_ENTRIES, 700])
def test_large_forests_are_not_given_to_one_estimator(spark, rows, monkeypatch, tmp_path, entries):
    """Statistics of every open node in every task grow with the rows; these are grown in tasks of bounded size."""
    monkeypatch.setattr(FO, "SPARK_ROWS", 60)
    monkeypatch.setattr(FO, "GROUP_ENTRIES", entries)
    est = MD.estimator("forest").setNumTrees(20)
    want = shares(est.fit(rows), rows)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a, **k: pytest.fail("the estimator's own fit"))
    model = MD.fit(est, rows, 600)
    assert len(model.trees) == 20 and model.hasParam("probabilityCol")
    got = shares(model, rows)
    y = {r.msg_id: r.label for r in rows.collect()}
    assert np.mean([np.argmax(got[i]) == y[i] for i in y]) > 0.95
    assert abs(np.mean([got[i][1] - want[i][1] for i in y])) < 0.03
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    PipelineModel(stages=[model]).write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert shares(back, rows) == got
    out = MD.prediction_frame(back, rows).collect()
    assert all(r.pred == int(np.argmax(r.proba)) and abs(sum(r.proba) - 1) < 1e-9 for r in out)


def test_rows_are_drawn_as_by_poisson():
    n = np.bincount(np.concatenate([FO.bag(np.arange(20_000), t, 42, True) for t in range(10)]), minlength=8)
    assert abs(n[0] / n.sum() - np.exp(-1)) < 0.005 and abs(n[2] / n.sum() - np.exp(-1) / 2) < 0.005
    assert (FO.bag(np.arange(9), 3, 42, False) == 1).all()


def test_nodes_are_searched_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    n, d = 400, 30
    size = np.full(n, 6, np.int32)
    f = np.concatenate([np.sort(rng.choice(d, 6, replace=False)) for _ in range(n)])
    b, y = rng.integers(1, 4, len(f)).astype(np.uint8), rng.integers(0, 2, n).astype(np.int32)
    spec = {"d": d, "classes": 2, "least": 1, "zero": np.zeros(d, np.uint8), "drawn": d, "seed": 1, "depth": 30}
    whole = FO.grow(y, np.ones(n), np.ones(n, np.int64), size, f, b, spec, 0, (0, 0))
    monkeypatch.setattr(FO, "CELLS", 4 * d)
    parts = FO.grow(y, np.ones(n), np.ones(n, np.int64), size, f, b, spec, 0, (0, 0))
    assert all((whole[x] == parts[x]).all() for x in whole) and len(whole["kid"]) > 100
    few = FO.grow(y, np.ones(n), np.ones(n, np.int64), size, f, b, {**spec, "drawn": 6}, 0, (0, 0))
    monkeypatch.setattr(FO, "_Dense", FO._Sparse)
    same = FO.grow(y, np.ones(n), np.ones(n, np.int64), size, f, b, {**spec, "drawn": 3, "zero": (np.arange(d) == 2) * np.uint8(4)}, 0, (0, 0))
    monkeypatch.undo()
    monkeypatch.setattr(FO, "CELLS", 4 * d)
    dense = FO.grow(y, np.ones(n), np.ones(n, np.int64), size, f, b, {**spec, "drawn": 3, "zero": (np.arange(d) == 2) * np.uint8(4)}, 0, (0, 0))
    assert all((same[x] == dense[x]).all() for x in same)
    assert len(few["kid"]) > 100 and few["stats"][few["kid"] < 0].sum() == whole["stats"][whole["kid"] < 0].sum() == 2 * n


def test_searches_read_grown_trees(rows, monkeypatch):
    """Trees reach the searches as arrays, not as a row a node."""
    monkeypatch.setattr(FO, "SPARK_ROWS", 60)
    monkeypatch.setattr(SR, "read_trees", lambda *a: pytest.fail("rows of nodes on the driver"))
    trees = SR.Trees()
    fitted = trees.fit(rows, [{"max_depth": None}])
    for depth in (1, 3, 6):
        own = DecisionTreeClassifier(maxDepth=depth, seed=42).fit(rows).transform(rows)
        want = {r.msg_id: r.prediction for r in own.collect()}
        got = {r.msg_id: r.pred for r in trees.predict(fitted, rows, {"max_depth": depth}).collect()}
        assert got == want
    rest = rows.where(F.col("msg_id") % 3 > 0)
    assert len(SR.Trees(forest=True).fit(rest, [{"n_estimators": 7, "bootstrap": False}])["trees"]) == 7
