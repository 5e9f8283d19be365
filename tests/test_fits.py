"""Fits and decompositions: reproducible, complete, and right where a small example can say so."""

import numpy as np
import pytest
from paths import SF_SMALL
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.operators import models as MD
from lurescan.operators import neighbors, ranking, resample, svd
from lurescan.operators import vectorize as V
from lurescan.plans import q_models as Q
from lurescan.sources import fixtures as FX


def test_vocabulary_does_not_depend_on_partitions(spark):
    m = FX.m2(spark, SF_SMALL)
    a = MD.vocabulary(m.repartition(2), "text", 300)
    b = MD.vocabulary(m.repartition(7).orderBy(F.desc("msg_id")), "text", 300)
    assert a == b and len(a) == 300


def test_predictions_do_not_depend_on_partitions(spark):
    m = FX.m2(spark, SF_SMALL).select("msg_id", "label", "text")
    got = []
    for n in (2, 5):
        feats, names = MD.featurize(m.repartition(n, "msg_id"), "text", 200, None)
        model = MD.estimator("nb").fit(feats)
        got.append(sorted((r.msg_id, r.pred) for r in MD.prediction_frame(model, feats).collect()))
    assert got[0] == got[1]


def test_small_vocabulary_fits_every_model(spark):
    """Vector width follows the fitted vocabulary."""
    rows = [(i, i % 2, ("good day sir " if i % 2 else "win money now ") * (1 + i % 3)) for i in range(24)]
    df = spark.createDataFrame(rows, "msg_id long, label int, text string")
    feats, names = MD.featurize(df, "text", 1000, "email")
    assert len(feats.first().features) == len(names) < 30
    for name in ("mlp", "svm_linear", "logreg", "tree"):
        model = MD.estimator(name, len(names), n_rows=24, layers=(5,)).fit(feats)
        assert MD.prediction_frame(model, feats).where("label = pred").count() == 24
    z = MD.random_fourier(feats, len(names), MD.scale_gamma(feats, len(names)))
    assert len(z.first().features) == 256


def test_penalty_matters(spark):
    rows = [(float(i % 2), [float(i % 2) * 2 + 0.01 * i, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "label double, f array<double>").select("label", array_to_vector("f").alias("features"))
    weak, strong = (MD.estimator("logreg", n_rows=n).fit(df).coefficientMatrix.toArray() for n in (30_000, 1))
    assert np.abs(weak).max() > 2 * np.abs(strong).max()


def _folded(spark, classes):
    rng = np.random.default_rng(1)
    rows = [(i, i % classes, [float(x) for x in rng.normal(i % classes, 0.4, 3) ** 2], i // classes % 3) for i in range(60)]
    return spark.createDataFrame(rows, "msg_id long, label int, f array<double>, fold int").select(
        "msg_id", "label", "fold", array_to_vector("f").alias("features"))


@pytest.mark.parametrize("classes", [2, 3])
def test_stacking_uses_every_class(spark, classes):
    df = _folded(spark, classes)
    bases = [MD.estimator(b, 3, classes, n_rows=60) for b in ("tree", "logreg")]
    fitted = bases[0].fit(df)
    _, col = MD.class_scores(fitted, classes, 0)
    width = MD.class_scores(fitted, classes, 0)[0].transform(df).select(F.size(col).alias("n")).first().n
    assert width == (1 if classes == 2 else 3)
    out = MD.stack(df, df.drop("fold"), bases, MD.estimator("logreg", 2, classes, n_rows=60), classes)
    assert out.count() == 60 and out.where("label = pred").count() > 45


def test_platt_probabilities_rise_with_the_margin(spark):
    df = _folded(spark, 2)
    out = MD.platt_svm(df, df, n_rows=60)
    margins = MD.estimator("svm_linear", n_rows=60).fit(df).transform(df).select("msg_id", "rawPrediction")
    rows = sorted((r.rawPrediction[1], r.proba[1]) for r in out.join(margins, "msg_id").collect())
    p = [x for _, x in rows]
    assert all(a <= b + 1e-12 for a, b in zip(p, p[1:])) and len(p) == 60


def test_svd_against_numpy_with_zero_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 12)) * (rng.random((40, 12)) < 0.4) * np.linspace(3, 0.2, 12)
    x[[3, 17]] = 0
    long = [(i, f"t{j:02d}", float(x[i, j])) for i in range(40) for j in range(12) if x[i, j]]
    w = spark.createDataFrame(long, "doc_id long, term string, weight double").repartition(5)
    vocab = spark.createDataFrame([(f"t{j:02d}",) for j in range(12)], "term string")
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    got = np.zeros((40, 4))
    for r in svd.truncated_svd(w, ids, "doc_id", vocab, 4).collect():
        got[r.doc_id, r.component] = r.value
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    want = x @ vt[:4].T
    sign = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * sign, atol=1e-4) and not got[3].any()
    rows, d = svd.matrix_rows(w, ids, "doc_id", vocab)
    v = svd.loadings(rows, d, 4)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9) and rows.count() == 40


def test_knn_keeps_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.qid, r.nid, round(r.dist, 3)) for r in neighbors.knn(df, df, 2).collect())
    assert [(q, n) for q, n, _ in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert all(d == 1.0 for q, n, d in got if 0 in (q, n))
    plan = neighbors.knn(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_smote_refuses_small_classes(spark):
    rows = [(i, 0, [float(i)]) for i in range(20)] + [(100 + i, 1, [float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="class 1 has 4 rows"):
        resample.smote(df, "vec_id", "embedding", "label", k=5)
    got = resample.smote(df, "vec_id", "embedding", "label", k=3).collect()
    assert len(got) == 16 and {r.label for r in got} == {1} and len({r.vec_id for r in got}) == 16


def test_ranks_for_any_ids(spark):
    ids = [*range(999), 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, "a") for i in ids], "id long, g string")
    got = {r.id: r.rank for r in ranking.rank_in_groups(df, ["g"], ["id"]).collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(ids))}
    sizes = (df.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
    assert sizes < 400


def test_row_counts_equal_counter(spark):
    from collections import Counter

    rows = [(0, ["b", "a", "b"]), (1, []), (2, ["x"]), (3, ["z", "z", "z"]), (4, None)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = {(r.id, r.term): r.tf for r in V.term_counts(df, "id", F.col("t")).collect()}
    assert got == {(i, w): n for i, t in rows for w, n in Counter(t or []).items()}
    plan = V.term_counts(df, "id", F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("text", [
    "Tue, 5 Aug 2008 23:31:02 -0700", "Tue, 5 Aug 2008 23:31:02 -0700 (PDT)", "2008-08-05T23:31:02Z", "5 Aug 2008", "8/5/2008",
    "Aug 5, 2008", "Tue Aug  5 23:31:02 2008", "05 August 2008", "2008-08-05 23:31:02.25+02:00", "August 5, 2008 11:31 PM",
    "Tue, 05 Aug 2008 23:31:02 GMT"])
def test_date_forms(spark, text):
    assert spark.createDataFrame([(text,)], "d string").select(T.clean_date("d")).first()[0] == "05/08/2008"


def test_no_date(spark):
    df = spark.createDataFrame([("junk",), (None,), ("",), ("2008-13-45",), ("n/a #7",)], "d string")
    assert [r[0] for r in df.select(T.clean_date("d")).collect()] == [None] * 5


def test_digit_forms(spark):
    text = "1²3 ٣ ① x½"
    row = spark.createDataFrame([(text,)], "t string").select(T.num_digits("t"), T.num_decimals("t")).first()
    assert row[0] == sum(c.isdigit() for c in text) and row[1] == sum(c.isdecimal() for c in text)


def test_scored_table_is_whole(spark):
    import __spark_entry__ as E

    out = E.queries()["score_messages"](spark, SF_SMALL)
    assert out.count() == 200 and {"body", "lang", "source", "prediction"} <= set(out.columns)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("grouped", [False, True])
def test_knn_with_many_cells_is_exact(spark, metric, grouped):
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 5, (12, 4))
    x = centre[rng.integers(0, 12, 400)] + rng.normal(0, 0.4, (400, 4))
    x[[5, 50]] = 0
    x[7] = x[8]
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in x[i]]) for i in range(400)], "vec_id long, g int, embedding array<double>")
    got: dict = {}
    out = neighbors.knn(df, df, 4, metric=metric, group_col="g" if grouped else None, block_rows=16)
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.nid, r.dist))
    norm = np.sqrt((x * x).sum(1))
    for q in range(400):
        if metric == "cosine":
            nn = norm * norm[q]
            d = 1 - np.divide(x @ x[q], nn, out=np.zeros(400), where=nn > 0)
        else:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        if grouped:
            d[np.arange(400) % 3 != q % 3] = np.inf
        assert np.allclose([v for _, v in got[q]], np.sort(d)[:4], atol=1e-9)
        assert all(np.isclose(d[n], v) for n, v in got[q])


@pytest.mark.parametrize("key", ["model_knn_text", "pipeline_smote_tomek"])
def test_every_test_row_is_predicted_and_mostly_right(spark, key):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    out = E.queries()[key](spark, sf).collect()
    assert len(out) == 100 and all(r.pred in (0, 1) for r in out)
    assert sum(r.pred == r.label for r in out) >= 80


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A driver that knows the package by sys.path only: workers get it from the session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from lurescan.session import get_session
from lurescan.operators.neighbors import knn
spark = get_session("local[2]", 2)
df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
print("rows", knn(df, df, 2).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 18" in got.stdout, got.stderr[-2000:]


def test_fits_run_in_few_partitions(spark):
    df = spark.range(5 * MD.TASK_ROWS).repartition(64).cache()
    assert MD.fit_rows(df).rdd.getNumPartitions() <= min(5, spark.sparkContext.defaultParallelism)
    assert MD.fit_rows(df, 10).rdd.getNumPartitions() == 1
    assert MD.fit_rows(df).count() == df.count()


def test_term_counts_works_out_the_tokens_once(spark):
    df = spark.createDataFrame([(0, "b a b")], "id long, text string")
    plan = V.term_counts(df, "id", V.sklearn_tokens("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("sort_array") == 1


def test_chunk_tokens_splits_a_text_once(spark):
    import __spark_entry__ as E

    plan = E.queries()["chunk_tokens"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_rows_of_fits_have_no_lineage(spark):
    texts = [(i, f"word{i % 7} other{i % 3} 12 ok", i % 2) for i in range(60)]
    df = spark.createDataFrame(texts, "msg_id long, text string, label int").repartition(5, "msg_id")
    feats, names = MD.featurize(df, "text", 10, "email")
    meta = feats.schema[MD.FEATURES].metadata
    assert meta == {"ml_attr": {"num_attrs": len(names)}}
    held = MD.settled(feats)
    assert sorted(map(str, held.collect())) == sorted(map(str, feats.collect()))
    text = held._jdf.queryExecution().logical().toString()
    assert "Join" not in text and "regexp" not in text and "UDF" not in text


def test_linear_fits_read_fewer_partitions_and_folds_keep_their_order(spark):
    rows = spark.range(400).select((F.col("id") % 5).alias("fold"), (F.col("id") % 2).cast("double").alias("label"),
                                   F.col("id").alias("msg_id"))
    train = MD.VectorAssembler(inputCols=["label"], outputCol="features").transform(rows).repartition(6).cache()

    class Seen(MD.LinearSVC):
        def fit(self, dataset, params=None):
            return dataset.rdd.getNumPartitions(), dataset.agg(F.sum("msg_id")).first()[0]

    jobs = [(Seen(), train.where(F.col("fold") != f)) for f in range(5)]
    assert MD.fit_all(jobs, 400) == [(1, sum(i for i in range(400) if i % 5 != f)) for f in range(5)]


def test_digits_are_those_of_python(spark):
    texts = ["", "abc 123", "\u00b2\u00bc\u0663 9", "\U0001d7ce\u2460x", "0\u0660\u00b9\u4e00", "\n7\x7f8\x80"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", T.num_digits("t")).collect()}
    assert got == {t: sum(c.isdigit() for c in t) for t in texts}


def test_deep_trees_keep_node_ids(spark):
    """Rows keep the node they have reached between passes, and the trees are the same as without."""
    rows = [(i, i * 7919 % 13 % 2, f"w{i * 31 % 17} w{i * 17 % 11} w{i % 5}") for i in range(120)]
    feats, _ = MD.featurize(spark.createDataFrame(rows, "msg_id long, label int, text string").coalesce(2), "text", 100, None)
    feats = feats.cache()
    for name in ("tree", "forest"):
        est = MD.estimator(name)
        if name == "forest":
            est = est.setNumTrees(5)
        assert est.getCacheNodeIds()
        assert est.fit(feats).toDebugString.split("\n")[1:] == est.copy().setCacheNodeIds(False).fit(feats).toDebugString.split("\n")[1:]
    feats.unpersist()


def test_fits_work_out_the_texts_of_their_own_rows_only(spark, monkeypatch):
    seen, real = [], MD.with_features
    monkeypatch.setattr(MD, "with_features", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    train, test, names, _, n = Q.prepared(spark, SF_SMALL)
    assert seen == [n, test.count()] and train.count() == n
    assert {len(r.features) for r in test.select("features").collect()} == {len(names)}
