"""One-against-one SVM: coupling against its definition, votes against margins, fits on three classes."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lurescan.operators import models as MD
from lurescan.operators import pairwise as PW


def loss(p, r, n):
    out = 0.0
    for q, (i, j) in enumerate(combinations(range(n), 2)):
        out += 2 * ((1 - r[q]) * p[i] - r[q] * p[j]) ** 2
    return out


@pytest.mark.parametrize("n", [2, 3, 5])
def test_consistent_pairs_give_their_probabilities_back(n):
    rng = np.random.default_rng(n)
    p = rng.dirichlet(np.ones(n), 20)
    r = np.stack([p[:, i] / (p[:, i] + p[:, j]) for i, j in combinations(range(n), 2)], axis=1)
    assert np.allclose(PW.couple(r, n), p, atol=1e-5)


@pytest.mark.parametrize("n", [3, 4])
def test_coupling_is_the_least_point_of_the_simplex(n):
    rng = np.random.default_rng(7)
    r = rng.uniform(0, 1, (10, n * (n - 1) // 2))
    r[0], r[1] = 0.0, 1.0
    p = PW.couple(r, n)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    for row, best in zip(np.clip(r, PW.CLIP, 1 - PW.CLIP), p):
        others = rng.dirichlet(np.ones(n) * 0.5, 300)
        near = np.clip(best + rng.normal(0, 1e-3, (300, n)), 0, None)
        for q in (*others, *(near / near.sum(axis=1, keepdims=True))):
            assert loss(best, row, n) <= loss(q, row, n) + 1e-12


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    centre = np.array([[0, 0], [3, 0], [0, 3]])
    rows = [(k, k % 3, [float(v) for v in centre[k % 3] + rng.normal(0, 0.8, 2)], k // 3 % 3) for k in range(180)]
    df = spark.createDataFrame(rows, "msg_id long, label int, f array<double>, fold int").select(
        "msg_id", "label", "fold", array_to_vector("f").alias("features")).cache()
    return df, PW.fit_one_vs_one(MD.balanced_weights(df), 3, weighted=True)


def test_votes_follow_the_margins(fitted):
    df, model = fitted
    margins = {r.msg_id: list(r.margins) for r in model.margins(df).collect()}
    for r in model.predict(df).collect():
        count = [0, 0, 0]
        for (i, j), m in zip([(0, 1), (0, 2), (1, 2)], margins[r.msg_id]):
            count[i if m > 0 else j] += 1
        assert r.pred == count.index(max(count))


def test_probabilities_of_three_classes(fitted):
    df, model = fitted
    got = model.predict(df).collect()
    assert len(got) == 180
    assert all(abs(sum(r.proba) - 1) < 1e-9 and min(r.proba) >= 0 for r in got)
    assert sum(r.pred == r.label for r in got) > 155
    assert sum(int(np.argmax(r.proba)) == r.label for r in got) > 155
    margins = {r.msg_id: r.margins for r in model.margins(df).collect()}
    for r in got:
        z = [a * m + b for (a, b), m in zip(model.sigmoids, margins[r.msg_id])]
        want = PW.couple(1 / (1 + np.exp(-np.array([z]))), 3)[0]
        assert np.allclose(want, r.proba, atol=1e-9)


def test_a_pair_is_fitted_on_its_two_classes_only(fitted):
    df, model = fitted
    pair = MD.balanced_weights(df).where("label in (0, 2)").withColumn("label", (F.col("label") == 0).cast("double"))
    alone = MD.estimator("svm_linear", weighted=True, c=pair.agg(F.sum("weight")).first()[0]).fit(pair)
    assert np.allclose(alone.coefficients.toArray(), model.svms[1].coefficients.toArray(), atol=1e-6)


def test_class_without_rows_is_an_error(spark, fitted):
    with pytest.raises(ValueError, match="class 3"):
        PW.fit_one_vs_one(fitted[0], 4)
