"""The cell tree of the neighbour search: exact, and a query's copies do not grow with the references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescan.operators import neighbors as NB


def blobs(n, clusters=12, dims=3, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 20, (clusters, dims))
    return centre[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dims))


def tree_over(x, metric="euclidean"):
    form = NB._search_form(x, metric)
    tree = NB.CellTree(form[:max(1, int(len(x) ** 0.5))])
    leaf, dist, top = tree.place(form)
    for c in np.unique(leaf):
        own = leaf == c
        tree.hold([{"g": "all", "leaf": int(c), "n": int(own.sum()), "lo": dist[own].min(), "hi": dist[own].max(),
                    "top_lo": top[own].min(), "top_hi": top[own].max()}])
    return tree, leaf, form


def copies(n, k=6):
    """Mean number of leaves that a query meets, with the true k-th distance as the bound of the second visit."""
    x = blobs(n)
    tree, _, form = tree_over(x)
    asked = form[::max(1, n // 500)]
    tau = np.sort(NB._distances(asked, form), axis=1)[:, k - 1]
    return (len(tree.first("all", asked, k)[0]) + len(tree.reach("all", asked, k, tau)[0])) / len(asked)


def test_copies_of_a_query_do_not_grow_with_the_references():
    few, many, most = copies(2_000), copies(16_000), copies(64_000)
    assert max(many, most) <= few * 1.1 + 0.2
    assert most < 3


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_no_leaf_in_reach_is_left_out(metric):
    x = blobs(1500, clusters=4, dims=6, seed=9)
    x[:40] = x[0]
    x[50] = 0
    tree, leaf, form = tree_over(x, metric)
    d = NB._distances(form, form)
    tau = np.sort(d, axis=1)[:, 5]
    met = np.zeros((len(x), len(tree.leaves)), bool)
    for query, at in (tree.first("all", form, 6), tree.reach("all", form, 6, tau)):
        assert not met[query, at].any()  # no leaf is named twice
        met[query, at] = True
    near = d <= tau[:, None]
    assert met[np.nonzero(near)[0], leaf[np.nonzero(near)[1]]].all()


def test_first_leaves_hold_enough():
    x = blobs(900)
    tree, _, form = tree_over(x)
    for need in (1, 7, 400, 900, 2000):
        query, at = tree.first("all", form[:50], need)
        held = np.bincount(query, weights=tree.groups["all"]["n"][at], minlength=50)
        assert (held >= min(need, 900)).all()


def test_least_breaks_ties_by_id():
    d = np.array([[1.0, 0.5, 1.0, 1.0], [2.0, 2.0, 2.0, 2.0]])
    nid = np.broadcast_to(np.array([9, 8, 3, 5]), d.shape)
    row, col = NB._least(d, nid, 2)
    assert list(zip(row, nid[row, col])) == [(0, 8), (0, 3), (1, 3), (1, 5)]


def test_a_tree_of_bounded_bytes_and_split_leaves_change_nothing(spark):
    x = np.round(blobs(700, clusters=3), 1)
    x[100:250] = x[100]  # one leaf holds a fifth of the rows
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = NB.knn(df, df, 4, metric="euclidean").orderBy("qid", "rank").collect()
    spark.conf.set("lurescan.knn.treeBytes", "160")  # five leaves
    try:
        got = NB.knn(df, df, 4, metric="euclidean", block_rows=4).orderBy("qid", "rank").collect()
    finally:
        spark.conf.unset("lurescan.knn.treeBytes")
    assert [(r.qid, r.nid, r.rank) for r in got] == [(r.qid, r.nid, r.rank) for r in want]


def test_rows_without_vector_group_or_id_take_no_part(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0]), (3, None, [0.1]), (4, "a", None), (None, "a", [0.2]), (5, "b", [3.0])],
                               "vec_id long, g string, embedding array<double>")
    got = NB.knn(df, df, 3, metric="euclidean", group_col="g").collect()
    assert sorted((r.qid, r.nid) for r in got) == [(1, 2), (2, 1)]
    assert NB.knn(df, df.where(F.lit(False)), 3).count() == 0


def test_a_query_travels_once_to_a_bin(spark):
    x = np.random.default_rng(3).normal(0, 1, (3000, 24))  # hardly any leaf can be ruled out
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    refs = df.select(F.lit("all").alias("g"), F.col("vec_id").alias("nid"), F.col("embedding").alias("nv"))
    tree, _ = NB.build_tree(refs, "euclidean", 1)
    held = tree.pack(1000)
    assert sum(held.values()) == 3000 and max(held.values()) <= 1000
    asked = df.select(F.lit("all").alias("g"), F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"),
                      F.lit(None).cast("double").alias("tau"))
    rows = NB.visits(asked, tree, 3, "euclidean", True)
    got = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("leaves")).alias("leaves")).collect()
    assert max(r["n"] for r in got) <= len(held) < 0.5 * max(r["leaves"] for r in got)
    found = NB.knn(df, df, 3, metric="euclidean", block_rows=40).orderBy("qid", "rank").collect()
    d = NB._distances(x, x)
    np.fill_diagonal(d, np.inf)
    assert [r["nid"] for r in found] == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_differences_are_taken_of_near_pairs_only(monkeypatch, scale):
    """A matrix product rules out the other pairs; distances, ties and their order are those of all differences."""
    import pandas as pd

    x = blobs(600, dims=5) * scale
    x[40:60] = x[40]
    x[70] = np.nextafter(x[71], np.inf)
    d = NB._distances(x, x)
    np.fill_diagonal(d, np.inf)
    monkeypatch.setattr(NB, "_distances", lambda *a: pytest.fail("differences of all pairs"))
    ids = np.arange(600)[::-1] * 7
    left = pd.DataFrame({"qid": ids, "qv": list(x), "leaves": [np.arange(3, dtype=np.int32)] * 600})
    right = pd.DataFrame({"leaf": (np.arange(600) % 3).astype(np.int32), "nid": ids, "nv": list(x)})
    for k in (1, 3, 700):
        got = NB._block_topk(left, right, k, "euclidean", True).groupby("qid")
        for q in range(0, 600, 7):
            want = np.lexsort((ids, d[q]))[:min(k, 599)]
            own = got.get_group(ids[q])
            assert own["nid"].tolist() == ids[want].tolist() and own["dist"].tolist() == d[q][want].tolist()
