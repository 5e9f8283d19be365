"""Nearest neighbours and the kNN classifier on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.operators import splits as SP
from lurescan.operators.neighbors import knn
from lurescan.operators.resample import knn_vote
from lurescan.plans.q_splits import h48_sql
from lurescan.plans.registry import register
from lurescan.sources import fixtures as FX

SQL_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
COS = "1.0 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"


def knn_neighbours(spark, sf):
    """The 5 nearest embeddings of every embedding by cosine distance (itself excluded)."""
    v = FX.embeddings(spark, sf)
    nn = knn(v, v, 5, id_col="vec_id", vec_col="embedding", metric="cosine")
    return nn.select("qid", "nid", "rank", F.round("dist", 6).alias("dist"))


register("knn_neighbours", bench=True, sql=FX.with_ctes(SQL_E) + (
    "SELECT qid, nid, rank, round(dist, 6) AS dist FROM (SELECT qid, nid, dist, "
    "row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM ("
    f"SELECT a.vec_id AS qid, b.vec_id AS nid, {COS} AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id) p) q "
    "WHERE rank <= 5"))(knn_neighbours)


def _v_split(spark, sf):
    return SP.split_random(FX.embeddings(spark, sf), "vec_id", 0.25, 42)


SQL_VSPLIT = ("vs AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY " + h48_sql(42, "vec_id")
              + ", vec_id) <= (SELECT ceil(count(*) * 0.25) FROM e) AS is_test FROM e)")


def model_knn(spark, sf):
    """k=5 cosine kNN classifier: uniform vote and 1/distance vote for the held-out quarter."""
    sp = _v_split(spark, sf)
    train = sp.where(F.col("is_test") == 0)
    test = sp.where(F.col("is_test") == 1)
    votes = knn_vote(test, train, 5, weights=("uniform", "distance"))
    return test.select("vec_id", "label").join(votes, "vec_id")


register("model_knn", sql=FX.with_ctes(
    SQL_E, SQL_VSPLIT,
    "nn AS (SELECT qid, nl, dist FROM (SELECT a.vec_id AS qid, b.label AS nl, " + COS + " AS dist, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY " + COS + ", b.vec_id) AS rk "
    "FROM vs a JOIN vs b ON a.is_test AND NOT b.is_test) p WHERE rk <= 5)",
    "wz AS (SELECT qid, nl, dist, min(dist) OVER (PARTITION BY qid) = 0 AS z FROM nn)",
    "vu AS (SELECT qid, nl, count(*) AS s FROM nn GROUP BY qid, nl)",
    "vd AS (SELECT qid, nl, sum(CASE WHEN z THEN CAST(dist = 0 AS DOUBLE) ELSE 1.0 / dist END) AS s FROM wz "
    "GROUP BY qid, nl)",
    "pu AS (SELECT qid, nl FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, nl) AS r FROM vu) x "
    "WHERE r = 1)",
    "pd AS (SELECT qid, nl FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, nl) AS r FROM vd) x "
    "WHERE r = 1)") + (
    "SELECT vs.vec_id, vs.label, CAST(pu.nl AS INTEGER) AS pred_uniform, CAST(pd.nl AS INTEGER) AS pred_distance "
    "FROM vs JOIN pu ON vs.vec_id = pu.qid JOIN pd ON vs.vec_id = pd.qid WHERE vs.is_test"))(model_knn)
