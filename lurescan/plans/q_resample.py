"""Oversampling, SMOTE, Tomek links, ENN and their combinations on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.operators import resample as RS
from lurescan.plans.q_neighbors import SQL_E
from lurescan.plans.registry import register
from lurescan.sources import fixtures as FX


def _v(spark, sf):
    return FX.embeddings(spark, sf)


def _h48(s):
    return FX.sql_hash48(s)


SQL_COUNTS = ("cnt AS (SELECT label, count(*) AS n FROM e GROUP BY label)",
              "mx AS (SELECT max(n) AS m FROM cnt)",
              "rk AS (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e)")


def oversample_random(spark, sf):
    """Every class drawn up to the largest one, with replacement; originals have copy 0."""
    return RS.oversample_random(_v(spark, sf).select("vec_id", "label"), "vec_id", "label", 42)


register("oversample_random", sql=FX.with_ctes(
    SQL_E, *SQL_COUNTS,
    "dr AS (SELECT c.label, t.i, " + _h48("'42|' || CAST(c.label AS VARCHAR) || '|' || CAST(t.i AS VARCHAR)")
    + " % c.n + 1 AS r FROM cnt c CROSS JOIN mx, LATERAL (SELECT unnest(range(1, mx.m - c.n + 1)) AS i) t)") + (
    "SELECT vec_id, label, CAST(0 AS BIGINT) AS copy FROM e UNION ALL "
    "SELECT rk.vec_id, rk.label, dr.i FROM dr JOIN rk ON dr.label = rk.label AND dr.r = rk.r"))(oversample_random)


def _smote(spark, sf):
    return RS.smote(_v(spark, sf), "vec_id", "embedding", "label", k=5, seed=42)


def _vec_stats(c):
    s1 = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.round(s1, 6).alias("s1"), F.round(s2, 6).alias("s2")


def smote(spark, sf):
    """Synthetic rows: id, class, base row, neighbour, draw u and two checksums of the vector."""
    s = _smote(spark, sf)
    return s.select("vec_id", "label", "base_id", "nbr_id", F.round("u", 6).alias("u"), *_vec_stats(F.col("embedding")))


def _kdesc(label, i, tag):
    return ("'42|' || CAST(" + label + " AS VARCHAR) || '|' || CAST(" + i + " AS VARCHAR) || '|" + tag + "'")


SQL_SMOTE = (
    *SQL_COUNTS,
    "nn AS (SELECT qid, nid, j FROM (SELECT a.vec_id AS qid, b.vec_id AS nid, row_number() OVER ("
    "PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS j FROM e a JOIN e b "
    "ON a.label = b.label AND a.vec_id <> b.vec_id) x WHERE j <= 5)",
    "dr AS (SELECT c.label, t.i, " + _h48(_kdesc("c.label", "t.i", "b")) + " % c.n + 1 AS r, "
    + _h48(_kdesc("c.label", "t.i", "n")) + " % least(5, c.n - 1) + 1 AS j, "
    "(" + _h48(_kdesc("c.label", "t.i", "u")) + " / 281474976710656.0) AS u "
    "FROM cnt c CROSS JOIN mx, LATERAL (SELECT unnest(range(1, mx.m - c.n + 1)) AS i) t)",
    "syn AS (SELECT -((dr.label + 1) * 4294967296 + dr.i) AS vec_id, dr.label, rk.vec_id AS base_id, "
    "nn.nid AS nbr_id, dr.u, list_transform(range(1, len(rk.v) + 1), lambda x: rk.v[x] + dr.u * (nb.v[x] - rk.v[x])) AS v "
    "FROM dr JOIN rk ON dr.label = rk.label AND dr.r = rk.r JOIN nn ON nn.qid = rk.vec_id AND nn.j = dr.j "
    "JOIN e nb ON nb.vec_id = nn.nid)",
    "un AS (SELECT vec_id, label, v FROM e UNION ALL SELECT vec_id, label, v FROM syn)",
)
register("smote", sql=FX.with_ctes(SQL_E, *SQL_SMOTE) + (
    "SELECT vec_id, label, base_id, nbr_id, round(u, 6) AS u, round(list_sum(v), 6) AS s1, "
    "round(list_sum(list_transform(range(1, len(v) + 1), lambda x: v[x] * x)), 6) AS s2 FROM syn"))(smote)


def sql_tomek(src):
    return (f"n1 AS (SELECT qid, nid FROM (SELECT a.vec_id AS qid, b.vec_id AS nid, row_number() OVER ("
            f"PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS j FROM {src} a JOIN {src} b "
            f"ON a.vec_id <> b.vec_id) x WHERE j = 1)",
            f"links AS (SELECT x.qid FROM n1 x JOIN n1 y ON x.qid = y.nid AND x.nid = y.qid "
            f"JOIN {src} qa ON qa.vec_id = x.qid JOIN {src} qb ON qb.vec_id = x.nid WHERE qa.label <> qb.label)")


def sql_enn(src, k=3):
    return (f"n3 AS (SELECT qid, nid FROM (SELECT a.vec_id AS qid, b.vec_id AS nid, row_number() OVER ("
            f"PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS j FROM {src} a JOIN {src} b "
            f"ON a.vec_id <> b.vec_id) x WHERE j <= {k})",
            f"keep AS (SELECT n3.qid FROM n3 JOIN {src} q ON q.vec_id = n3.qid JOIN {src} nb ON nb.vec_id = n3.nid "
            f"GROUP BY n3.qid HAVING min(CAST(q.label = nb.label AS INTEGER)) = 1)")


def tomek_links(spark, sf):
    """Rows left after removing both ends of every Tomek link."""
    v = _v(spark, sf)
    return RS.tomek_links(v, "vec_id", "embedding", "label").select("vec_id", "label")


register("tomek_links", sql=FX.with_ctes(SQL_E, *sql_tomek("e"))
         + "SELECT vec_id, label FROM e WHERE vec_id NOT IN (SELECT qid FROM links)")(tomek_links)


def edited_nn(spark, sf):
    """Rows whose 3 nearest neighbours all share their class."""
    v = _v(spark, sf)
    return RS.edited_nn(v, "vec_id", "embedding", "label", k=3).select("vec_id", "label")


register("edited_nn", sql=FX.with_ctes(SQL_E, *sql_enn("e"))
         + "SELECT vec_id, label FROM e WHERE vec_id IN (SELECT qid FROM keep)")(edited_nn)


def _union(spark, sf):
    v = _v(spark, sf)
    return RS.with_synthetic(v, _smote(spark, sf), "vec_id", "embedding", "label")


def smote_tomek(spark, sf):
    return RS.tomek_links(_union(spark, sf), "vec_id", "embedding", "label").select("vec_id", "label")


register("smote_tomek", sql=FX.with_ctes(SQL_E, *SQL_SMOTE, *sql_tomek("un"))
         + "SELECT vec_id, label FROM un WHERE vec_id NOT IN (SELECT qid FROM links)")(smote_tomek)


def smote_enn(spark, sf):
    return RS.edited_nn(_union(spark, sf), "vec_id", "embedding", "label", k=3).select("vec_id", "label")


register("smote_enn", sql=FX.with_ctes(SQL_E, *SQL_SMOTE, *sql_enn("un"))
         + "SELECT vec_id, label FROM un WHERE vec_id IN (SELECT qid FROM keep)")(smote_enn)
