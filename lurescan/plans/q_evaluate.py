"""Evaluation and threshold queries on the deterministic score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.operators import evaluate as EV
from lurescan.plans.registry import register
from lurescan.sources import fixtures as FX

R6 = 6
CLASS_NAMES = {0: "ham", 1: "spam", 2: "smishing"}


def _r(df):
    return df.select(*[F.round(F.col(c), R6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- SQL twins

def sql_per_class(src: str) -> str:
    return (f"pc0 AS (SELECT coalesce(s.cls, p.cls) AS cls, coalesce(s.support, 0) AS support, "
            f"coalesce(p.predicted, 0) AS predicted FROM "
            f"(SELECT label AS cls, count(*) AS support FROM {src} GROUP BY label) s FULL JOIN "
            f"(SELECT pred AS cls, count(*) AS predicted FROM {src} GROUP BY pred) p ON s.cls = p.cls), "
            f"pc AS (SELECT pc0.cls, CAST(coalesce(x.tp, 0) AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, "
            f"CAST(predicted AS BIGINT) AS predicted, "
            f"CASE WHEN predicted = 0 THEN 0.0 ELSE coalesce(x.tp, 0) / predicted END AS precision, "
            f"CASE WHEN support = 0 THEN 0.0 ELSE coalesce(x.tp, 0) / support END AS recall, "
            f"CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * coalesce(x.tp, 0) / (support + predicted) END AS f1 "
            f"FROM pc0 LEFT JOIN (SELECT label AS cls, count(*) AS tp FROM {src} WHERE label = pred GROUP BY label) x "
            f"ON pc0.cls = x.cls)")


SQL_REPORT_ROWS = (
    "rep AS (SELECT CAST(cls AS VARCHAR) AS row, precision, recall, f1, support FROM pc "
    "UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / sum(support), sum(support) FROM pc "
    "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), sum(support) FROM pc)")


def _m3p(spark, sf):
    return FX.m3_predictions(spark, sf)


def accuracy(spark, sf):
    return _r(EV.accuracy(_m3p(spark, sf)))


register("accuracy", sql=FX.with_ctes(FX.SQL_M3, FX.SQL_M3_PRED)
         + "SELECT round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy FROM mp")(accuracy)


def prf_binary(spark, sf):
    """P/R/F1 for positive 1 and for positive 0 on the binary score table."""
    c = EV.pair_counts(FX.score_table(spark, sf))
    return _r(EV.prf_for(c, 1).unionByName(EV.prf_for(c, 0)))


register("prf_binary", sql=FX.with_ctes(FX.SQL_M2, FX.SQL_SCORES, sql_per_class("s"))
         + "SELECT cls AS positive, round(precision, 6) AS precision, round(recall, 6) AS recall, "
           "round(f1, 6) AS f1, support FROM pc WHERE cls IN (0, 1)")(prf_binary)


def prf_one_class(spark, sf):
    """P/R/F1 of class 2 of 3."""
    return _r(EV.prf_for(EV.pair_counts(_m3p(spark, sf)), 2))


register("prf_one_class", sql=FX.with_ctes(FX.SQL_M3, FX.SQL_M3_PRED, sql_per_class("mp"))
         + "SELECT cls AS positive, round(precision, 6) AS precision, round(recall, 6) AS recall, "
           "round(f1, 6) AS f1, support FROM pc WHERE cls = 2")(prf_one_class)


def classification_report(spark, sf):
    return _r(EV.report(EV.pair_counts(_m3p(spark, sf))))


SQL_REPORT = FX.with_ctes(FX.SQL_M3, FX.SQL_M3_PRED, sql_per_class("mp"), SQL_REPORT_ROWS)
register("classification_report", sql=SQL_REPORT + (
    "SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM rep"))(classification_report)


def prf_weighted(spark, sf):
    return classification_report(spark, sf).where(F.col("row") == "weighted avg")


register("prf_weighted", sql=SQL_REPORT + (
    "SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM rep WHERE row = 'weighted avg'"))(prf_weighted)


def f1_macro(spark, sf):
    r = EV.report(EV.pair_counts(_m3p(spark, sf)))
    return _r(r.where(F.col("row") == "macro avg").select(F.col("f1").alias("f1_macro")))


register("f1_macro", sql=SQL_REPORT + "SELECT round(f1, 6) AS f1_macro FROM rep WHERE row = 'macro avg'")(f1_macro)


def label_names(spark, sf):
    """The report with class ids shown as names."""
    names = F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in (str(kv[0]), kv[1])])
    r = classification_report(spark, sf)
    return r.select(F.coalesce(F.try_element_at(names, F.col("row")), F.col("row")).alias("row"),
                    "precision", "recall", "f1", "support")


register("label_names", sql=SQL_REPORT + (
    "SELECT CASE row WHEN '0' THEN 'ham' WHEN '1' THEN 'spam' WHEN '2' THEN 'smishing' ELSE row END AS row, "
    "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM rep"))(label_names)


def confusion_matrix(spark, sf):
    return EV.confusion_matrix(_m3p(spark, sf), [0, 1, 2])


register("confusion_matrix", sql=FX.with_ctes(FX.SQL_M3, FX.SQL_M3_PRED) + (
    "SELECT label AS actual, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE pred = {c}) AS BIGINT) AS pred_{c}" for c in (0, 1, 2))
    + " FROM mp GROUP BY label"))(confusion_matrix)


def log_loss(spark, sf):
    return _r(EV.log_loss(FX.score_table(spark, sf)))


register("log_loss", sql=FX.with_ctes(FX.SQL_M2, FX.SQL_SCORES) + (
    "SELECT round(avg(-(label * ln(q) + (1.0 - label) * ln(1.0 - q))), 6) AS log_loss FROM ("
    "SELECT label, least(greatest(p, 1e-7), 1.0 - 1e-7) AS q FROM s) x"))(log_loss)


def threshold_fixed(spark, sf):
    """p >= 0.4, p >= 0.5, p > 0.5 and round half to even, per message."""
    s = FX.score_table(spark, sf)
    p = F.col("p")
    return s.select("msg_id", (p >= 0.4).cast("int").alias("ge_040"), (p >= 0.5).cast("int").alias("ge_050"),
                    (p > 0.5).cast("int").alias("gt_050"), F.bround(p, 0).cast("int").alias("rounded"))


register("threshold_fixed", sql=FX.with_ctes(FX.SQL_M2, FX.SQL_SCORES) + (
    "SELECT msg_id, CAST(p >= 0.4 AS INTEGER) AS ge_040, CAST(p >= 0.5 AS INTEGER) AS ge_050, "
    "CAST(p > 0.5 AS INTEGER) AS gt_050, CAST(round_even(p, 0) AS INTEGER) AS rounded FROM s"))(threshold_fixed)


def threshold_sweep(spark, sf):
    out = EV.threshold_sweep(FX.score_table(spark, sf))
    return _r(out.select(F.col("i").cast("long").alias("i"), "threshold", "tp", "fp", "fn", "f1", "is_best"))


_TS = EV.thresholds()
SQL_THRESHOLDS = "th AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(_TS)) + ") v(i, threshold))"
register("threshold_sweep", sql=FX.with_ctes(FX.SQL_M2, FX.SQL_SCORES, SQL_THRESHOLDS) + (
    "SELECT CAST(i AS BIGINT) AS i, round(threshold, 6) AS threshold, tp, fp, fn, round(f1, 6) AS f1, "
    "row_number() OVER (ORDER BY f1 DESC, i) = 1 AS is_best FROM ("
    "SELECT i, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P - tp AS BIGINT) AS fn, "
    "CASE WHEN 2 * tp + fp + (P - tp) = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + (P - tp)) END AS f1 FROM ("
    "SELECT th.i, th.threshold, count(*) FILTER (WHERE s.p >= th.threshold AND s.label = 1) AS tp, "
    "count(*) FILTER (WHERE s.p >= th.threshold AND s.label = 0) AS fp, "
    "(SELECT count(*) FROM s WHERE label = 1) AS P FROM th, s GROUP BY th.i, th.threshold) a) b"))(threshold_sweep)


def _class_scores(spark, sf):
    """Three-class score vectors with quarter steps, so ties occur."""
    m = FX.m3(spark, sf)
    sc = F.array(*[F.floor(FX.hash_fraction(F.lit(f"c{k}"), F.col("msg_id")) * 4) / 4 for k in range(3)])
    return m.select("msg_id", "label", sc.alias("scores"))


def argmax_class(spark, sf):
    s = _class_scores(spark, sf)
    return s.select("msg_id", EV.argmax_class(F.col("scores")).alias("pred"))


register("argmax_class", sql=FX.with_ctes(FX.SQL_M3) + (
    "SELECT msg_id, CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS pred FROM (SELECT msg_id, ["
    + ", ".join(f"floor({FX.sql_hash_fraction(repr(f'c{k}'), 'CAST(msg_id AS VARCHAR)')} * 4) / 4" for k in range(3))
    + "] AS sc FROM m3) q"))(argmax_class)
