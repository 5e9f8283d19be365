"""Splits, folds, shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.operators import splits as SP
from lurescan.plans.registry import register
from lurescan.sources import fixtures as FX


def h48_sql(seed, col="msg_id"):
    return FX.sql_hash48(f"'{seed}|' || CAST({col} AS VARCHAR)")


def shuffle_rows(spark, sf):
    return SP.shuffle_rows(FX.m2(spark, sf).select("msg_id", "label"), "msg_id", seed=42)


register("shuffle_rows", sql=FX.with_ctes(FX.SQL_M2) + (
    f"SELECT msg_id, label, row_number() OVER (ORDER BY {h48_sql(42)}, msg_id) AS position FROM m2"))(shuffle_rows)


def split_random(spark, sf):
    return SP.split_random(FX.m2(spark, sf).select("msg_id", "label"), "msg_id", 0.2, 42)


register("split_random", sql=FX.with_ctes(FX.SQL_M2) + (
    f"SELECT msg_id, label, CAST(row_number() OVER (ORDER BY {h48_sql(42)}, msg_id) <= "
    f"(SELECT ceil(count(*) * 0.2) FROM m2) AS INTEGER) AS is_test FROM m2"))(split_random)


def sql_quotas(src: str, test_size: float) -> str:
    return (f"qc AS (SELECT label, count(*) AS n FROM {src} GROUP BY label), "
            f"qt AS (SELECT sum(n) AS total, CAST(ceil(CAST(sum(n) AS DOUBLE) * {test_size}) AS BIGINT) AS n_test FROM qc), "
            f"q0 AS (SELECT label, n, CAST(n * (total - n_test) AS DOUBLE) / CAST(total AS DOUBLE) AS cont, "
            f"total - n_test AS ntrain FROM qc, qt), "
            f"q1 AS (SELECT label, n, floor(cont) AS fl, cont - floor(cont) AS rem, "
            f"ntrain - sum(floor(cont)) OVER () AS need FROM q0), "
            f"quota AS (SELECT label, CAST(n AS BIGINT) AS n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= need "
            f"THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM q1)")


def class_quotas(spark, sf):
    return SP.class_quotas(FX.m3(spark, sf), "label", 0.25)


register("class_quotas", sql=FX.with_ctes(FX.SQL_M3, sql_quotas("m3", 0.25)) + (
    "SELECT label, n, n_train, n - n_train AS n_test FROM quota"))(class_quotas)


def split_stratified(spark, sf):
    return SP.split_stratified(FX.m3(spark, sf).select("msg_id", "label"), "msg_id", "label", 0.25, 42)


register("split_stratified", sql=FX.with_ctes(FX.SQL_M3, sql_quotas("m3", 0.25)) + (
    f"SELECT m.msg_id, m.label, CAST(row_number() OVER (PARTITION BY m.label ORDER BY {h48_sql(42, 'm.msg_id')}, m.msg_id) "
    f"<= q.n - q.n_train AS INTEGER) AS is_test FROM m3 m JOIN quota q ON m.label = q.label"))(split_stratified)


def kfold_stratified(spark, sf):
    return SP.kfold_stratified(FX.m3(spark, sf).select("msg_id", "label"), "msg_id", "label", k=4, seed=42)


register("kfold_stratified", sql=FX.with_ctes(FX.SQL_M3) + (
    f"SELECT msg_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {h48_sql(42)}, msg_id) - 1) % 4 "
    f"AS INTEGER) AS fold FROM m3"))(kfold_stratified)


def kfold_unshuffled(spark, sf):
    return SP.kfold_stratified(FX.m3(spark, sf).select("msg_id", "label"), "msg_id", "label", k=5, seed=None)


register("kfold_unshuffled", sql=FX.with_ctes(FX.SQL_M3) + (
    "SELECT msg_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY msg_id) - 1) % 5 AS INTEGER) AS fold "
    "FROM m3"))(kfold_unshuffled)


def validation_split(spark, sf):
    return SP.validation_split(FX.m2(spark, sf).select("msg_id", "label"), "msg_id", 0.1, 42)


register("validation_split", sql=FX.with_ctes(FX.SQL_M2) + (
    f"SELECT msg_id, label, CAST(row_number() OVER (ORDER BY {h48_sql(42)}, msg_id) > "
    f"(SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM m2) AS INTEGER) AS is_val FROM m2"))(validation_split)
