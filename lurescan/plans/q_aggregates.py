"""Profile aggregates, top-k by time, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.functions import labels as L
from lurescan.plans.registry import register
from lurescan.sources import fixtures as FX
from lurescan.sources.tables import table


def label_distribution(spark, sf):
    return FX.m3(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


register("label_distribution", sql=FX.with_ctes(FX.SQL_M3)
         + "SELECT label, count(*) AS count FROM m3 GROUP BY label")(label_distribution)


def missing_counts(spark, sf):
    """Nulls per column of the raw labelled table (one aggregation pass)."""
    r = FX.raw_labels(spark, sf)
    return r.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}") for c in r.columns])


register("missing_counts", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_{c}"
                          for c in ("msg_id", "text", "email_label", "sms_label")) + " FROM raw"))(missing_counts)


def distinct_labels(spark, sf):
    r = FX.raw_labels(spark, sf)
    return r.select(L.lower_labels("sms_label").alias("label")).where(F.col("label").isNotNull()).distinct()


register("distinct_labels", sql=FX.with_ctes(FX.SQL_RAW_LABELS)
         + "SELECT DISTINCT lower(sms_label) AS label FROM raw WHERE sms_label IS NOT NULL")(distinct_labels)


def class_weights(spark, sf):
    """Balanced weights n / (k * n_c), and the fixed {0: 1, 1: 5} map for the merged labels."""
    m = FX.m3(spark, sf)
    c = m.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    st = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).first()  # one row
    bal = F.lit(float(st["total"])) / (F.lit(st["k"]) * F.col("n"))
    fixed = F.when(F.col("label") == 2, 5.0).otherwise(1.0)
    return c.select("label", F.col("n").cast("long").alias("n"), F.round(bal, 6).alias("weight_balanced"),
                    fixed.alias("weight_fixed"))


register("class_weights", sql=FX.with_ctes(FX.SQL_M3) + (
    "SELECT label, CAST(n AS BIGINT) AS n, round(CAST(total AS DOUBLE) / (k * n), 6) AS weight_balanced, "
    "CAST(CASE WHEN label = 2 THEN 5.0 ELSE 1.0 END AS DOUBLE) AS weight_fixed FROM (SELECT label, count(*) AS n FROM m3 GROUP BY label) c, "
    "(SELECT count(*) AS total FROM m3) t, (SELECT count(DISTINCT label) AS k FROM m3) kk"))(class_weights)


def latest_messages(spark, sf, n: int | None = 10):
    """Newest ``n`` events by time (ties by id): a distributed take-ordered, not a full sort; None: all events."""
    e = table(spark, sf, "events")
    top = e if n is None else e.orderBy(F.desc("ts"), F.asc("event_id")).limit(n)
    return top.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id",
                      "event_type")


register("latest_messages", sql=(
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type FROM events "
    "ORDER BY ts DESC, event_id LIMIT 10"))(latest_messages)
register("latest_messages_all", sql=(
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type FROM events"))(
    lambda spark, sf: latest_messages(spark, sf, None))


def union_sources(spark, sf):
    """SMS rows and e-mail rows stacked with their raw labels (duplicates kept, labels not harmonised)."""
    r = FX.raw_labels(spark, sf)
    sms = r.where(F.col("sms_label").isNotNull()).select("msg_id", F.lit("sms").alias("source"), "text",
                                                         F.col("sms_label").alias("label"))
    mail = r.where(F.col("email_label").isNotNull()).select("msg_id", F.lit("email").alias("source"), "text",
                                                            F.col("email_label").alias("label"))
    return sms.unionByName(mail)


register("union_sources", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    "SELECT msg_id, 'sms' AS source, text, sms_label AS label FROM raw WHERE sms_label IS NOT NULL "
    "UNION ALL SELECT msg_id, 'email', text, email_label FROM raw WHERE email_label IS NOT NULL"))(union_sources)
