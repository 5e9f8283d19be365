"""Message tables built from the given test data (FIXTURES.md section 2).

Every builder reads the given tables, so its work grows with them.  Each has
a DuckDB twin (``SQL_*``) used by the oracle queries as a CTE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.sources.tables import table

TWO_48 = float(2 ** 48)


def hash_fraction(*parts) -> Column:
    """Deterministic value in [0, 1) from md5 of the '|'-joined parts.

    The first 48 bits of the md5 digest, divided by 2^48; DuckDB gives the
    same value with ``('0x'||substr(md5(s),1,12))::BIGINT / 2^48``.
    """
    s = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return hash48(s) / F.lit(TWO_48)


def hash48(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s), 1, 12), 16, 10).cast("long")


def sql_hash_fraction(*parts: str) -> str:
    s = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({s}), 1, 12))::BIGINT / 281474976710656.0)"


def sql_hash48(s: str) -> str:
    return f"(('0x' || substr(md5({s}), 1, 12))::BIGINT)"


# ---------------------------------------------------------------- M2 / M3

def m2(spark: SparkSession, sf: str) -> DataFrame:
    """Binary e-mail stand-in: label 1 = bad (quality 0)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("msg_id"), "text",
                    (F.lit(1) - F.col("quality")).cast("int").alias("label")))


SQL_M2 = """m2 AS (SELECT d.doc_id AS msg_id, d.text, CAST(1 - l.quality AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def m3(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class SMS stand-in: toxic -> 2 (smishing), else quality 0 -> 1 (spam), else 0."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    label = (F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)).cast("int")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("msg_id"), "text", label.alias("label"))


SQL_M3 = """m3 AS (SELECT d.doc_id AS msg_id, d.text,
    CAST(CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with raw label strings as the scripts read them.

    Unlabelled documents keep null labels; the SMS names come in three
    letter cases so the case rules are exercised.
    """
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    email = (F.when(F.col("quality") == 0, "Phishing Email")
             .when(F.col("quality") == 1, "Safe Email"))
    name = (F.when(F.col("toxic") == 1, "smishing")
            .when(F.col("quality") == 0, "spam")
            .when(F.col("quality") == 1, "ham"))
    variant = F.pmod(F.col("doc_id"), F.lit(3))
    sms = (F.when(variant == 0, name)
           .when(variant == 1, F.initcap(name))
           .otherwise(F.upper(name)))
    return j.select(F.col("doc_id").alias("msg_id"), "text",
                    email.alias("email_label"), sms.alias("sms_label"))


SQL_RAW_LABELS = """raw AS (SELECT d.doc_id AS msg_id, d.text,
    CASE WHEN l.quality = 0 THEN 'Phishing Email' WHEN l.quality = 1 THEN 'Safe Email' END AS email_label,
    CASE (d.doc_id % 3)
      WHEN 0 THEN nm
      WHEN 1 THEN upper(substr(nm, 1, 1)) || substr(nm, 2)
      ELSE upper(nm) END AS sms_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id,
  LATERAL (SELECT CASE WHEN l.toxic = 1 THEN 'smishing' WHEN l.quality = 0 THEN 'spam'
                       WHEN l.quality = 1 THEN 'ham' END AS nm) x)"""


# ---------------------------------------------------------------- mail rows

def mail_table(spark: SparkSession, sf: str) -> DataFrame:
    """Five-column e-mail table (sender, receiver, date, subject, body) from documents."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3607)
    return d.select(
        F.col("doc_id").alias("msg_id"),
        F.concat(F.lit('"'), F.upper(F.col("source")), F.lit(' Desk" <'), F.col("source"),
                 F.lit("."), F.col("lang"), F.lit("@mail-"), F.col("lang"),
                 F.lit(".example.org>")).alias("sender"),
        F.concat(F.lit("team-"), F.col("lang"), F.lit("@example.com")).alias("receiver"),
        F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("date"),
        F.substring_index(F.col("text"), "\n", 1).alias("subject"),
        F.col("text").alias("body"),
    )


SQL_MAIL = """mail AS (SELECT doc_id AS msg_id,
    '"' || upper(source) || ' Desk" <' || source || '.' || lang || '@mail-' || lang || '.example.org>' AS sender,
    'team-' || lang || '@example.com' AS receiver,
    strftime(make_timestamp((1704067200 + doc_id * 3607) * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS date,
    split_part(text, chr(10), 1) AS subject,
    text AS body
  FROM documents)"""


# ---------------------------------------------------------------- DT: date texts

# (Spark pattern, DuckDB pattern, text behind) of each rendering; %-d and d have no leading zero
DATE_RENDERINGS = (
    ("EEE, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", " -0700"),
    ("yyyy-MM-dd", "%Y-%m-%d", ""),
    ("dd MMM yyyy", "%d %b %Y", ""),
    ("MMMM d, yyyy", "%B %-d, %Y", ""),
    ("MM/dd/yyyy", "%m/%d/%Y", ""),
    ("EEE, d MMM yyyy HH:mm:ss", "%a, %-d %b %Y %H:%M:%S", " -0700 (PDT)"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "Z"),
    ("d MMM yyyy", "%-d %b %Y", ""),
    ("M/d/yyyy", "%-m/%-d/%Y", ""),
    ("MMM d, yyyy", "%b %-d, %Y", ""),
    ("EEE MMM d HH:mm:ss yyyy", "%a %b %-d %H:%M:%S %Y", ""),
    ("EEE, d MMM yyyy HH:mm:ss", "%a, %-d %b %Y %H:%M:%S", " GMT"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", ".250+02:00"),
    ("yyyy/MM/dd", "%Y/%m/%d", ""),
    ("dd-MMM-yyyy", "%d-%b-%Y", ""),
    ("yyyyMMdd", "%Y%m%d", ""),
    ("MM/dd/yy", "%m/%d/%y", ""),
    ("HH:mm d MMM yyyy", "%H:%M %-d %b %Y", ""),
    ("EEEE, d MMMM yyyy", "%A, %-d %B %Y", " 5pm EDT"),
)


def date_texts(spark: SparkSession, sf: str) -> DataFrame:
    """orders.o_orderdate rendered in several text forms (status P rows are junk)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    k, d = F.pmod(F.col("o_orderkey"), F.lit(len(DATE_RENDERINGS))), F.col("o_orderdate")
    txt = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("n/a #"), F.col("o_orderkey").cast("string")))
    for i, (form, _, tail) in enumerate(DATE_RENDERINGS):
        txt = txt.when(k == i, F.concat(F.date_format(d, form), F.lit(tail)))
    return o.select(F.col("o_orderkey").alias("msg_id"), txt.alias("date"))


SQL_DATE_TEXTS = ("dt AS (SELECT o_orderkey AS msg_id, CASE WHEN o_orderstatus = 'P' THEN 'n/a #' || CAST(o_orderkey AS VARCHAR) "
                  + " ".join(f"WHEN o_orderkey % {len(DATE_RENDERINGS)} = {i} THEN strftime(o_orderdate, '{form}') || '{tail}'"
                             for i, (_, form, tail) in enumerate(DATE_RENDERINGS)) + " END AS date FROM orders)")


# ---------------------------------------------------------------- S: score table

def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """M2 plus a deterministic probability mixed with the label, and pred = p >= 0.5."""
    m = m2(spark, sf)
    p = F.lit(0.35) * F.col("label") + F.lit(0.65) * hash_fraction(F.lit("s"), F.col("msg_id"))
    return (m.select("msg_id", "label", p.alias("p"))
            .withColumn("pred", (F.col("p") >= 0.5).cast("int")))


SQL_SCORES = """s AS (SELECT msg_id, label, p, CAST(p >= 0.5 AS INTEGER) AS pred FROM (
    SELECT msg_id, label,
      0.35 * label + 0.65 * (('0x' || substr(md5('s|' || CAST(msg_id AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0) AS p
    FROM m2) q)"""


def m3_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """M3 with a hash-made prediction (right two times in three)."""
    m = m3(spark, sf)
    h = hash_fraction(F.lit("p"), F.col("msg_id"))
    pred = (F.when(h < 2.0 / 3.0, F.col("label"))
            .otherwise(F.pmod(F.col("label") + F.floor(h * 6).cast("int"), F.lit(3)))).cast("int")
    return m.select("msg_id", "label", pred.alias("pred"))


SQL_M3_PRED = """mp AS (SELECT msg_id, label, CAST(CASE WHEN h < 2.0 / 3.0 THEN label
      ELSE (label + CAST(floor(h * 6) AS INTEGER)) % 3 END AS INTEGER) AS pred
  FROM (SELECT msg_id, label,
      (('0x' || substr(md5('p|' || CAST(msg_id AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0) AS h FROM m3) q)"""


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
