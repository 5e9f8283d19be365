"""Chunked scoring and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.functions.lexicon import VERDICT_NORMAL, VERDICT_PHISHING
from lurescan.operators import scoring as SC
from lurescan.plans import sqlfrag as S
from lurescan.plans.registry import register
from lurescan.sources.tables import table

SQL_CHUNK_SCORES = (
    "WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), "
    "ch AS (SELECT doc_id, array_to_string(w[i * 512 + 1:(i + 1) * 512], ' ') AS c FROM t, "
    "LATERAL (SELECT unnest(range(0, CAST(ceil(len(w) / 512) AS BIGINT))) AS i) r), "
    "sc AS (SELECT doc_id, CASE WHEN " + S.has_phone("c") + " = 1 THEN 2 WHEN " + S.has_email("c")
    + " = 1 OR contains(c, '!!!') THEN 1 ELSE 0 END AS cls FROM ch), "
    "agg AS (SELECT doc_id, max(CAST(cls > 0 AS INTEGER)) AS prediction, count(*) AS n_chunks FROM sc GROUP BY doc_id), "
    "res AS (SELECT d.doc_id, coalesce(a.prediction, 0) AS prediction, CAST(coalesce(a.n_chunks, 0) AS BIGINT) AS n_chunks "
    "FROM documents d LEFT JOIN agg a ON d.doc_id = a.doc_id) ")


def score_chunks_any(spark, sf):
    """512-token chunks, a class per chunk from the rule scorer, flagged when any chunk is non-zero."""
    return SC.score_chunks_any(table(spark, sf, "documents"), "doc_id", "text")


register("score_chunks_any", bench=True, sql=SQL_CHUNK_SCORES + "SELECT doc_id, prediction, n_chunks FROM res")(
    score_chunks_any)


def verdict_text(spark, sf):
    d = table(spark, sf, "documents")
    s = SC.score_chunks_any(d, "doc_id", "text", keep=["text"])  # scored in the row: no join back
    return s.select("doc_id", "prediction", SC.verdict_text(F.col("prediction"), F.col("text")).alias("verdict"))


register("verdict_text", sql=SQL_CHUNK_SCORES + (
    f"SELECT r.doc_id, r.prediction, CASE WHEN r.prediction = 1 THEN {S.q(VERDICT_PHISHING)} ELSE {S.q(VERDICT_NORMAL)} "
    "END || d.text AS verdict FROM res r JOIN documents d ON r.doc_id = d.doc_id"))(verdict_text)
