"""Sources and sinks: write to a fresh folder under the shared
checkpoint folder, read back with an explicit schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.operators import textops
from lurescan.operators import vectorize as V
from lurescan.operators.embeddings import word_vectors
from lurescan.plans import sqlfrag as S
from lurescan.plans.q_clean import SQL_CLEAN_MAIL
from lurescan.plans.registry import register
from lurescan.session import scratch_dir
from lurescan.sources import fixtures as FX
from lurescan.sources import io
from lurescan.sources.tables import table


def src_csv(spark, sf):
    """The labelled message table through a header CSV with quoted multi-line text."""
    path = io.write_csv(FX.m2(spark, sf), scratch_dir(spark, "m2-csv"))
    return io.read_csv(spark, path, "msg_id long, text string, label int")


register("src_csv", sql=FX.with_ctes(FX.SQL_M2) + "SELECT msg_id, text, label FROM m2")(src_csv)


def src_email_table(spark, sf):
    """Five-column e-mail table read from CSV with its explicit schema."""
    path = io.write_csv(FX.mail_table(spark, sf), scratch_dir(spark, "mail-csv"))
    return io.read_csv(spark, path, io.EMAIL_TABLE_SCHEMA)


register("src_email_table", sql=FX.with_ctes(FX.SQL_MAIL)
         + "SELECT msg_id, sender, receiver, date, subject, body FROM mail")(src_email_table)


def sink_csv(spark, sf):
    """Cleaned SMS table written with a header and no index, then read back."""
    c = table(spark, sf, "conversations")
    out = c.select("conv_id", "turn", T.clean_sms("text").alias("text"))
    path = io.write_csv(out, scratch_dir(spark, "sms-csv"))
    return io.read_csv(spark, path, "conv_id long, turn long, text string")


register("sink_csv", sql=f"SELECT conv_id, turn, {S.clean_sms('text')} AS text FROM conversations")(sink_csv)


def sink_bodies(spark, sf):
    """One-column ``body`` CSV of cleaned page bodies."""
    p = table(spark, sf, "pages")
    path = io.write_csv(p.select(T.clean_html("html").alias("body")), scratch_dir(spark, "bodies-csv"))
    return io.read_csv(spark, path, "body string")


register("sink_bodies", sql=f"SELECT {S.clean_html('html')} AS body FROM pages")(sink_bodies)


def sink_clean_email(spark, sf):
    """Cleaned e-mail table written to Parquet and read back."""
    path = io.write_parquet(textops.clean_email_table(FX.mail_table(spark, sf)), scratch_dir(spark, "mail-pq"))
    return spark.read.parquet(path)


register("sink_clean_email", sql=FX.with_ctes(FX.SQL_MAIL) + SQL_CLEAN_MAIL)(sink_clean_email)


def src_word_vectors(spark, sf):
    """Word vectors written as space-separated text and parsed back (term, dims, sum)."""
    c = table(spark, sf, "conversations")
    idx = V.word_index(c, V.keras_tokens("text"), num_words=None, oov=False)
    path = io.write_word_vectors(word_vectors(spark, sf, idx.select("term")), scratch_dir(spark, "vectors-txt"))
    wv = io.read_word_vectors(spark, path)
    return wv.select("term", F.size("vec").cast("long").alias("dims"),
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"))


def _sql_word_vectors():
    from lurescan.plans.q_vectors import SQL_KERAS_COUNTS
    return FX.with_ctes(
        SQL_KERAS_COUNTS,
        "wi AS (SELECT term FROM kc)",
        "ne AS (SELECT count(*) AS n FROM embeddings)") + (
        "SELECT wi.term, CAST(len(e.embedding) AS BIGINT) AS dims, round(list_sum(list_transform(e.embedding, "
        "lambda x: CAST(x AS DOUBLE))), 6) AS vec_sum FROM wi CROSS JOIN ne JOIN embeddings e ON e.vec_id = "
        + FX.sql_hash48("'v|' || wi.term") + " % ne.n WHERE " + FX.sql_hash_fraction("'w'", "wi.term") + " < 0.75")


register("src_word_vectors", sql=_sql_word_vectors())(src_word_vectors)


def profile_head(spark, sf):
    """First five rows by id (a top-k: take-ordered, no full sort)."""
    d = table(spark, sf, "documents")
    return d.orderBy("doc_id").limit(5).select("doc_id", "lang", "source", "n_chars")


register("profile_head", sql="SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")(
    profile_head)
