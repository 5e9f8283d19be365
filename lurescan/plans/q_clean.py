"""Cleaning projections, label rules and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.functions import labels as L
from lurescan.functions import text as T
from lurescan.operators import textops
from lurescan.plans import sqlfrag as S
from lurescan.plans.registry import register
from lurescan.sources import fixtures as FX
from lurescan.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


# ---------------------------------------------------------------- text cleaners

def _text_query(key, source, id_col, col, fn, sqlfn, out="text"):
    def q(spark, sf):
        ids = [c.strip() for c in id_col.split(",")]
        return table(spark, sf, source).select(*ids, fn(F.col(col)).alias(out))
    q.__name__ = key
    register(key, sql=f"SELECT {id_col}, {sqlfn(col)} AS {out} FROM {source}")(q)


_text_query("clean_html", "pages", "page_id", "html", T.clean_html, S.clean_html)
_text_query("clean_body", "documents", "doc_id", "text", T.clean_body, S.clean_body)
_text_query("clean_sms", "conversations", "conv_id, turn", "text", T.clean_sms, S.clean_sms)
_text_query("strip_nonalpha_space", "documents", "doc_id", "text", T.strip_nonalpha_space, S.strip_nonalpha_space)
_text_query("strip_nonalpha_drop", "documents", "doc_id", "text", T.strip_nonalpha_drop, S.strip_nonalpha_drop)
_text_query("strip_punct", "documents", "doc_id", "text", T.strip_punct, S.strip_punct)
_text_query("strip_urls", "pages", "page_id", "html", T.strip_urls, S.strip_urls)


def extract_email(spark, sf):
    """First address in sender / receiver of the mail rows and in every document body."""
    mail = FX.mail_table(spark, sf)  # one row per document: its body is the document text
    return mail.select("msg_id", T.extract_email("sender").alias("sender"),
                       T.extract_email("receiver").alias("receiver"), T.extract_email("body").alias("body_email"))


register("extract_email", sql=FX.with_ctes(FX.SQL_MAIL) + (
    f"SELECT m.msg_id, {S.extract_email('m.sender')} AS sender, {S.extract_email('m.receiver')} AS receiver, "
    f"{S.extract_email('d.text')} AS body_email FROM mail m JOIN documents d ON m.msg_id = d.doc_id"))(extract_email)


def clean_date(spark, sf):
    return FX.date_texts(spark, sf).select("msg_id", "date", T.clean_date("date").alias("clean_date"))


register("clean_date", sql=FX.with_ctes(FX.SQL_DATE_TEXTS) + (
    f"SELECT msg_id, date, {S.clean_date('date')} AS clean_date FROM dt"))(clean_date)


def clean_subject(spark, sf):
    return FX.mail_table(spark, sf).select("msg_id", T.clean_subject("subject").alias("subject"))


register("clean_subject", sql=FX.with_ctes(FX.SQL_MAIL) + (
    f"SELECT msg_id, {S.clean_subject('subject')} AS subject FROM mail"))(clean_subject)


def clean_email_table(spark, sf):
    """The five column cleaners over the whole mail table, in one select."""
    return textops.clean_email_table(FX.mail_table(spark, sf))


SQL_CLEAN_MAIL = (f"SELECT msg_id, {S.extract_email('sender')} AS sender, {S.extract_email('receiver')} AS receiver, "
                  f"{S.clean_date('date')} AS date, {S.clean_subject('subject')} AS subject, "
                  f"{S.clean_body('body')} AS body FROM mail")
register("clean_email_table", sql=FX.with_ctes(FX.SQL_MAIL) + SQL_CLEAN_MAIL)(clean_email_table)


def normalise_bilstm(spark, sf):
    return _docs(spark, sf).select("doc_id", textops.normalise_bilstm(F.col("text")).alias("text"))


register("normalise_bilstm", sql=(
    "SELECT doc_id, array_to_string(list_filter(regexp_extract_all("
    "regexp_replace(regexp_replace(lower(text), 'http\\S+|www\\S+|https\\S+', '', 'g'), '[^a-zA-Z\\s]', '', 'g'),"
    f" '\\S+'), lambda x: NOT list_contains({S.NLTK_LIST_SQL}, x)), ' ') AS text FROM documents"))(normalise_bilstm)


# ---------------------------------------------------------------- labels

SQL_LABEL_RULES = {
    "email_binary": "CASE email_label WHEN 'Safe Email' THEN 0 WHEN 'Phishing Email' THEN 1 END",
    "email_equality": "coalesce(CAST(email_label = 'Phishing Email' AS INTEGER), 0)",
    "sms_three": "CASE lower(sms_label) WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 WHEN 'smishing' THEN 2 END",
    "sms_merged": "CASE lower(sms_label) WHEN 'ham' THEN 0 WHEN 'spam' THEN 0 WHEN 'smishing' THEN 1 END",
    "sms_equality_lower": "coalesce(CAST(lower(sms_label) = 'smishing' AS INTEGER), 0)",
    "sms_equality_cs": "coalesce(CAST(sms_label = 'Smishing' AS INTEGER), 0)",
}


def map_labels(spark, sf):
    """The label rules of the scripts side by side on raw label strings (nulls included)."""
    r = FX.raw_labels(spark, sf)
    return r.select(
        "msg_id",
        L.map_labels_binary("email_label").cast("int").alias("email_binary"),
        L.map_labels_equality("email_label").cast("int").alias("email_equality"),
        L.map_labels_three("sms_label").cast("int").alias("sms_three"),
        L.map_labels_merged("sms_label").cast("int").alias("sms_merged"),
        L.map_labels_equality_lower("sms_label").cast("int").alias("sms_equality_lower"),
        L.map_labels_equality_cs("sms_label").cast("int").alias("sms_equality_cs"),
    )


register("map_labels", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    "SELECT msg_id, " + ", ".join(f"CAST({e} AS INTEGER) AS {k}" for k, e in SQL_LABEL_RULES.items())
    + " FROM raw"))(map_labels)


def lower_labels(spark, sf):
    return FX.raw_labels(spark, sf).select("msg_id", L.lower_labels("sms_label").alias("sms_label"))


register("lower_labels", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    "SELECT msg_id, lower(sms_label) AS sms_label FROM raw"))(lower_labels)


def cast_label(spark, sf):
    """A float label (from a lookup that can miss) cast to int."""
    r = FX.raw_labels(spark, sf)
    as_float = L.map_labels_merged("sms_label").cast("double")
    return r.select("msg_id", L.cast_label(as_float).alias("label"))


register("cast_label", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    f"SELECT msg_id, CAST(CAST({SQL_LABEL_RULES['sms_merged']} AS DOUBLE) AS INTEGER) AS label FROM raw"))(cast_label)


def fill_missing(spark, sf):
    """Whole-frame fillna(''): every string column, unlabelled rows included."""
    return FX.raw_labels(spark, sf).drop("text").na.fill("")


register("fill_missing", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    "SELECT msg_id, coalesce(email_label, '') AS email_label, coalesce(sms_label, '') AS sms_label FROM raw"))(
    fill_missing)


# ---------------------------------------------------------------- filters

def drop_unlabelled(spark, sf):
    r = FX.raw_labels(spark, sf)
    return (r.select("msg_id", L.map_labels_three("sms_label").alias("label"))
            .dropna(subset=["label"]))


register("drop_unlabelled", sql=FX.with_ctes(FX.SQL_RAW_LABELS) + (
    f"SELECT msg_id, label FROM (SELECT msg_id, CAST({SQL_LABEL_RULES['sms_three']} AS INTEGER) AS label FROM raw) "
    "WHERE label IS NOT NULL"))(drop_unlabelled)


def filter_max_length(spark, sf, max_len: int = 10000):
    """Keep texts of at most ``max_len`` characters, by the text itself (a stored length may be stale)."""
    return (_docs(spark, sf).where(F.length("text") <= max_len)
            .select("doc_id", F.length("text").cast("long").alias("length")))


register("filter_max_length", sql=(
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS length FROM documents WHERE length(text) <= 10000"))(
    filter_max_length)


def truncate_text(spark, sf, max_len: int = 10000):
    return _docs(spark, sf).select("doc_id", F.substring("text", 1, max_len).alias("text"))


register("truncate_text", sql="SELECT doc_id, substr(text, 1, 10000) AS text FROM documents")(truncate_text)


def drop_columns(spark, sf):
    return _docs(spark, sf).drop("lang", "source", "text")


register("drop_columns", sql="SELECT doc_id, n_chars FROM documents")(drop_columns)
