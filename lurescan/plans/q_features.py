"""Hand-made message features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.operators import entities
from lurescan.plans import sqlfrag as S
from lurescan.plans.registry import register
from lurescan.sources.tables import table


def _feature_cols(names, col="text"):
    out = []
    for n in names:
        c = T.FEATURES[n](F.col(col))
        if n == "avg_word_length":
            c = F.round(c, 6)
        out.append(c.alias(n))
    return out


SMS_BUNDLE = T.FEATURE_BUNDLES["sms"] + ["has_email"]


def message_features(spark, sf):
    """All hand-made features of every document, from raw text, in one select."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", *_feature_cols(SMS_BUNDLE))


register("message_features", bench=True, sql=(
    "SELECT doc_id, " + ", ".join(f"{S.feature_sql(n, 'text')} AS {n}" for n in SMS_BUNDLE)
    + " FROM documents"))(message_features)


def _single(name):
    def q(spark, sf):
        return table(spark, sf, "documents").select("doc_id", *_feature_cols([name]))
    q.__name__ = name
    return q


for _n in T.FEATURES:
    register(_n, sql=f"SELECT doc_id, {S.feature_sql(_n, 'text')} AS {_n} FROM documents")(_single(_n))


def url_features(spark, sf):
    """URL, e-mail and '?' features on page URLs and raw HTML (documents have no URL and no '?')."""
    p = table(spark, sf, "pages")
    return p.select(
        "page_id",
        T.has_url(F.col("url")).alias("url_has_url"),
        T.num_questions(F.col("url")).alias("url_num_questions"),
        T.has_url(F.col("html")).alias("html_has_url"),
        T.has_email(F.col("html")).alias("html_has_email"),
        T.num_questions(F.col("html")).alias("html_num_questions"),
    )


register("url_features", sql=(
    f"SELECT page_id, {S.has_url('url')} AS url_has_url, {S.num_questions('url')} AS url_num_questions, "
    f"{S.has_url('html')} AS html_has_url, {S.has_email('html')} AS html_has_email, "
    f"{S.num_questions('html')} AS html_num_questions FROM pages"))(url_features)


def feature_bundles(spark, sf):
    """The e-mail / split / synthetic bundles side by side (their union of columns)."""
    names = []
    for b in ("email", "split", "synthetic"):
        for n in T.FEATURE_BUNDLES[b]:
            if n not in names:
                names.append(n)
    return table(spark, sf, "documents").select("doc_id", *_feature_cols(names))


_BUNDLE_NAMES = []
for _b in ("email", "split", "synthetic"):
    for _n in T.FEATURE_BUNDLES[_b]:
        if _n not in _BUNDLE_NAMES:
            _BUNDLE_NAMES.append(_n)
register("feature_bundles", sql=(
    "SELECT doc_id, " + ", ".join(f"{S.feature_sql(n, 'text')} AS {n}" for n in _BUNDLE_NAMES)
    + " FROM documents"))(feature_bundles)


# ---------------------------------------------------------------- entity counts

def entity_counts_email(spark, sf):
    return entities.entity_counts(table(spark, sf, "documents").select("doc_id", "text"),
                                  entities.gazetteer(spark, sf), kinds=entities.EMAIL_KINDS,
                                  id_col="doc_id")


def entity_counts_sms(spark, sf):
    return entities.entity_counts(table(spark, sf, "documents").select("doc_id", "text"),
                                  entities.gazetteer(spark, sf), kinds=entities.SMS_KINDS,
                                  id_col="doc_id")


register("entity_counts_email", sql=entities.oracle_sql(entities.EMAIL_KINDS))(entity_counts_email)
register("entity_counts_sms", sql=entities.oracle_sql(entities.SMS_KINDS))(entity_counts_sms)


def bind_columns(spark, sf):
    """Hand-made features and entity counts side by side; the counts of names come back by a join on the id."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    # one projection over the text: features and pattern counts side by side (no self-join)
    return entities.entity_counts(d, entities.gazetteer(spark, sf), kinds=entities.EMAIL_KINDS,
                                  id_col="doc_id", extra=_feature_cols(T.FEATURE_BUNDLES["email"]))


register("bind_columns", sql=(
    "WITH e AS (" + entities.oracle_sql(entities.EMAIL_KINDS) + ") "
    "SELECT d.doc_id, " + ", ".join(f"{S.feature_sql(n, 'd.text')} AS {n}" for n in T.FEATURE_BUNDLES["email"])
    + ", " + ", ".join(f"e.{k}" for k in entities.EMAIL_KINDS)
    + " FROM documents d JOIN e ON d.doc_id = e.doc_id"))(bind_columns)
