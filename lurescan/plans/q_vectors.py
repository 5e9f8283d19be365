"""Vectorisation queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.functions.lexicon import KERAS_FILTERS, NLTK_STOPWORDS
from lurescan.operators import splits as SP
from lurescan.operators import vectorize as V
from lurescan.operators.embeddings import embedding_matrix as _embedding_matrix
from lurescan.operators.embeddings import word_vectors as _word_vectors
from lurescan.operators.joins import lookup_join
from lurescan.operators.models import featurize
from lurescan.operators.svd import truncated_svd as _truncated_svd
from lurescan.plans import sqlfrag as S
from lurescan.plans.q_splits import h48_sql
from lurescan.plans.registry import register
from lurescan.session import scoped_cache
from lurescan.sources import fixtures as FX
from lurescan.sources.tables import table

SK_TOK_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
KERAS_TOK_SQL = ("list_filter(string_split(translate(lower(text), " + S.q(KERAS_FILTERS) + ", "
                 + S.q(" " * len(KERAS_FILTERS)) + "), ' '), lambda t: t <> '')")


def _doc_tc(spark, sf):
    d = table(spark, sf, "documents")
    return V.term_counts(d, "doc_id", V.sklearn_tokens("text")), d


SQL_DOC_TC = ("tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + SK_TOK_SQL
              + ") AS term FROM documents) x GROUP BY doc_id, term)")


def count_vectors(spark, sf):
    """Bag of words over the 1000 most frequent terms, long form (doc_id, term, count)."""
    tc, _ = _doc_tc(spark, sf)
    vocab = V.vocabulary_topk(tc, k=1000).select("term")
    return (lookup_join(tc, vocab, "term", how="inner", max_rows=1000)
            .select("doc_id", "term", F.col("tf").alias("count")))


register("count_vectors", sql=FX.with_ctes(SQL_DOC_TC) + (
    "SELECT tc.doc_id, tc.term, tc.tf AS count FROM tc JOIN (SELECT term FROM tc GROUP BY term "
    "ORDER BY sum(tf) DESC, term LIMIT 1000) v ON tc.term = v.term"))(count_vectors)


def vocabulary_topk(spark, sf):
    """min_df 5, max_df 0.9, top 1000 by total count; rank from 1."""
    tc, d = _doc_tc(spark, sf)
    n = d.count()
    v = V.vocabulary_topk(tc, n_docs=n, k=1000, min_df=5, max_df=0.9)
    w = F.row_number().over(Window.orderBy(F.desc("total"), "term"))  # at most k rows
    return v.select("term", F.col("df").cast("long").alias("df"), F.col("total").cast("long").alias("total"),
                    w.cast("long").alias("rank"))


register("vocabulary_topk", sql=FX.with_ctes(SQL_DOC_TC) + (
    "SELECT term, df, total, row_number() OVER (ORDER BY total DESC, term) AS rank FROM ("
    "SELECT term, count(*) AS df, sum(tf) AS total FROM tc GROUP BY term "
    "HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT count(*) FROM documents) "
    "ORDER BY total DESC, term LIMIT 1000) v"))(vocabulary_topk)


def _tfidf(spark, sf, sublinear):
    tc, d = _doc_tc(spark, sf)
    n = d.count()
    out = V.tfidf(tc, V.idf_table(tc, n), "doc_id", sublinear=sublinear)
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf(spark, sf):
    return _tfidf(spark, sf, False)


def tfidf_sublinear(spark, sf):
    return _tfidf(spark, sf, True)


def sql_tfidf(tf_expr):
    return FX.with_ctes(SQL_DOC_TC) + (
        "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM ("
        f"SELECT tc.doc_id, tc.term, {tf_expr} * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + s.df)) + 1.0) AS w "
        "FROM tc JOIN (SELECT term, count(*) AS df FROM tc GROUP BY term) s ON tc.term = s.term) q")


register("tfidf", bench=True, sql=sql_tfidf("CAST(tc.tf AS DOUBLE)"))(tfidf)
register("tfidf_sublinear", sql=sql_tfidf("(1.0 + ln(tc.tf))"))(tfidf_sublinear)


def tfidf_transform_unseen(spark, sf):
    """Vocabulary and idf fitted on the train rows only, applied to the test rows."""
    sp = SP.split_random(FX.m2(spark, sf), "msg_id", 0.2, 42)
    tc = V.term_counts(sp, ["msg_id", "is_test"], V.sklearn_tokens("text"))
    train_tc = tc.where(F.col("is_test") == 0).drop("is_test")
    n_train = sp.where(F.col("is_test") == 0).count()
    idf = V.idf_table(train_tc, n_train)
    out = V.tfidf(tc.where(F.col("is_test") == 1).drop("is_test"), idf, "msg_id")
    return out.select("msg_id", "term", F.round("weight", 6).alias("weight"))


SQL_SPLIT_M2 = ("sp AS (SELECT msg_id, text, row_number() OVER (ORDER BY " + h48_sql(42) + ", msg_id) <= "
                "(SELECT ceil(count(*) * 0.2) FROM m2) AS is_test FROM m2)")
register("tfidf_transform_unseen", sql=FX.with_ctes(
    FX.SQL_M2, SQL_SPLIT_M2,
    "tc AS (SELECT msg_id, is_test, term, count(*) AS tf FROM (SELECT msg_id, is_test, unnest("
    + SK_TOK_SQL + ") AS term FROM sp) x GROUP BY ALL)",
    "idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM sp WHERE NOT is_test)) / (1.0 + count(*))) + 1.0 AS idf "
    "FROM tc WHERE NOT is_test GROUP BY term)") + (
    "SELECT msg_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 6) AS weight FROM ("
    "SELECT tc.msg_id, tc.term, tc.tf * idf.idf AS w FROM tc JOIN idf ON tc.term = idf.term WHERE tc.is_test) q"))(tfidf_transform_unseen)


# ---------------------------------------------------------------- Keras-style sequences

def _conv(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "text")


SQL_KERAS_COUNTS = ("kc AS (SELECT term, count(*) AS cnt FROM (SELECT unnest(" + KERAS_TOK_SQL
                    + ") AS term FROM conversations) x GROUP BY term)")


def word_index(spark, sf):
    """Capped index: 1000 words with an OOV token at 1 (indices 2..999 kept)."""
    return V.word_index(_conv(spark, sf), V.keras_tokens("text"), num_words=1000, oov=True)


register("word_index", sql=FX.with_ctes(SQL_KERAS_COUNTS) + (
    "SELECT term, idx, cnt AS count FROM (SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, term) + 1 AS idx "
    "FROM kc) q WHERE idx < 1000"))(word_index)


def word_index_full(spark, sf):
    """Uncapped index over the whole document vocabulary (global rank, no single-task window)."""
    return V.word_index(table(spark, sf, "documents"), V.keras_tokens("text"), num_words=None, oov=False)


register("word_index_full", sql=(
    "SELECT term, row_number() OVER (ORDER BY cnt DESC, term) AS idx, cnt AS count FROM ("
    "SELECT term, count(*) AS cnt FROM (SELECT unnest(" + KERAS_TOK_SQL + ") AS term FROM documents) x "
    "GROUP BY term) q"))(word_index_full)


def vocabulary_size(spark, sf):
    t = _conv(spark, sf).select(F.explode(V.keras_tokens("text")).alias("term"))
    return t.agg((F.countDistinct("term") + 1).cast("long").alias("vocab_size"))


register("vocabulary_size", sql=FX.with_ctes(SQL_KERAS_COUNTS) + (
    "SELECT CAST(count(*) + 1 AS BIGINT) AS vocab_size FROM kc"))(vocabulary_size)


def _seq_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _sequences(spark, sf, oov):
    c = _conv(spark, sf)
    idx = V.word_index(c, V.keras_tokens("text"), num_words=1000, oov=oov)
    return V.texts_to_sequences(c, ["conv_id", "turn"], V.keras_tokens("text"), idx, oov=oov)


def texts_to_sequences(spark, sf):
    """Word ids in word order: unknown words dropped (no OOV) and mapped to 1 (OOV) side by side.

    One index and one pass over the words give both: with an OOV token words
    stand one later, and the last word of the index falls out.
    """
    c = _conv(spark, sf)
    idx = V.word_index(c, V.keras_tokens("text"), num_words=1000, oov=False)
    s = V.texts_to_sequences(c, ["conv_id", "turn"], V.keras_tokens("text"), idx, oov=False, unknown=0)
    drop = F.filter("seq", lambda x: x > 0)
    oov = F.transform("seq", lambda x: F.when((x == 0) | (x + 1 >= 1000), F.lit(1).cast("long")).otherwise(x + 1))
    return s.select("conv_id", "turn", _seq_str(drop).alias("seq_drop"), F.size(drop).cast("long").alias("n_drop"),
                    _seq_str(oov).alias("seq_oov"), F.size("seq").cast("long").alias("n_oov"))


SQL_SEQ = FX.with_ctes(
    SQL_KERAS_COUNTS,
    "wi0 AS (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) AS idx FROM kc)",
    "wi1 AS (SELECT term, idx + 1 AS idx FROM wi0)",
    "tok AS (SELECT conv_id, turn, " + KERAS_TOK_SQL + " AS t FROM conversations)",
    "ex AS (SELECT conv_id, turn, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM tok)",
    "sd AS (SELECT ex.conv_id, ex.turn, list(w.idx ORDER BY ex.pos) AS s FROM ex JOIN wi0 w ON ex.term = w.term "
    "WHERE w.idx < 1000 GROUP BY ex.conv_id, ex.turn)",
    "so AS (SELECT ex.conv_id, ex.turn, list(CASE WHEN w.idx < 1000 THEN w.idx ELSE 1 END ORDER BY ex.pos) AS s "
    "FROM ex LEFT JOIN wi1 w ON ex.term = w.term GROUP BY ex.conv_id, ex.turn)",
    "seqs AS (SELECT tok.conv_id, tok.turn, coalesce(sd.s, []::BIGINT[]) AS s_drop, "
    "coalesce(so.s, []::BIGINT[]) AS s_oov FROM tok LEFT JOIN sd ON tok.conv_id = sd.conv_id AND tok.turn = sd.turn "
    "LEFT JOIN so ON tok.conv_id = so.conv_id AND tok.turn = so.turn)")
register("texts_to_sequences", sql=SQL_SEQ + (
    "SELECT conv_id, turn, array_to_string(s_drop, ',') AS seq_drop, CAST(len(s_drop) AS BIGINT) AS n_drop, "
    "array_to_string(s_oov, ',') AS seq_oov, CAST(len(s_oov) AS BIGINT) AS n_oov FROM seqs"))(texts_to_sequences)


def pad_sequences(spark, sf):
    """pre/pre to 100, post/post to 300, post padding with pre truncation to 30."""
    s = _sequences(spark, sf, True)
    return s.select("conv_id", "turn",
                    _seq_str(V.pad_sequences("seq", 100, "pre", "pre")).alias("pre_pre"),
                    _seq_str(V.pad_sequences("seq", 300, "post", "post")).alias("post_post"),
                    _seq_str(V.pad_sequences("seq", 30, "post", "pre")).alias("post_pre"))


def _sql_pad(s, n, padding, truncating):
    cut = f"(CASE WHEN len({s}) > {n} THEN {s}[len({s}) - {n} + 1:] ELSE {s} END)" if truncating == "pre" \
        else f"{s}[1:{n}]"
    fill = f"list_transform(range(0, greatest({n} - len({cut}), 0)), lambda i: CAST(0 AS BIGINT))"
    return f"list_concat({fill}, {cut})" if padding == "pre" else f"list_concat({cut}, {fill})"


register("pad_sequences", sql=SQL_SEQ + (
    f"SELECT conv_id, turn, array_to_string({_sql_pad('s_oov', 100, 'pre', 'pre')}, ',') AS pre_pre, "
    f"array_to_string({_sql_pad('s_oov', 300, 'post', 'post')}, ',') AS post_post, "
    f"array_to_string({_sql_pad('s_oov', 30, 'post', 'pre')}, ',') AS post_pre FROM seqs"))(pad_sequences)


# ---------------------------------------------------------------- embeddings, scaling

def embedding_matrix(spark, sf):
    c = _conv(spark, sf)
    idx = V.word_index(c, V.keras_tokens("text"), num_words=None, oov=False)
    vecs = _word_vectors(spark, sf, idx.select("term"))
    m = _embedding_matrix(idx, vecs, dim=64)
    return m.select("idx", "term", F.size("vec").cast("long").alias("dims"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"),
                    F.col("has_vector"))


register("embedding_matrix", sql=FX.with_ctes(
    SQL_KERAS_COUNTS,
    "wi AS (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) AS idx FROM kc)",
    "ne AS (SELECT count(*) AS n FROM embeddings)",
    "vec AS (SELECT wi.term, e.embedding FROM wi CROSS JOIN ne JOIN embeddings e ON e.vec_id = "
    + FX.sql_hash48("'v|' || wi.term") + " % ne.n WHERE " + FX.sql_hash_fraction("'w'", "wi.term") + " < 0.75)") + (
    "SELECT CAST(0 AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS term, CAST(64 AS BIGINT) AS dims, 0.0 AS vec_sum, "
    "false AS has_vector UNION ALL "
    "SELECT wi.idx, wi.term, CAST(64 AS BIGINT), round(coalesce(list_sum(list_transform(vec.embedding, "
    "lambda x: CAST(x AS DOUBLE))), 0.0), 6), vec.term IS NOT NULL FROM wi LEFT JOIN vec ON wi.term = vec.term"))(embedding_matrix)

SCALE_COLS = T.FEATURE_BUNDLES["sms"]


def standard_scale(spark, sf):
    """The SMS feature bundle scaled with mean / population std of the train rows."""
    sp = SP.split_random(FX.m2(spark, sf), "msg_id", 0.2, 42)
    feats = sp.select("msg_id", "is_test", *T.message_features(F.col("text"), "sms"))
    stats = V.standard_scale_stats(feats.where(F.col("is_test") == 0), SCALE_COLS)
    out = V.standard_scale(feats.drop("is_test"), stats)
    return out.select("msg_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in SCALE_COLS])


def _sql_scale():
    feats = ", ".join(f"{S.FEATURES[c]('text')} AS {c}" for c in SCALE_COLS)
    st = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 "
                   f"ELSE stddev_pop({c}) END AS s_{c}" for c in SCALE_COLS)
    sel = ", ".join(f"round((CAST(f.{c} AS DOUBLE) - st.m_{c}) / st.s_{c}, 6) AS {c}" for c in SCALE_COLS)
    return (FX.with_ctes(FX.SQL_M2, SQL_SPLIT_M2, f"f AS (SELECT msg_id, is_test, {feats} FROM sp)",
                         f"st AS (SELECT {st} FROM f WHERE NOT is_test)")
            + f"SELECT f.msg_id, {sel} FROM f, st")


register("standard_scale", sql=_sql_scale())(standard_scale)


def assemble_features(spark, sf):
    """Counts over the 1000 most frequent terms (by count, term) and hand-made features side by side."""
    m = FX.m2(spark, sf).select("msg_id", "label", "text")
    feats, _ = featurize(m, "text", 1000, "email")
    return feats.select("msg_id", "label", F.array_join(F.transform(
        vector_to_array("features"), lambda x: F.round(x, 6).cast("string")), ",").alias("features"))


def _sql_assemble():
    made = [f"CAST({S.FEATURES[c]('text')} AS DOUBLE)" for c in T.FEATURE_BUNDLES["email"]]
    return FX.with_ctes(
        FX.SQL_M2,
        "tc AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(" + SK_TOK_SQL + ") AS term FROM m2) x GROUP BY ALL)",
        "v AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term) AS j FROM tc GROUP BY term ORDER BY j LIMIT 1000)",
        "b AS (SELECT m2.msg_id, list(CAST(coalesce(tc.tf, 0) AS DOUBLE) ORDER BY v.j) AS bow FROM m2 CROSS JOIN v "
        "LEFT JOIN tc ON tc.msg_id = m2.msg_id AND tc.term = v.term GROUP BY m2.msg_id)") + (
        "SELECT m2.msg_id, m2.label, array_to_string(list_transform(list_concat(b.bow, [" + ", ".join(made)
        + "]), lambda x: CAST(round(x, 6) AS VARCHAR)), ',') AS features FROM m2 JOIN b ON m2.msg_id = b.msg_id")


register("assemble_features", sql=_sql_assemble())(assemble_features)


def truncated_svd(spark, sf, k: int = 100, vocab_size: int = 10_000):
    """Uncentred rank-100 SVD of the TF-IDF matrix (10,000 terms); every document's row."""
    tc, d = _doc_tc(spark, sf)
    n = d.count()
    # kept with its document frequencies: the texts are counted once for vocabulary and idf
    vocab = scoped_cache(V.vocabulary_topk(tc, n_docs=n, k=vocab_size))
    w = V.tfidf(lookup_join(tc, vocab.select("term"), "term", how="inner", max_rows=vocab_size),
                V.idf_table(tc, n, vocab), "doc_id")
    return _truncated_svd(w, d, "doc_id", vocab.select("term"), k=k)


register("truncated_svd")(truncated_svd)


# ---------------------------------------------------------------- n-gram TF-IDF

NGRAM_OPTIONS = {"n_max": 2, "min_df": 2, "max_df": 0.9, "max_features": 5000, "sublinear": True, "stop_words": NLTK_STOPWORDS}


def _ngram_rows(spark, sf):
    """Messages with ``is_test`` from the random split of the other train/test keys."""
    return SP.split_random(FX.m2(spark, sf), "msg_id", 0.2, 42)


def _tfidf_ngrams(spark, sf, **options):
    sp = _ngram_rows(spark, sf)
    model = V.NgramTfidf(**options).fit(sp.where(F.col("is_test") == 0), "msg_id", "text")
    return model, sp


def tfidf_ngrams(spark, sf):
    """Unigrams and bigrams without stop words, df within [2, 0.9 n], top 5000, sublinear: the train rows."""
    model, sp = _tfidf_ngrams(spark, sf, **NGRAM_OPTIONS)
    out = model.transform(sp.where(F.col("is_test") == 0), "msg_id", "text")
    return out.select("msg_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_ngrams_unseen(spark, sf):
    """The same vectoriser, fitted on the train rows and applied to the test rows."""
    model, sp = _tfidf_ngrams(spark, sf, **NGRAM_OPTIONS)
    out = model.transform(sp.where(F.col("is_test") == 1), "msg_id", "text")
    return out.select("msg_id", "term", F.round("weight", 6).alias("weight"))




def _sql_ngrams(test: bool):
    stop = "[" + ", ".join(S.q(w) for w in sorted(NLTK_STOPWORDS)) + "]"
    o = NGRAM_OPTIONS
    return FX.with_ctes(
        FX.SQL_M2, SQL_SPLIT_M2,
        "tk AS (SELECT msg_id, is_test, list_filter(" + SK_TOK_SQL + f", lambda t: NOT list_contains({stop}, t)) AS t FROM sp)",
        "ng AS (SELECT msg_id, is_test, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk)",
        "tc AS (SELECT msg_id, is_test, term, count(*) AS tf FROM ng GROUP BY ALL)",
        "nn AS (SELECT count(*) AS n FROM sp WHERE NOT is_test)",
        "v AS (SELECT term, count(*) AS df FROM tc WHERE NOT is_test GROUP BY term "
        f"HAVING count(*) >= {o['min_df']} AND count(*) <= {o['max_df']} * (SELECT n FROM nn) ORDER BY sum(tf) DESC, term LIMIT {o['max_features']})",
        "w AS (SELECT tc.msg_id, tc.term, (1.0 + ln(tc.tf)) * (ln((1.0 + nn.n) / (1.0 + v.df)) + 1.0) AS w "
        f"FROM tc JOIN v ON tc.term = v.term CROSS JOIN nn WHERE {'' if test else 'NOT '}tc.is_test)") + (
        "SELECT msg_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 6) AS weight FROM w")


register("tfidf_ngrams", sql=_sql_ngrams(False))(tfidf_ngrams)
register("tfidf_ngrams_unseen", sql=_sql_ngrams(True))(tfidf_ngrams_unseen)
