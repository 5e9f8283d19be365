"""Tokens and word-level text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.functions.lexicon import LEMMA_TABLE, NOUN_SUFFIX_RULES
from lurescan.operators import dictionary as D
from lurescan.operators import textops as X
from lurescan.plans import sqlfrag as S
from lurescan.plans import sqlstem as SS
from lurescan.plans.registry import register
from lurescan.session import scoped_cache
from lurescan.sources import fixtures as FX
from lurescan.sources.tables import table

# ---------------------------------------------------------------- SQL twins

WORD_OR_PUNCT_SQL = "'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'"


def sql_tok_ws(t):
    return f"regexp_extract_all({t}, '\\S+')"


def sql_nostop(toks):
    return f"list_filter({toks}, lambda x: NOT list_contains({S.NLTK_LIST_SQL}, x))"


def sql_lemma(x):
    table_ = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in LEMMA_TABLE.items())
    rules = " ".join(f"WHEN suffix({x}, {S.q(suf)}) THEN left({x}, length({x}) - {len(suf)}) || {S.q(rep)}"
                     for suf, rep in NOUN_SUFFIX_RULES)
    return (f"CASE {x} {table_} ELSE (CASE WHEN length({x}) <= 3 OR regexp_matches({x}, '(ss|us|is)$') "
            f"THEN {x} {rules} ELSE {x} END) END")


def sql_lemmatize(toks):
    return f"list_transform({toks}, lambda w: {sql_lemma('w')})"


def sql_normal_tokens(t):
    """strip_nonalpha_space -> split -> stop words."""
    return sql_nostop(sql_tok_ws(S.strip_nonalpha_space(t)))


def _normal_tokens(c):
    return X.remove_stopwords(X.tokenize_ws(T.strip_nonalpha_space(c)))


def _docs(spark, sf):
    return table(spark, sf, "documents")


# ---------------------------------------------------------------- queries

def tokenize_ws(spark, sf):
    t = X.tokenize_ws("text")
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                   F.array_join(t, " ").alias("tokens"))


register("tokenize_ws", sql=(
    f"SELECT doc_id, CAST(len({sql_tok_ws('text')}) AS BIGINT) AS n_tokens, "
    f"array_to_string({sql_tok_ws('text')}, ' ') AS tokens FROM documents"))(tokenize_ws)


def tokenize_words(spark, sf):
    t = X.tokenize_words("text")
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                   F.array_join(t, " ").alias("tokens"))


register("tokenize_words", sql=(
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, {WORD_OR_PUNCT_SQL})) AS BIGINT) AS n_tokens, "
    f"array_to_string(regexp_extract_all(text, {WORD_OR_PUNCT_SQL}), ' ') AS tokens FROM documents"))(tokenize_words)


def tokenize_join(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.tokenize_join("text").alias("text"))


register("tokenize_join", sql=(
    f"SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), {WORD_OR_PUNCT_SQL}), ' ') AS text "
    "FROM conversations"))(tokenize_join)


def remove_stopwords(spark, sf):
    t = _normal_tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                   F.array_join(t, " ").alias("text"))


register("remove_stopwords", sql=(
    f"SELECT doc_id, CAST(len({sql_normal_tokens('text')}) AS BIGINT) AS n_tokens, "
    f"array_to_string({sql_normal_tokens('text')}, ' ') AS text FROM documents"))(remove_stopwords)


LEXICON_DOCS = 2  # a word may be a lemma when this many documents hold it


def _vocabulary(docs):
    """Distinct normalised words and their document counts, worked out once for words and lexicon."""
    return scoped_cache(D.vocabulary(docs, _normal_tokens(F.col("text"))))


def _lemmas(vocabulary):
    """(word, docs, lemma); the stand-in for a lexicon is the corpus: words of two documents or more."""
    return D.with_lemmas(vocabulary, vocabulary.where(F.col("docs") >= LEXICON_DOCS))


def _mapped(docs, forms, form):
    return D.map_words(docs, "doc_id", "text", _normal_tokens(F.col("_text")), forms.select("word", F.col(form).alias("form")))


def lemmatize(spark, sf):
    """Lemmas of the normalised tokens: detachment rules, candidates looked up in the lexicon."""
    docs = _docs(spark, sf)
    return _mapped(docs, _lemmas(_vocabulary(docs)), "lemma")


SQL_VOCABULARY = ["tok AS MATERIALIZED (SELECT doc_id, text, " + sql_normal_tokens("text") + " AS t FROM documents)",
                  "each AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM tok)",
                  "voc AS MATERIALIZED (SELECT word, count(DISTINCT doc_id) AS docs FROM each GROUP BY word)",
                  f"lex AS (SELECT word FROM voc WHERE docs >= {LEXICON_DOCS})"]


def _sql_mapped(ctes, forms):
    return ("WITH " + ", ".join(SQL_VOCABULARY + ctes) + ", done AS (SELECT doc_id, string_agg(form, ' ' ORDER BY pos) AS s "
            f"FROM each JOIN ({forms}) m USING (word) GROUP BY doc_id) SELECT tok.doc_id, "
            "CASE WHEN text IS NOT NULL THEN coalesce(s, '') END AS text FROM tok LEFT JOIN done USING (doc_id)")


register("lemmatize", sql=_sql_mapped(SS.lemma_ctes("voc", "lex"), "SELECT word, lemma AS form FROM lemmas"))(lemmatize)


def stem(spark, sf):
    """Porter stems (extended mode) of the normalised tokens, once a distinct word."""
    docs = _docs(spark, sf)
    return _mapped(docs, D.with_stems(_vocabulary(docs)), "stem")


register("stem", sql=_sql_mapped(SS.stem_ctes("voc", "word"), "SELECT word, stem AS form FROM stems"))(stem)


def lemstem_text(spark, sf):
    """lower -> non-letters to space -> tokens -> stop words -> lemma -> stem -> join."""
    docs = _docs(spark, sf)
    return _mapped(docs, D.with_stems(_lemmas(_vocabulary(docs)), "lemma"), "stem")


register("lemstem_text", sql=_sql_mapped(
    SS.lemma_ctes("voc", "lex") + SS.stem_ctes("lemmas", "lemma"),
    "SELECT l.word, s.stem AS form FROM lemmas l JOIN stems s ON l.lemma = s.word"))(lemstem_text)


def _augment_input(spark, sf):
    m = FX.m3(spark, sf)
    return m.select("msg_id", "label", F.array_join(_normal_tokens(F.col("text")), " ").alias("text"))


def augment_text(spark, sf):
    return X.augment_text(_augment_input(spark, sf), "msg_id", "text", n=2, seed=42, keep=["label"])


SQL_AUG_IN = ("ai AS (SELECT msg_id, label, array_to_string(" + sql_normal_tokens("text")
              + ", ' ') AS text FROM m3)")
SQL_AUG = ("aug AS (SELECT msg_id, copy, label, array_to_string(list_transform(w, lambda x: CASE WHEN x = pick THEN x "
           f"ELSE {sql_lemma('x')} END), ' ') AS text FROM ("
           "SELECT msg_id, copy, label, w, w[CAST((" + FX.sql_hash48("'42|' || CAST(msg_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)")
           + " % len(w)) AS BIGINT) + 1] AS pick FROM (SELECT msg_id, label, regexp_extract_all(text, '\\S+') AS w FROM ai) b, "
           "range(1, 3) r(copy) WHERE len(w) > 0) q)")
register("augment_text", sql=FX.with_ctes(FX.SQL_M3, SQL_AUG_IN, SQL_AUG)
         + "SELECT msg_id, copy, label, text FROM aug")(augment_text)


def augment_union(spark, sf):
    """Originals (copy 0) and their augmented copies, same label."""
    src = _augment_input(spark, sf)
    aug = X.augment_text(src, "msg_id", "text", n=2, seed=42, keep=["label"])
    return src.select("msg_id", F.lit(0).cast("long").alias("copy"), "label", "text").unionByName(
        aug.select("msg_id", F.col("copy").cast("long"), "label", "text"))


register("augment_union", sql=FX.with_ctes(FX.SQL_M3, SQL_AUG_IN, SQL_AUG)
         + "SELECT msg_id, CAST(0 AS BIGINT) AS copy, label, text FROM ai UNION ALL "
           "SELECT msg_id, CAST(copy AS BIGINT), label, text FROM aug")(augment_union)


CHUNK_CHARS = 500  # the scripts use 500,000; a smaller size exercises many chunks per document


def chunk_chars(spark, sf):
    c = X.chunk_chars(F.col("text"), CHUNK_CHARS)
    return _docs(spark, sf).select("doc_id", F.size(c).cast("long").alias("n_chunks"),
                                   X.chunked_lemmatize(F.col("text"), CHUNK_CHARS).alias("text"))


register("chunk_chars", sql=(
    f"SELECT doc_id, CAST(len(ch) AS BIGINT) AS n_chunks, array_to_string(list_transform(ch, lambda c: "
    f"array_to_string({sql_lemmatize(sql_tok_ws('lower(c)'))}, ' ')), ' ') AS text FROM ("
    f"SELECT doc_id, list_transform(range(0, CAST(ceil(length(text) / {CHUNK_CHARS}) AS BIGINT)), "
    f"lambda i: substr(text, i * {CHUNK_CHARS} + 1, {CHUNK_CHARS})) AS ch FROM documents) q"))(chunk_chars)


CHUNK_TOKENS = 512


def chunk_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", X.tokenize_ws("text").alias("t"))
    # exploded as an expression: for a column Spark would put a filter on its size below and work the tokens out again in it
    d = t.select("doc_id", F.posexplode(X.chunk_tokens(F.col("t"), CHUNK_TOKENS)).alias("chunk_no", "toks"))
    return d.select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
        F.size("toks").cast("long").alias("n_tokens"), F.array_join("toks", " ").alias("chunk"))


register("chunk_tokens", sql=(
    f"SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, CAST(len(t[i * {CHUNK_TOKENS} + 1:(i + 1) * {CHUNK_TOKENS}]) AS BIGINT) "
    f"AS n_tokens, array_to_string(t[i * {CHUNK_TOKENS} + 1:(i + 1) * {CHUNK_TOKENS}], ' ') AS chunk FROM ("
    f"SELECT doc_id, {sql_tok_ws('text')} AS t FROM documents) d, "
    f"LATERAL (SELECT unnest(range(0, CAST(ceil(len(t) / {CHUNK_TOKENS}) AS BIGINT))) AS i) r"))(chunk_tokens)


def ngrams(spark, sf):
    """Corpus n-gram (1..3) frequencies after stop-word removal: document frequency and count.

    One aggregation: every occurrence is emitted with first = 0, and every
    distinct n-gram of a document once more with first = 1; so df = sum(first)
    and tf = count - df, with map-side partial aggregation before the shuffle.
    """
    # tokens become a column first: the n-gram expression reads them many times
    t = _docs(spark, sf).select("doc_id", _normal_tokens(F.col("text")).alias("t"))
    d = t.select("doc_id", X.ngrams(F.col("t"), 1, 3).alias("g"))
    items = F.concat(F.transform("g", lambda x: F.struct(x.alias("ngram"), F.lit(0).alias("first"))),
                     F.transform(F.array_distinct("g"), lambda x: F.struct(x.alias("ngram"), F.lit(1).alias("first"))))
    ex = d.select(F.explode_outer(items).alias("it")).where(F.col("it").isNotNull())
    agg = ex.groupBy(F.col("it.ngram").alias("ngram")).agg(F.sum("it.first").alias("df"),
                                                            F.count(F.lit(1)).alias("n"))
    return agg.select("ngram", F.col("df").cast("long").alias("df"), (F.col("n") - F.col("df")).cast("long").alias("tf"))


register("ngrams", bench=True, sql=(
    "WITH t AS (SELECT doc_id, " + sql_normal_tokens("text") + " AS t FROM documents), "
    "g AS (SELECT doc_id, unnest(list_concat(t, "
    "list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')), "
    "list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')))) AS ngram FROM t) "
    "SELECT ngram, count(DISTINCT doc_id) AS df, count(*) AS tf FROM g GROUP BY ngram"))(ngrams)
