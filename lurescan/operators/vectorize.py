"""Vectorisation in long form.

Long form ``(id, term, value)`` is the checkable and scalable shape: term
statistics are a partial+final aggregation on ``term``; they reach the
(id, term) rows by an equi join (broadcast only below a checked row count,
otherwise a shuffle join with AQE's skew split for hot terms); per-document
norms are a window on the document id, whose groups are bounded by the
document's distinct terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescan.functions.lexicon import KERAS_FILTERS
from lurescan.operators.joins import lookup_join
from lurescan.operators.ranking import global_rank

SK_TOKEN = "[\\p{L}\\p{N}_]{2,}"   # (?u)\b\w\w+\b: maximal word runs of two or more


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sklearn_tokens(c) -> Column:
    """Default vectoriser tokens: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(SK_TOKEN), 0)


def keras_tokens(c) -> Column:
    """Keras text_to_word_sequence: lower, filter characters -> space, split on space, drop empties."""
    s = F.translate(F.lower(_c(c)), KERAS_FILTERS, " " * len(KERAS_FILTERS))
    return F.filter(F.split(s, " "), lambda t: t != "")


def term_counts(df: DataFrame, id_cols, tokens: Column) -> DataFrame:
    """(ids..., term, tf): the tokens of each row counted within the row; nothing is shuffled.

    ``id_cols`` must identify a row.  Built-in array functions only: the sorted
    tokens, then the places where a run of equal ones starts, then the lengths of
    the runs.  Each step is a column of its own, which lambdas and later steps read
    any number of times; within one expression every mention would be worked out anew.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    s, at = F.col("_s"), F.col("_at")
    rows = df.select(*ids, tokens.alias("_tok"))
    rows = rows.select(*ids, F.sort_array(F.filter("_tok", lambda t: t.isNotNull())).alias("_s"))
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1))
    rows = rows.select(*ids, "_s", F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))).alias("_at"))
    runs = F.transform(at, lambda a, k: F.struct(
        F.get(s, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).cast("long").alias("tf")))
    return rows.select(*ids, F.explode(runs).alias("_c")).select(*ids, "_c.term", "_c.tf")


def term_stats(tc: DataFrame) -> DataFrame:
    """(term, df, total): documents containing the term and its total count."""
    return tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary_topk(tc: DataFrame, n_docs: int = 0, k: int | None = None, min_df: int = 1,
                    max_df: float | int | None = None) -> DataFrame:
    """Vocabulary after document-frequency bounds, top ``k`` by total count (ties by term).

    A float ``max_df`` is a share of ``n_docs``; an int is a document count;
    None is no upper bound.  The top-k is a distributed take-ordered (k rows
    per partition, merged).
    """
    st = term_stats(tc).where(F.col("df") >= min_df)
    if max_df is not None:
        max_count = max_df * n_docs if isinstance(max_df, float) else max_df
        st = st.where(F.col("df") <= F.lit(max_count))
    if k is not None:
        st = st.orderBy(F.desc("total"), F.asc("term")).limit(k)
    return st


def idf_table(tc: DataFrame, n_docs: int, vocab: DataFrame | None = None) -> DataFrame:
    """(term, idf) with the smoothed form ln((1 + n) / (1 + df)) + 1."""
    st = term_stats(tc) if vocab is None else vocab
    return st.select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def tfidf(tc: DataFrame, idf: DataFrame, id_cols="doc_id", sublinear: bool = False,
          norm: bool = True) -> DataFrame:
    """(ids..., term, weight): tf * idf, L2-normalised per document.

    Terms missing from ``idf`` are dropped (the transform of unseen text).
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    j = lookup_join(tc, idf, "term", how="inner")
    tf = (F.lit(1.0) + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    w = j.select(*ids, "term", (tf * F.col("idf")).alias("weight"))
    if not norm:
        return w
    n2 = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*ids)))
    return w.select(*ids, "term", (F.col("weight") / n2).alias("weight"))


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """All runs of n_min to n_max tokens, joined by a space, within one row."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
        return F.when(F.size(tokens) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*[tokens if n == 1 else of(n) for n in range(n_min, n_max + 1)])


class NgramTfidf:
    """Vectoriser in long form: word n-grams without stop words, df bounds, a cap, sublinear tf, L2 norm.

    ``fit`` takes the vocabulary and document frequencies from the given rows
    only; ``transform`` drops every other n-gram.  ``stop_words`` is the
    caller's list; tokens on it are removed before n-grams are built.
    """

    def __init__(self, n_min: int = 1, n_max: int = 2, min_df: int = 1, max_df: float | int | None = None,
                 max_features: int | None = None, sublinear: bool = False, stop_words=()):
        self.n_min, self.n_max, self.sublinear = n_min, n_max, sublinear
        self.min_df, self.max_df, self.max_features = min_df, max_df, max_features
        self.stop_words = sorted(set(stop_words))
        self.idf: DataFrame | None = None

    def counts(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        tok = sklearn_tokens(text_col)
        if self.stop_words:
            stop = F.array(*[F.lit(w) for w in self.stop_words])
            tok = F.filter(tok, lambda t: ~F.array_contains(stop, t))
        rows = df.select(id_col, tok.alias("_w"))
        return term_counts(rows, id_col, ngrams(F.col("_w"), self.n_min, self.n_max))

    def fit(self, df: DataFrame, id_col: str, text_col: str) -> NgramTfidf:
        n = df.count()
        tc = self.counts(df, id_col, text_col)
        vocab = vocabulary_topk(tc, n, self.max_features, self.min_df, self.max_df)
        self.idf = idf_table(tc, n, vocab)
        return self

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return tfidf(self.counts(df, id_col, text_col), self.idf, id_col, sublinear=self.sublinear)


def word_index(tokens_df: DataFrame, tokens: Column, num_words: int | None = None,
               oov: bool = False) -> DataFrame:
    """Keras-style word index (term, idx, count): rank by count, ties by term, from 1.

    With ``oov`` index 1 is the out-of-vocabulary token and words start at 2.
    With ``num_words`` only indices below it are kept: a distributed top-k.
    Without a cap, a global rank over the whole vocabulary (range-partitioned,
    no single-task window).
    """
    counts = (tokens_df.select(F.explode(tokens).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("count")))
    first = 2 if oov else 1
    if num_words is not None:
        k = max(0, num_words - first)
        top = counts.orderBy(F.desc("count"), F.asc("term")).limit(k)
        w = Window.orderBy(F.desc("count"), F.asc("term"))  # at most num_words rows
        return top.select("term", (F.row_number().over(w) + first - 1).cast("long").alias("idx"), "count")
    r = global_rank(counts, [F.desc("count"), F.asc("term")], rank_col="idx")
    return r.select("term", (F.col("idx") + first - 1).cast("long").alias("idx"), "count")


def texts_to_sequences(df: DataFrame, id_cols, tokens: Column, index: DataFrame,
                       oov: bool = False, unknown: int | None = None) -> DataFrame:
    """(ids..., seq): word ids in word order; unknown words dropped, or id 1 with ``oov``, or ``unknown``."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    ex = df.select(*ids, F.posexplode(tokens).alias("pos", "term"))
    j = lookup_join(ex, index.select("term", "idx"), "term", how="left")
    if oov:
        unknown = 1
    idx = F.col("idx") if unknown is None else F.coalesce(F.col("idx"), F.lit(unknown).cast("long"))
    j = j.select(*ids, "pos", idx.alias("idx")).where(F.col("idx").isNotNull())
    seqs = (j.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("_s"))
            .select(*ids, F.transform("_s", lambda s: s["idx"]).alias("seq")))
    # rows with no known word keep an empty sequence
    empty = F.array().cast("array<bigint>")
    return (df.select(*ids).join(seqs, ids, "left")
            .select(*ids, F.coalesce(F.col("seq"), empty).alias("seq")))


def pad_sequences(seq, maxlen: int, padding: str = "pre", truncating: str = "pre", value: int = 0) -> Column:
    """Keras pad_sequences on one array column: fixed length ``maxlen``."""
    s = _c(seq)
    n = F.size(s)
    if truncating == "pre":
        cut = F.when(n > maxlen, F.slice(s, n - maxlen + 1, maxlen)).otherwise(s)
    else:
        cut = F.slice(s, 1, maxlen)
    fill = F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(maxlen) - F.size(cut), F.lit(0)))
    return F.concat(fill, cut) if padding == "pre" else F.concat(cut, fill)


def standard_scale_stats(train: DataFrame, cols: list[str]) -> dict:
    """Mean and population std per column (one aggregation row); zero std -> 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    out = {}
    for c in cols:
        sd = row[f"s_{c}"]
        out[c] = (row[f"m_{c}"], sd if sd not in (None, 0.0) else 1.0)
    return out


def standard_scale(df: DataFrame, stats: dict) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in stats:
            m, sd = stats[c]
            cols.append(((F.col(c) - F.lit(m)) / F.lit(sd)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
