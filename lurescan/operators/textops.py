"""Token and word-level operators on array<string> columns.

Everything is a built-in expression evaluated inside the row (transform /
filter / slice / regexp), so no shuffle is needed and whole-stage codegen covers
the work.  Stems, and lemmas checked against a lexicon, are in ``dictionary``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.functions.lexicon import LEMMA_TABLE, NLTK_STOPWORDS, NOUN_SUFFIX_RULES, PY_WHITESPACE_CLASS
from lurescan.sources.fixtures import hash48

WORD_OR_PUNCT = f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{PY_WHITESPACE_CLASS}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize_ws(c) -> Column:
    """Python ``str.split()``: runs of non-whitespace."""
    return T.split_words(c)


def tokenize_words(c) -> Column:
    """Word tokenizer: letter/digit runs, and every other non-space character alone."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_OR_PUNCT), 0)


def tokenize_join(c) -> Column:
    return F.array_join(tokenize_words(F.lower(_c(c))), " ")


def remove_stopwords(tokens, stopwords=NLTK_STOPWORDS) -> Column:
    """Drop stop words, keeping order and duplicates (unlike array_except)."""
    stop = list(stopwords)
    return F.filter(_c(tokens), lambda t: ~t.isin(stop))


def lemma_word(t: Column) -> Column:
    """Lemma of one lower-case word: the lemma table first, then noun suffix rules."""
    table = F.create_map(*[F.lit(x) for kv in LEMMA_TABLE.items() for x in kv])
    keep = (F.length(t) <= 3) | t.rlike("(ss|us|is)$")
    rule = F.when(keep, t)
    for suf, rep in NOUN_SUFFIX_RULES:
        rule = rule.when(t.endswith(suf), F.concat(t.substr(F.lit(1), F.length(t) - len(suf)), F.lit(rep)))
    return F.coalesce(F.try_element_at(table, t), rule.otherwise(t))


def lemmatize(tokens) -> Column:
    return F.transform(_c(tokens), lemma_word)


def normalise_bilstm(c) -> Column:
    """lower -> strip URLs -> keep letters/whitespace -> split -> stop words -> join."""
    s = T.strip_nonalpha_drop(T.strip_urls(F.lower(_c(c))))
    return F.array_join(remove_stopwords(tokenize_ws(s)), " ")


def shifted_join(tokens, n: int) -> Column:
    """Space-joined n-grams by zipping the array with its shifted slices.

    Outer arrays are passed as zip_with arguments (evaluated once per row),
    never referenced inside a lambda body, which would re-evaluate them for
    every element.
    """
    toks = _c(tokens)
    size = F.size(toks)
    acc = toks
    for k in range(2, n + 1):
        acc = F.zip_with(acc, F.slice(toks, k, F.greatest(size - k + 1, F.lit(1))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(acc, 1, F.greatest(size - n + 1, F.lit(0)))


def ngrams(tokens, n_min: int = 1, n_max: int = 3) -> Column:
    """All n-grams for n in [n_min, n_max], space-joined, shortest n first."""
    return F.concat(*[shifted_join(tokens, n) for n in range(n_min, n_max + 1)])


def chunk_tokens(tokens, size: int = 512) -> Column:
    """array of token slices of at most ``size`` tokens (empty when there are no tokens)."""
    toks = _c(tokens)
    n = F.size(toks)
    k = F.ceil(n / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1),
                                     lambda i: F.slice(toks, i * size + 1, size))
                  ).otherwise(F.array().cast("array<array<string>>"))


def chunk_chars(c, size: int = 500_000) -> Column:
    """Character slices of at most ``size`` characters."""
    s = _c(c)
    n = F.length(s)
    k = F.ceil(n / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1),
                                     lambda i: F.substring(s, i * size + 1, size))
                  ).otherwise(F.array().cast("array<string>"))


def chunked_lemmatize(c, size: int = 500_000) -> Column:
    """Process every character chunk (lower, split, lemma, join) and join the chunks by a space."""
    return F.array_join(F.transform(chunk_chars(c, size),
                                    lambda ch: F.array_join(lemmatize(tokenize_ws(F.lower(ch))), " ")), " ")


def augment_text(df: DataFrame, id_col: str, text_col: str, n: int = 2, seed: int = 42,
                 keep: list[str] | None = None) -> DataFrame:
    """``n`` copies of every non-empty text: one hash-picked word kept as it is
    (every occurrence of it), every other word lemmatised."""
    keep = keep or []
    words = tokenize_ws(F.col(text_col))
    base = df.select(id_col, *keep, words.alias("_w")).where(F.size("_w") > 0)
    rows = (base.select(id_col, *keep, "_w", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"))
            .withColumn("copy", F.col("copy").cast("long")))
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("copy").cast("string"))
    pick = F.element_at(F.col("_w"), (F.pmod(hash48(key), F.size("_w")) + 1).cast("int"))
    # the picked word reaches the lambda as a zipped argument, computed once per row
    new = F.zip_with(F.col("_w"), F.array_repeat(pick, F.size("_w")),
                     lambda w, p: F.when(w == p, w).otherwise(lemma_word(w)))
    return rows.select(id_col, "copy", *keep, F.array_join(new, " ").alias(text_col))


def clean_email_table(mail: DataFrame) -> DataFrame:
    return mail.select(
        "msg_id",
        T.extract_email("sender").alias("sender"),
        T.extract_email("receiver").alias("receiver"),
        T.clean_date("date").alias("date"),
        T.clean_subject("subject").alias("subject"),
        T.clean_body("body").alias("body"),
    )
