"""Chunked message scoring.

A message is cut into token chunks, every chunk gets a class id from a
pluggable scorer (a Column expression over the chunk text), and the message
is flagged when any chunk's class is non-zero.  All of it happens inside the
row (an ``array_max`` over the chunks' classes): nothing is exploded or
shuffled.  A message without chunks gets 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.functions.lexicon import VERDICT_NORMAL, VERDICT_PHISHING
from lurescan.operators import textops as X


def rule_scorer(chunk: Column) -> Column:
    """A deterministic stand-in for the transformer: 2 with a phone number, 1 with an
    e-mail address or three exclamation marks in a row, else 0."""
    return (F.when(T.has_phone(chunk) == 1, 2)
            .when((T.has_email(chunk) == 1) | chunk.contains("!!!"), 1)
            .otherwise(0)).cast("int")


def score_chunks_any(df: DataFrame, id_col: str, text_col: str, scorer: Callable[[Column], Column] = rule_scorer,
                     chunk_size: int = 512, keep: list[str] | None = None) -> DataFrame:
    """(id, prediction, n_chunks): 1 when any chunk's class is non-zero.

    The chunks of a message live in its own row, so the "any chunk" reduction
    is an array_max inside the row: no explode, no shuffle, no join back.
    """
    keep = keep or []
    toks = df.select(id_col, *keep, X.tokenize_ws(text_col).alias("_t"))  # a column: chunking reads it per chunk
    chunks = toks.select(id_col, *keep, X.chunk_tokens(F.col("_t"), chunk_size).alias("_ch"))
    flags = F.transform("_ch", lambda t: (scorer(F.array_join(t, " ")) > 0).cast("int"))
    return chunks.select(id_col, F.coalesce(F.array_max(flags), F.lit(0)).alias("prediction"),
                         F.size("_ch").cast("long").alias("n_chunks"), *keep)


def verdict_text(prediction: Column, body: Column) -> Column:
    return F.concat(F.when(prediction == 1, F.lit(VERDICT_PHISHING)).otherwise(F.lit(VERDICT_NORMAL)), body)
