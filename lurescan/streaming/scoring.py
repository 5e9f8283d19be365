"""The stateless message-scoring plan applied to a stream of message files.

Chunk scoring and the hand-made features are row-local expressions, so the
batch plan runs unchanged on ``readStream``: no state, no watermark, no
shuffle.  Outside the reference's inventory (its scripts are one-shot
batches); kept because a mailbox is naturally a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.functions import text as T
from lurescan.operators import textops as X
from lurescan.operators.scoring import rule_scorer, verdict_text


def score_frame(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prediction, n_chunks, verdict, has_url, has_email, has_phone) in one projection."""
    df = df.select("*", X.tokenize_ws(text_col).alias("_t"))  # a column: chunking reads it per chunk
    chunks = X.chunk_tokens(F.col("_t"), 512)
    flags = F.transform(chunks, lambda t: (rule_scorer(F.array_join(t, " ")) > 0).cast("int"))
    pred = F.coalesce(F.array_max(flags), F.lit(0))
    text = F.col(text_col)
    return df.select(
        id_col,
        pred.alias("prediction"),
        F.size(chunks).cast("long").alias("n_chunks"),
        verdict_text(pred, text).alias("verdict"),
        T.has_url(text).alias("has_url"),
        T.has_email(text).alias("has_email"),
        T.has_phone(text).alias("has_phone"),
    )


def score_stream(spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text",
                 max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming DataFrame scoring every message file that lands in ``source``."""
    schema = spark.read.parquet(source).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    return score_frame(s, id_col, text_col)
