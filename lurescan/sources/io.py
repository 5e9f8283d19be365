"""Readers and sinks.

CSV is RFC-4180 style: header, quoted multi-line values, quotes doubled,
no whitespace trimming; schemas are explicit (no inference pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def read_csv(spark: SparkSession, path: str, schema: TY.StructType | str) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).option("mode", "PERMISSIVE").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_word_vectors(df: DataFrame, path: str, term_col: str = "term", vec_col: str = "vec") -> str:
    """Space-separated text: the word, then its floats."""
    line = F.concat_ws(" ", F.col(term_col), F.array_join(F.transform(vec_col, lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(term, vec array<float>) from a space-separated word-vector text file."""
    parts = F.split(F.col("value"), " ")
    return (spark.read.text(path)
            .select(F.element_at(parts, 1).alias("term"),
                    F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec")))


EMAIL_TABLE_SCHEMA = ("msg_id long, sender string, receiver string, date string, subject string, body string")
