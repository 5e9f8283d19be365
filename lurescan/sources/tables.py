"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a given table as its files are split (``spark.sql.files.maxPartitionBytes``).

    A caller who reads few large row groups on many cores may ask for more
    partitions by ``lurescan.scan.partitions``; unset, nothing is moved.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    want = spark.conf.get("lurescan.scan.partitions", None)
    return df.repartition(int(want)) if want else df
