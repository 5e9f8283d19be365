"""Operator 1: exact dedup by stateful streaming.

A stream reads row fingerprints (digest, stable identifier, content locator)
and keeps, for every digest it has ever seen, one state row: the digest, the
number of rows, and the smallest (identifier, locator).  The state is keyed
aggregation state in RocksDB, on the executors' disks with its change log in
the shared folder; it has no watermark, so nothing expires.  A run can be
repeated with more files under the same checkpoint: a row that comes years
later still meets its first copy.

Rows of one digest are pre-aggregated in each task before the shuffle, so a
text that fills a third of the corpus sends one row a task.

A digest is only a claim.  On every hit (a row that is not the retained one of
its digest) the full bytes of the row are compared with the full bytes that
the retained locator points to.  Should bytes differ under one digest, the
rows of that digest are grouped by the text itself.

Two texts are equal when they are identical after each run of white space
``[\\x20\\x09-\\x0D]+`` becomes one space.

Cases
-----
* null and empty texts are equal to each other, not to a text of one space.
* null ids come after all others; repeated rows (same id and text) share one
  keep_id, and one of them is kept: ``locator`` breaks the tie.
* very long texts: digests and comparisons work on the whole text.
* empty table: an empty result (the stream has no batch to run).
* extra columns are ignored by ``classes`` and returned by ``keep``.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.llm import common
from lurescan.session import scratch_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory of an executor's state stores.
STATE_MB = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, common.WS_CLASS + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """digest, id and locator of each row, written once; the texts stay where they are.

    The locator (file, number) names the row's place in its source; the number
    is fixed by this write.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       digest(normalised(common.text_of(F.col(f"`{text_col}`")))).alias("digest"),
                       F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).alias("locator"))
    return common.materialise(rows, "op1-fingerprints")


def first_of() -> Column:
    """Order of rows within a digest: smallest id, nulls last, then the locator."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("locator"))


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB while the block runs.

    Without disk space set aside ahead (stores can be many and small), and with
    one bound on the memory of all stores of an executor.
    """
    conf = "spark.sql.streaming.stateStore.rocksdb."
    wanted = {PROVIDER: ROCKS, conf + "allowFAllocate": "false", conf + "boundedMemoryUsage": "true",
              conf + "maxMemoryUsageMB": str(STATE_MB)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_stream(spark: SparkSession, source: str, schema, checkpoint: str, max_files: int = 1000) -> None:
    """Feed all files under ``source`` that this checkpoint has not seen into its state."""
    with rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
        state = stream.groupBy("digest").agg(F.min(first_of()).alias("first"), F.count(F.lit(1)).alias("n"))
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stream's state as a table, written out: digest, first (id and locator), n."""
    with rocks(spark):
        state = spark.read.format("statestore").load(checkpoint)
        value = state.schema["value"].dataType.names
        return common.materialise(state.select(
            F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("first"),
            F.col(f"value.`{value[1]}`").alias("n")), "op1-groups")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept (and the locator)."""
    spark = docs.sparkSession
    prints = fingerprints(docs, id_col, text_col, digest)
    source = prints.inputFiles()
    if prints.isEmpty():
        return prints.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                             F.lit(True).alias("kept"), "locator")
    checkpoint = scratch_dir(spark, "op1-state")
    run_stream(spark, source[0].rsplit("/", 1)[0], prints.schema, checkpoint)
    groups = read_state(spark, checkpoint)

    bad = differing(docs, id_col, text_col, digest)
    out = prints.join(groups, "digest").select(
        "id", "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("locator") == F.col("first.locator")).alias("kept"), "locator")
    if bad.isEmpty():
        return out
    return (out.join(bad, "digest", "left_anti")
            .unionByName(by_text(docs, id_col, text_col, digest, prints, bad)))


def differing(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Digests that stand for several texts.

    Rows are grouped by digest and text, bytes compared, so a hot text sends
    one row a task, and then the texts of each digest are counted.
    """
    text = normalised(common.text_of(F.col(f"`{text_col}`")))
    rows = docs.select(text.alias("text")).withColumn("digest", digest(F.col("text")))
    texts = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("rows"))
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return common.materialise(several.select("digest"), "op1-differing")


def by_text(docs: DataFrame, id_col: str, text_col: str, digest, prints: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by the text itself."""
    text = normalised(common.text_of(F.col(f"`{text_col}`")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.join(bad, "digest", "left_semi")
    texts = rows.groupBy("digest", "text").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"))).alias("first"),
                                               F.count(F.lit(1)).alias("group_size"))
    placed = (rows.join(texts, ["digest", "text"])
              .select("digest", "id", F.col("first.id").alias("keep_id"), "group_size").distinct())
    hit = prints.join(bad, "digest", "left_semi").join(
        placed.withColumnRenamed("id", "own").withColumnRenamed("digest", "dg"),
        (F.col("digest") == F.col("dg")) & F.col("id").eqNullSafe(F.col("own")))
    one = hit.groupBy("digest", "keep_id").agg(F.min(first_of()).alias("first"))
    return hit.alias("h").join(one.alias("o"), (F.col("h.digest") == F.col("o.digest")) & F.col("h.keep_id").eqNullSafe(F.col("o.keep_id"))).select(
        "h.id", "h.digest", "h.keep_id", "h.group_size", (F.col("h.locator") == F.col("o.first.locator")).alias("kept"), "h.locator")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all columns.

    A kept row is known by its digest and id; rows that repeat both are equal
    in id and text, and one of them stays.
    """
    names = [f"`{c}`" for c in docs.columns]
    chosen = classes(docs, id_col, text_col).where("kept").select(
        F.col("digest").alias("_dg"), F.col("id").isNull().alias("_no"), F.coalesce("id", F.lit(0)).alias("_id"))
    whole, dg, no, own = (common.fresh(docs, x) for x in ("_whole", "_digest", "_no_id", "_own_id"))
    rows = docs.select(
        F.struct(*names).alias(whole), sha256(normalised(common.text_of(F.col(f"`{text_col}`")))).alias(dg),
        F.col(f"`{id_col}`").isNull().alias(no), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias(own))
    left = rows.join(chosen, (F.col(dg) == F.col("_dg")) & (F.col(no) == F.col("_no")) & (F.col(own) == F.col("_id")), "left_semi")
    one = left.dropDuplicates([dg, no, own])
    return one.select(*[F.col(whole).getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    out = classes(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
