"""Session helpers.

The library never builds its own cluster configuration; it reads what the
session has.  Only where ``spark.checkpoint.dir`` is unset in local mode (tests,
the bench) a scratch folder is created for it; elsewhere that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    b = SparkSession.builder.appName("lurescan")
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only when unset.

    Every operator that writes scratch data passes here, so this also makes
    sure that the executors have the package.
    """
    ship_package(spark)
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="lurescan-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_scratch: list[tuple[SparkSession, str]] = []
_cached: list[DataFrame] = []
_shipped: set[str] = set()


def scoped_cache(df: DataFrame) -> DataFrame:
    """Cache ``df`` until ``end_scope``; a lost executor's part is recomputed from lineage."""
    df = df.cache()
    _cached.append(df)
    return df


def end_scope() -> None:
    """Release the caches of earlier queries and remove their scratch folders.

    For callers that are done with earlier results; nothing calls it behind
    a result that may still be read.
    """
    while _cached:
        _cached.pop().unpersist()
    while _scratch:
        _delete(*_scratch.pop())


def remove_scratch(path: str | None) -> None:
    """Remove one scratch folder that no later result reads."""
    for entry in [e for e in _scratch if e[1] == path]:
        _scratch.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once a Spark application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lurescan-package-"), "lurescan.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lurescan", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path
