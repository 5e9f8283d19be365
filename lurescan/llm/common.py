"""Helpers shared by the operators: table reads, materialised tables, Arrow slices."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.session import remove_scratch, scratch_dir, ship_package

#: Texts are handed to the numpy kernels in slices of about this many bytes (one text at least).
SLICE_BYTES = 1 << 20

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Package on the executors, and Arrow batches of 4 MB where the session has Spark's default of 64.

    Kernels work in slices of about 1 MB, so larger batches would only wait in
    memory, on both sides of each worker's socket.
    """
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, str(4 << 20))


_paths: dict[int, str] = {}


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to a fresh folder under spark.checkpoint.dir (with the writer's ``options``) and read it back.

    This cuts the lineage with files that outlive any executor.  The schema is
    passed on, so an empty table reads back without inference.
    """
    ready(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def remove(df: DataFrame) -> None:
    """Remove the files of a table from ``materialise`` that nothing will read again."""
    remove_scratch(_paths.pop(id(df), None))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (also not in another letter case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def string_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of an Arrow string array; nulls count as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if not (pa.types.is_string(arr.type) or pa.types.is_binary(arr.type)):
        arr = arr.cast(pa.large_string())
        width = np.int64
    else:
        width = np.int32
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, width)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def released(batches):
    """The batches; after each, what Arrow's pool holds unused goes back to the system.

    A Python worker outlives its stage, and would hold that memory beside the next one's.
    """
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, kernel: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch],
              schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Run ``kernel(ids, offsets, bytes)`` over (id, text) rows in slices of bounded size.

    ``docs`` has exactly two columns, id and text.
    """

    ready(docs.sparkSession)

    def run(batches):
        for batch in released(batches):
            offsets, data = string_parts(batch.column(1))
            for a, b in slices(offsets, limit):
                own = offsets[a:b + 1]
                yield kernel(batch.column(0).slice(a, b - a), own - own[0], data[own[0]:own[-1]])

    return docs.mapInArrow(run, schema)
