"""Join helpers: broadcast only behind a checked size, otherwise a shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.session import scoped_cache

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def _limit(df: DataFrame, key: str, default: int) -> int:
    conf = df.sparkSession.conf.get(key, None)
    return int(conf) if conf else default


def small_enough(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` is below both limits, by rows and by bytes (of its JSON form); one pass."""
    rows = _limit(df, "lurescan.broadcast.maxRows", DEFAULT_BROADCAST_ROWS) if max_rows is None else max_rows
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()  # one row
    return got["n"] <= rows and (got["b"] or 0) <= _limit(df, "lurescan.broadcast.maxBytes", DEFAULT_BROADCAST_BYTES)


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                max_rows: int | None = None) -> DataFrame:
    """Equi join of a large frame with a lookup table.

    The lookup side is cached (until ``session.end_scope``) and measured once;
    it is broadcast when it is below ``lurescan.broadcast.maxRows`` rows and
    ``lurescan.broadcast.maxBytes`` bytes, and the cached rows feed the join.
    Otherwise it is released and both sides shuffle on the key, with AQE's
    skew-join handling splitting hot keys.
    """
    small = scoped_cache(small)
    if small_enough(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    small.unpersist()
    return big.join(small, on, how)
