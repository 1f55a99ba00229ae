"""Size checks that decide how a key or a join side is handled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from antecede.session import (
    BROADCAST_BYTES,
    BROADCAST_BYTES_DEFAULT,
    BROADCAST_ROWS,
    BROADCAST_ROWS_DEFAULT,
    HOT_KEY_ROWS,
    HOT_KEY_ROWS_DEFAULT,
    WINDOW_ROWS,
    WINDOW_ROWS_DEFAULT,
    setting,
)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | Mapping[str, str],
    columns: Sequence[str] | Mapping[str, str] = (),
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Join ``right`` (unique per key) and keep only ``columns`` of it.

    ``keys`` maps left to right key names, ``columns`` output to right names.  With ``null_safe`` a NULL
    key is a group of its own.  Keys are renamed, so joining a frame to one derived from it is safe.
    """
    keys = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    columns = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    side = right.select(
        *[F.col(r).alias(f"__key{i}") for i, r in enumerate(keys.values())],
        *[F.col(src).alias(out) for out, src in columns.items()],
    )
    conds = []
    for i, k in enumerate(keys):
        conds.append(F.col(k).eqNullSafe(F.col(f"__key{i}")) if null_safe else F.col(k) == F.col(f"__key{i}"))
    joined = left.join(side, reduce(lambda a, b: a & b, conds), how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*left.columns, *columns)


def split_hot(
    df: DataFrame, keys: Sequence[str], rows: int | None = None, probe: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary keys, rows of hot keys or None when no key is hot, number of rows counted).

    A key with more than ``rows`` rows is hot; at most total/rows keys are.  ``probe`` is a cheaper frame with the
    same keys to count on, such as the table before joins.
    """
    limit = rows or setting(df.sparkSession, HOT_KEY_ROWS, HOT_KEY_ROWS_DEFAULT)
    counts = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    found = counts.agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias("all"), F.max("__rows").alias("most")).first()
    if found["most"] is None or found["most"] <= limit:
        return df, None, found["all"]
    hot = F.broadcast(counts.where(F.col("__rows") > limit).select(*keys))
    return (lookup(df, hot, keys, how="left_anti", null_safe=True),
            lookup(df, hot, keys, how="left_semi", null_safe=True), found["all"])


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """One exchange on ``keys`` for a frame of about ``rows`` rows, so that no task sorts many more than the stated number.

    Adaptive execution sizes partitions by shuffled bytes, and every sort of a chain of windows keeps its own wider copy
    of them. A frame that one task could hold is left to it.
    """
    parts = -(-rows // setting(df.sparkSession, WINDOW_ROWS, WINDOW_ROWS_DEFAULT))
    if parts <= 1:
        return df.repartition(*keys)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def _cached_bytes(kept: DataFrame) -> int:
    """Size of a persisted frame that has been read once."""
    return int(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a count of rows and bytes; a larger side keeps the shuffle join.

    The side is persisted for the count, so it is computed once; a lost block is recomputed.
    """
    limit = rows or setting(df.sparkSession, BROADCAST_ROWS, BROADCAST_ROWS_DEFAULT)
    kept = df.persist()
    if kept.limit(limit + 1).count() <= limit and _cached_bytes(kept) <= setting(df.sparkSession, BROADCAST_BYTES, BROADCAST_BYTES_DEFAULT):
        return F.broadcast(kept)
    kept.unpersist()
    return df
