"""Write disciplines over plain files: upserts as merged frames, guarded appends, partition replacement."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.operators import quality
from antecede.operators.quality import AuditFailure, require_empty
from antecede.session import ensure_checkpoint_dir, shuffles_dropped


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the session names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept_copy(df: DataFrame, name: str) -> DataFrame:
    """The rows as written to a fresh path in the shared folder: compressed, by column, computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_copy(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows as ``kept_copy`` writes them, for what is written inside; then the copy is deleted."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    try:
        with shuffles_dropped(spark):
            df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _merge(existing: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    old = existing.withColumn("__src", F.lit(0)).withColumn(seq, F.lit(None).cast(incoming.schema[seq].dataType))
    return old.unionByName(incoming.withColumn("__src", F.lit(1)))


def _winner(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    best = F.max_by(F.struct(*columns), order).alias("__s")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in columns])


def upsert_newer(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], as_of: str, seq: str) -> DataFrame:
    """Incoming replaces a row only when its ``as_of`` is not older; a missing ``as_of`` is oldest."""
    columns = [c for c in existing.columns if c not in keys]
    return _winner(_merge(existing, incoming, seq), keys, columns, F.struct(as_of, "__src", seq))


def upsert_last(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last incoming row per key wins over whatever is stored."""
    columns = [c for c in existing.columns if c not in keys]
    return _winner(_merge(existing, incoming, seq), keys, columns, F.struct("__src", seq))


def upsert_two_key(existing: DataFrame, incoming: DataFrame, first: Sequence[str], second: Sequence[str], seq: str,
                   fixed: Sequence[str] = (), provider: Sequence[str] = ()) -> DataFrame:
    """Match on ``first`` when all its parts are present, otherwise on ``second`` when that is complete.

    A row with neither is its provider's row: it meets only rows with the same ``provider`` and ``second``
    columns, NULL equal to NULL. So rows that could not be resolved are never merged with others. A row
    matched on ``second`` keeps the stored value of ``fixed`` columns. Rerunning the same snapshot changes
    nothing, and stored rows that no incoming row matches stay as they are.
    """
    columns = existing.columns

    def present(keys: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])

    identified, complete = present(first), present(second)
    data = [c for c in columns if c not in first]
    no_seq = F.lit(None).cast(incoming.schema[seq].dataType).alias(seq)

    # one pass over both sides by first key: stored rows take the newest incoming values
    both = existing.where(identified).select(*columns, no_seq, F.lit(0).alias("__src")).unionByName(
        incoming.where(identified).select(*columns, seq, F.lit(1).alias("__src")))
    merged = both.groupBy(*first).agg(F.max_by(F.struct(*data, seq), F.struct("__src", seq)).alias("__s"), F.min("__src").alias("__from"))
    # an updated row carries its update's position: if two come to share the second key the later update stays
    flat = merged.select(*first, "__s.*", F.col("__from").alias("__src")).select(*columns, "__src", seq)
    rows = flat.unionByName(existing.where(~identified).select(*columns, F.lit(0).alias("__src"), no_seq)).unionByName(
        incoming.where(~identified).select(*columns, F.lit(1).alias("__src"), seq))
    # what tells rows apart whose second key says too little
    apart = {f"__f{i}": F.when(~complete, F.col(c)) for i, c in enumerate(first)} | {
        f"__p{i}": F.when(~complete & ~identified, F.col(c)) for i, c in enumerate(provider)}
    order = F.struct("__src", seq)
    rest = [c for c in columns if c not in second and c not in fixed]
    out = rows.withColumns(apart).groupBy(*second, *apart).agg(
        F.max_by(F.struct(*rest), order).alias("__s"), *([F.min_by(F.struct(*fixed), order).alias("__f")] if fixed else []))
    return out.select(*second, "__s.*", *[F.col(f"__f.{c}").alias(c) for c in fixed]).select(*columns)


def merge_register(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counter register: count replaced, earliest first_seen kept, last_seen from the newest load."""
    both = existing.withColumn("__src", F.lit(0)).unionByName(incoming.withColumn("__src", F.lit(1)))
    return both.groupBy(*keys).agg(
        F.max_by("row_count", "__src").alias("row_count"), F.min("first_seen").alias("first_seen"),
        F.max_by("last_seen", "__src").alias("last_seen"))


def prune_register(register: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep only names that still have an unresolved row."""
    return register.join(rows.where("match_id IS NULL").select(*keys).distinct(), list(keys), "left_semi")


# --- files ----------------------------------------------------------------------------------------------

def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``.

    With data_mode among ``by``, replacing a real version never touches demo rows.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


PREDICTION_KEY = ["player_id", "match_id", "prop_type", "modelversion"]


def append_backtest(df: DataFrame, path: str) -> None:
    """Append run-specific predictions; a live version, partial provenance or a stored key is refused."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()  # the checks and the write read one stored copy
    require_empty(df.where(~F.col("modelversion").contains("_backtest_")), "not a backtest version")
    require_empty(df.where("fold_number IS NULL OR fold_cutoff_date IS NULL OR fold_test_end_date IS NULL"),
                  "incomplete fold provenance")
    require_empty(quality.duplicate_keys(df, PREDICTION_KEY), "duplicate prediction keys")
    old = stored(df.sparkSession, path)
    if old is not None:
        # stored by version: only the folders of the incoming versions are read
        same = old.join(F.broadcast(df.select("modelversion").distinct()), "modelversion", "left_semi")
        require_empty(df.join(same, PREDICTION_KEY, "left_semi"), "prediction already stored")
    append(df, path, ["modelversion"])


def write_predictions(df: DataFrame, path: str) -> None:
    """Live predictions: rerunning a version replaces that version and no other."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    require_empty(df.where(F.col("modelversion").contains("_backtest_")), "backtest versions are append-only")
    require_empty(quality.duplicate_keys(df, PREDICTION_KEY), "duplicate prediction keys")
    replace_partitions(df, path, ["sport", "prop_type", "modelversion"])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Chosen columns as CSV with a header; missing values are empty."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    text.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_fold_appendix(log: DataFrame, path: str) -> None:
    """Per-fold metric rows with columns in name order."""
    write_csv(log.where("fold_number > 0"), path, sorted(log.columns))


def require_rows(df: DataFrame, rules: Mapping[str, Column]) -> None:
    _, bad = quality.split_valid(df, rules)
    require_empty(bad, "row rules failed")


def prediction_rules() -> dict[str, Column]:
    """Interval order and all-or-none fold provenance."""
    lo, p, hi = F.col("lowerci"), F.col("prediction"), F.col("upperci")
    parts = [F.col(c).isNotNull().cast("int") for c in ("fold_number", "fold_cutoff_date", "fold_test_end_date")]
    present = reduce(lambda a, b: a + b, parts)
    in_order = F.when(lo.isNull() | hi.isNull(), True).otherwise((lo <= p) & (p <= hi))
    return {"interval order": in_order, "nonnegative bound": F.coalesce(lo >= 0, F.lit(True)),
            "fold provenance": (present == 0) | ((present == 3) & (F.col("fold_number") > 0)
                                                & (F.col("fold_cutoff_date") < F.col("fold_test_end_date")))}


def key_rule(column: str = "prop_key") -> dict[str, Column]:
    return {"key format": F.col(column).rlike(r"^[a-z][a-z0-9_]*$")}


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose parent is missing; NULL keys point nowhere and pass."""
    known = child.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return known.join(parent.select(*keys).distinct(), list(keys), "left_anti")


# --- scoped copy -------------------------------------------------------------------------------------------

def in_scope(df: DataFrame, player: str | None = "player_id", keep_null_player: bool = False,
             versions: DataFrame | None = None) -> DataFrame:
    """Real rows only; lines keep rows without a player; model rows need a version really used."""
    if player is not None:
        real = ~F.col(player).startswith("demo_")
        df = df.where(F.coalesce(real, F.lit(keep_null_player)))
    if versions is not None:
        df = df.join(versions.select("modelversion").distinct(), "modelversion", "left_semi")
    return df


def scoped_copy(tables: Mapping[str, DataFrame], folder: str, spark: SparkSession) -> DataFrame:
    """Copy each table into ``folder``; refuse stored rows; verify and report the counts."""
    for name in tables:
        old = stored(spark, f"{folder}/{name}")
        if old is not None and not old.isEmpty():
            raise AuditFailure(f"target {name} already has rows in scope")
    report: DataFrame | None = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        copied = spark.read.parquet(f"{folder}/{name}")
        counts = df.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(
            copied.agg(F.count(F.lit(1)).alias("copied_rows")))
        part = counts.select(F.lit(name).alias("table_name"), "source_rows", "copied_rows")
        report = part if report is None else report.unionByName(part)
    require_empty(report.where("source_rows <> copied_rows"), "copied counts differ")
    return report
