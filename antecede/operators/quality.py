"""Audits. Each returns the offending rows (empty means pass) or one row of measurements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.operators.pit import Prior
from antecede.operators.ranks import exact_quantiles
from antecede.operators.skew import checked_broadcast, lookup


class AuditFailure(AssertionError):
    """A data-quality rule found offending rows."""


def require_empty(df: DataFrame, message: str, show: int = 5) -> None:
    found = df.limit(show).collect()
    if found:
        raise AuditFailure(f"{message}: {[r.asDict() for r in found]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged with the side; one shuffle for both directions."""
    both = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    sides = both.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return sides.where("__l <> __r").select(
        *keys, F.when(F.col("__l") == 1, "left").otherwise("right").alias("only_in"))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Inner join that fails on duplicate keys or lost rows."""
    for side, name in ((left, "left"), (right, "right")):
        require_empty(duplicate_keys(side, keys), f"{name} side has duplicate keys")
    require_empty(key_difference(left, right, keys), "sides do not cover the same keys")
    return lookup(left, right, keys, columns, how="inner")


def close(actual: Column, expected: Column, rtol: float = 1e-9, atol: float = 5e-4) -> Column:
    """Both missing, or within tolerance."""
    near = F.abs(actual - expected) <= atol + rtol * F.abs(expected)
    return F.when(actual.isNull() | expected.isNull(), actual.isNull() & expected.isNull()).otherwise(near)


def recompute(rows: DataFrame, history: DataFrame, prior: Prior, *, row_id: Sequence[str], date: str,
              order: Sequence[str], eligible: str | None = None) -> DataFrame:
    """Outputs of ``prior`` for sampled ``rows`` by a join on an earlier date: no windows over history.

    The sample is the small side. One sampled row of a hot key may still meet very much history, so
    last-N outputs keep N rows per sampled row before the shuffle and totals are mergeable.
    """
    src = history.where(F.col(prior.value).isNotNull())
    if eligible:
        src = src.where(F.coalesce(F.col(eligible), F.lit(False)))
    src = src.select(*[F.col(k).alias(f"__h_{k}") for k in prior.keys], F.col(date).alias("__h_date"),
                     *[F.col(o).alias(f"__h_{o}") for o in order], F.col(prior.value).cast("double").alias("__h_v"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in prior.keys])
    base = rows.select(*dict.fromkeys([*row_id, *prior.keys, date]))
    pairs = src.join(checked_broadcast(base), same & (F.col("__h_date") < F.col(date)))
    table = {"mean": F.avg, "std": F.stddev_samp, "median": F.median, "count": F.count}
    out = base.select(*row_id)
    if prior.unbounded:
        totals = pairs.groupBy(*row_id).agg(*[table[agg]("__h_v").alias(n) for n, agg in prior.unbounded.items()])
        out = lookup(out, totals, row_id, list(prior.unbounded), null_safe=True)
    if prior.bounded:
        newest = W.partitionBy(*row_id).orderBy(F.col("__h_date").desc(), *[F.col(f"__h_{o}").desc() for o in order])
        most = max(size for _, size in prior.bounded.values())
        tail = pairs.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= most)
        last = tail.groupBy(*row_id).agg(*[
            table[agg](F.when(F.col("__k") <= size, F.col("__h_v"))).alias(n) for n, (agg, size) in prior.bounded.items()])
        out = lookup(out, last, row_id, list(prior.bounded), null_safe=True)
    return out.fillna(0, list(prior.counts)) if prior.counts else out


def ordered_sample(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``size`` rows chosen by a digest of their keys: repeatable and the same in any engine."""
    digest = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(digest, *keys).limit(size)


def hash_sample(df: DataFrame, keys: Sequence[str], one_in: int, seed: int = 20250916) -> DataFrame:
    """Repeatable sample by key hash, independent of partitioning."""
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(one_in)) == 0)


def recomputation_mismatches(built: DataFrame, history: DataFrame, prior: Prior, *, row_id: Sequence[str],
                             date: str, order: Sequence[str], eligible: str | None = None) -> DataFrame:
    expected = recompute(built, history, prior, row_id=row_id, date=date, order=order, eligible=eligible)
    names = [*prior.outputs, *prior.counts]
    both = lookup(built.select(*row_id, *names), expected, row_id, {f"__x_{n}": n for n in names}, null_safe=True)
    same = reduce(lambda a, b: a & b, [close(F.col(n), F.col(f"__x_{n}")) for n in names])
    return both.where(~same)


def first_event_violations(df: DataFrame, player: str, date: str, null_features: Sequence[str],
                           zero_features: Sequence[str] = ()) -> DataFrame:
    """Rows on a player's first date must have no history; the first date is a mergeable aggregate."""
    first = df.groupBy(player).agg(F.min(date).alias("__first"))
    rows = lookup(df, first, [player], ["__first"], null_safe=True).where(F.col(date) == F.col("__first"))
    bad = [F.col(c).isNotNull() for c in null_features] + [F.coalesce(F.col(c), F.lit(0)) != 0 for c in zero_features]
    return rows.where(reduce(lambda a, b: a | b, bad)).drop("__first")


def perturbation_changes(build, matches: DataFrame, row: Mapping[str, object], value: str, *, player: str,
                         opponent: str, date: str, row_id: Sequence[str], compare: Sequence[str],
                         shift: float = 10_000.0) -> DataFrame:
    """Shift one row's own target: its features must not move. Only players of that row's match are rebuilt."""
    involved = [row[player], row[opponent]]
    subset = matches.where((F.col(date) <= F.lit(row[date])) & (F.col(player).isin(involved)
                                                               | F.col(opponent).isin(involved)))
    is_row = reduce(lambda a, b: a & b, [F.col(c) == F.lit(row[c]) for c in row_id])
    moved = subset.withColumn(value, F.when(is_row, F.col(value) + shift).otherwise(F.col(value)))
    before = build(subset).where(is_row).select(*row_id, *compare)
    after = build(moved).where(is_row).select(*row_id, *compare)
    return after.exceptAll(before)


def correlation_guard(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (),
                      threshold: float = 0.99) -> DataFrame:
    """|Pearson r| per feature; fewer than three pairs or a constant side gives no value."""
    t = F.col(target).cast("double")
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        ok = x.isNotNull() & t.isNotNull()
        xs, ts = F.when(ok, x), F.when(ok, t)
        usable = (F.count(xs) >= 3) & (F.min(xs) < F.max(xs)) & (F.min(ts) < F.max(ts))
        # corr() itself fails on a constant column under ANSI rules
        r = F.try_divide(F.covar_samp(xs, ts), F.stddev_samp(xs) * F.stddev_samp(ts))
        aggs.append(F.when(usable, F.abs(r)).alias(f))
    wide = df.groupBy(*by).agg(*aggs)
    long = wide.unpivot(list(by), list(features), "feature", "abs_correlation")
    return long.withColumn("suspicious", F.coalesce(F.col("abs_correlation") > threshold, F.lit(False)))


def null_rates(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    wide = df.groupBy(*by).agg(*[(100.0 * F.avg(F.col(f).isNull().cast("int"))).alias(f) for f in features])
    return wide.unpivot(list(by), list(features), "feature", "null_pct")


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles with linear interpolation, max."""
    v = F.col(value).cast("double")
    basics = df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                 F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = exact_quantiles(df, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    if not by:
        return basics.crossJoin(quartiles)
    return lookup(basics, quartiles, by, ["q25", "q50", "q75"], null_safe=True)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows passing every rule, rows failing with the first failing rule's name)."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    tagged = df.withColumn("reject_reason", reason)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), tagged.where(
        F.col("reject_reason").isNotNull())


def assert_cutoff(training: DataFrame, date: str, cutoff) -> None:
    """No training row may lie on or after the cutoff."""
    require_empty(training.where(F.col(date) >= F.lit(cutoff)), f"training rows on or after {cutoff}")


def census(df: DataFrame, player: str) -> DataFrame:
    """Total, real and demo row counts."""
    demo = F.coalesce(F.col(player).startswith("demo_"), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~demo).alias("real_rows"),
                  F.count_if(demo).alias("demo_rows"))


def count_mismatch(built: DataFrame, stored: DataFrame) -> DataFrame:
    """One row when as many rows were stored as built is not true, else none."""
    both = built.agg(F.count(F.lit(1)).alias("built_rows")).crossJoin(
        F.broadcast(stored.agg(F.count(F.lit(1)).alias("stored_rows"))))
    return both.where("built_rows <> stored_rows")


def census_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Demo counts a real run changed: ``before`` and ``after`` are (table_name, demo_rows)."""
    out = lookup(before.select("table_name", "demo_rows"), after, ["table_name"], {"demo_rows_after": "demo_rows"})
    return out.where(~F.col("demo_rows").eqNullSafe(F.col("demo_rows_after")))


def history_without_value(df: DataFrame, observations: str, value: str, minimum: int = 1) -> DataFrame:
    """Rows whose history is long enough but whose aggregate is missing (two rows are needed for a deviation)."""
    return df.where((F.col(observations) >= minimum) & F.col(value).isNull())
