"""Ranks and order statistics over groups too large for one window partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.operators.skew import checked_broadcast, lookup
from antecede.session import ensure_checkpoint_dir


def global_rank(df: DataFrame, scope: Sequence[str], order: Sequence[str], out: str = "rank",
                size: str | None = None) -> DataFrame:
    """1-based rank of every row within its scope, by ``order`` (which must be total).

    Rows are range-partitioned on (scope, order), so even one scope spreads over all tasks.  Only
    per-task row counts are combined; the sorted rows are checkpointed so that both uses of them see
    the same task boundaries even if an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = [*scope, *order]
    ranged = (
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
        .withColumn("__id", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("__task", F.shiftright("__id", 33))
    )
    pieces = ranged.groupBy(*scope, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = W.partitionBy(*scope).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*scope)
    pieces = pieces.withColumns({
        "__base": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__size": F.sum("__n").over(whole)})
    found = lookup(ranged, checked_broadcast(pieces), [*scope, "__task"], ["__first", "__base", "__size"], null_safe=True)
    found = found.withColumn(out, F.col("__base") + F.col("__id") - F.col("__first") + 1)
    if size:
        found = found.withColumn(size, F.col("__size"))
    return found.select(*df.columns, out, *([size] if size else []))


#: Splitters that a narrowing round puts between the ends of a bracket.
SPLITTERS = 1_000


def _with_brackets(base: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every value once for each bracket of its group."""
    wide = brackets.groupBy(*by).agg(F.collect_list(F.struct("name", "lo", "hi", "__pos")).alias("__bs"))
    rows = (lookup(base, checked_broadcast(wide), by, ["__bs"], null_safe=True) if by
            else base.crossJoin(F.broadcast(wide)))
    return rows.select(*by, "__v", F.explode("__bs").alias("__b")).select(*by, "__v", "__b.*")


def _narrowed(base: DataFrame, brackets: DataFrame, by: Sequence[str], most: int, accuracy: int) -> DataFrame:
    """Brackets whose ends moved towards the wanted positions, by one pass over the values.

    The values strictly between the ends are split by a sketch at even shares; the ends become the splitters that the sketch's
    error bound still allows. Repeated values at an end do not hinder: they are counted, not split.
    """
    parts = min(SPLITTERS, accuracy)
    grid = [j / parts for j in range(parts + 1)]
    between = (F.col("__v") > F.col("lo")) & (F.col("__v") < F.col("hi"))
    found = _with_brackets(base, brackets, by).where(F.col("__v") < F.col("hi")).groupBy(*by, "name", "lo", "hi", "__pos").agg(
        F.count_if(F.col("__v") <= F.col("lo")).alias("__before"), F.count_if(between).alias("__mid"),
        F.percentile_approx(F.when(between, F.col("__v")), grid, accuracy).alias("__g"))
    slack = 4.0 / accuracy
    share_lo = (F.floor("__pos") - F.col("__before")) / F.col("__mid") - slack
    share_hi = (F.ceil("__pos") - F.col("__before")) / F.col("__mid") + slack
    split = F.col("__mid") > most
    at_lo, at_hi = F.floor(share_lo * parts).cast("int"), F.ceil(share_hi * parts).cast("int")
    moved = found.select(
        *by, "name", "__pos",
        F.when(split & (share_lo >= 0), F.get("__g", at_lo)).otherwise(F.col("lo")).alias("lo"),
        F.when(split & (share_hi <= 1), F.get("__g", at_hi)).otherwise(F.col("hi")).alias("hi"))
    # a bracket without a value below its upper end has one distinct value
    return lookup(brackets, moved, [*by, "name"], {"__lo": "lo", "__hi": "hi"}, null_safe=True).select(
        *by, "name", "__pos", F.coalesce("__lo", "lo").alias("lo"), F.coalesce("__hi", "hi").alias("hi"))


def _rounds(rows: int, most: int, accuracy: int) -> int:
    """Narrowing rounds after which no bracket of a group of ``rows`` holds more than ``most`` values between its ends."""
    left = max(rows * 10.0 / accuracy, min(rows, 4 * accuracy))
    factor = 10.0 / accuracy + 2.0 / min(SPLITTERS, accuracy)
    if factor >= 1:
        raise ValueError(f"accuracy {accuracy} is too small to narrow a bracket")
    rounds = 0
    while left > most:
        left, rounds = left * factor + 1, rounds + 1
    return rounds


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float],
                    accuracy: int = 50_000, most: int = 1_000_000) -> DataFrame:
    """Quantiles with linear interpolation, exact, without gathering a group in one task.

    A mergeable rank sketch brackets every wanted order statistic; its error bound guarantees the bracket holds it. Brackets are
    narrowed until at most ``most`` values lie between their ends, whatever the size of the group: five thousand million rows need no
    extra pass, each further pass serves about 450 times as many. A last pass counts the rows below the bracket and keeps
    its distinct values. The driver gets the size of the largest group.
    """
    ensure_checkpoint_dir(df.sparkSession)
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull())
    # four times the sketch error; in a small group the bracket is the whole group
    slack = 4.0 / accuracy
    lows = [max(q - slack, 0.0) for q in quantiles.values()]
    highs = [min(q + slack, 1.0) for q in quantiles.values()]
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", lows, accuracy).alias("__lo"),
        F.percentile_approx("__v", highs, accuracy).alias("__hi"), F.min("__v").alias("__min"),
        F.max("__v").alias("__max"))
    entries = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"),
                 F.when(F.col("__n") <= 4 * accuracy, F.col("__min")).otherwise(F.col("__lo")[i]).alias("lo"),
                 F.when(F.col("__n") <= 4 * accuracy, F.col("__max")).otherwise(F.col("__hi")[i]).alias("hi"))
        for i, (name, q) in enumerate(quantiles.items())])
    brackets = sketch.select(*by, "__n", F.explode(entries).alias("__b")).select(*by, "__n", "__b.*")
    brackets = brackets.withColumn("__pos", F.col("q") * (F.col("__n") - 1)).checkpoint()
    largest = brackets.agg(F.max("__n").alias("n")).first().n or 0
    brackets = brackets.select(*by, "name", "__pos", "lo", "hi")
    for _ in range(_rounds(largest, most, accuracy)):
        brackets = _narrowed(base, brackets, by, most, accuracy).checkpoint()
    rows = _with_brackets(base, brackets, by)
    inside = F.col("__v").between(F.col("lo"), F.col("hi"))
    # values below the bracket collapse to one counter row per group and quantile
    counted = (
        rows.where(F.col("__v") <= F.col("hi"))
        .groupBy(*by, "name", "__pos", F.when(inside, F.col("__v")).alias("__x"))
        .agg(F.count(F.lit(1)).alias("__c")))
    w = W.partitionBy(*by, "name").orderBy(F.col("__x").asc_nulls_first())
    counted = counted.withColumn("__to", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    counted = counted.withColumn("__from", F.col("__to") - F.col("__c"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("__from") <= position) & (position < F.col("__to")), F.col("__x")))

    lo, hi = F.floor("__pos"), F.ceil("__pos")
    picked = counted.groupBy(*by, "name", "__pos").agg(at(lo).alias("__a"), at(hi).alias("__z"))
    result = F.col("__a") + (F.coalesce("__z", "__a") - F.col("__a")) * (F.col("__pos") - F.floor("__pos"))
    picked = picked.withColumn("__r", result)
    return picked.groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == name, F.col("__r"))).alias(name) for name in quantiles])
