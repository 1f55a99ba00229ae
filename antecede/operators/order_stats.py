"""Medians of everything before a day, for keys of any size, by descending through ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from antecede.operators.ranks import global_rank
from antecede.operators.skew import lookup
from antecede.session import ensure_checkpoint_dir

#: A level of the descent tells this many branches apart.
BRANCHES_LOG = 4


def prior_medians(points: DataFrame, asked: DataFrame, keys: Sequence[str], day: str, value: str, out: str) -> DataFrame:
    """(keys, day, ``out``): for every key and day in ``asked`` the median of ``points`` of that key with an earlier day.

    Both frames have the keys and ``day`` (an integer); ``points`` has ``value``, never NULL. A day with nothing before it has NULL.

    Values are numbered within their key. A question starts with the places of the two middle values among all earlier ones and
    descends: per level the earlier values are counted in each of sixteen ranges of ranks, and the range that holds the place is entered.
    Points are first summed to (key, range, day), so a window never holds more rows than there are days, however many rows
    a key has; the levels are the logarithm of a key's distinct values.
    """
    ensure_checkpoint_dir(points.sparkSession)
    fan = 1 << BRANCHES_LOG
    pts = points.groupBy(*keys, day, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = global_rank(pts.select(*keys, "__v").distinct(), keys, ["__v"], "__place")
    ranked = ranked.select(*keys, "__v", (F.col("__place") - 1).alias("__rank")).checkpoint()
    highest = ranked.agg(F.max("__rank")).first()[0] or 0  # one number
    pts = lookup(pts, ranked, [*keys, "__v"], ["__rank"], null_safe=True).select(*keys, day, "__rank", "__n").checkpoint()

    branches = [f"__b{i}" for i in range(fan)]
    days = pts.groupBy(*keys, day).agg(F.sum("__n").alias("__n")).unionByName(asked.select(*keys, day).distinct().withColumn("__n", F.lit(None).cast("long")))
    before = W.partitionBy(*keys).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    total = days.withColumn("__total", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__n").isNull())
    middle = F.explode(F.array(F.struct(F.lit(0).alias("__which"), F.expr("(__total - 1) div 2").alias("__k")),
                               F.struct(F.lit(1).alias("__which"), F.expr("__total div 2").alias("__k"))))
    questions = total.where("__total > 0").select(*keys, day, middle.alias("__m")).select(*keys, day, "__m.*", F.lit(0).cast("long").alias("__range"))

    levels = max(1, -(-int(highest).bit_length() // BRANCHES_LOG))
    for level in reversed(range(levels)):
        digit = F.shiftright("__rank", BRANCHES_LOG * level).bitwiseAND(fan - 1)
        spread = pts.groupBy(*keys, F.shiftright("__rank", BRANCHES_LOG * (level + 1)).alias("__range"), day).agg(
            *[F.sum(F.when(digit == i, F.col("__n"))).alias(b) for i, b in enumerate(branches)])
        both = spread.unionByName(questions, allowMissingColumns=True)
        earlier = W.partitionBy(*keys, "__range").orderBy(day).rangeBetween(W.unboundedPreceding, -1)
        counts = [F.coalesce(F.sum(b).over(earlier), F.lit(0)) for b in branches]
        seen = both.select(*keys, day, "__which", "__k", "__range", F.array(*counts).alias("__counts")).where(F.col("__which").isNotNull())
        # running totals: the first branch whose total passes k holds the place
        upto = F.transform("__counts", lambda _, i: F.aggregate(F.slice("__counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
        chosen = seen.withColumn("__upto", upto)
        chosen = chosen.withColumn("__at", F.size(F.filter("__upto", lambda t: t <= F.col("__k"))))
        questions = chosen.select(*keys, day, "__which", (F.col("__k") - F.when(F.col("__at") > 0, F.get("__upto", F.col("__at") - 1)).otherwise(0)).alias("__k"),
                                  (F.col("__range") * fan + F.col("__at")).alias("__range"))
    found = lookup(questions, ranked, {**{k: k for k in keys}, "__range": "__rank"}, ["__v"], null_safe=True)
    return found.groupBy(*keys, day).agg(F.avg("__v").alias(out))
