"""Mixing sources to target weights: certain whole copies, then Pareto order sampling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Cells into which the ranks of a stratum fall; only the cell that holds the last taken rank is sorted.
CELLS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, NULL last, get the weights in turn. Together they are to have ``share`` of all
    sizes, by weight; none gets over ``most`` times its size, and what it can't take goes to the others
    by weight. The level at which no further source is full solves that at once: sources fill up in
    order of their limit per unit of weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    leveled = limits.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn(
        "level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))  # the first such level is the one
    final = F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("final", final).select(
        "source", "source_size", F.least("limit", F.coalesce(F.col("final") * F.col("weight"), F.col("limit"))).alias("target"))


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the key alone: reruns and retried tasks agree."""
    digits = F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
        source: str = "source", text: str = "text", salt: str = "mix", carry: bool = False) -> DataFrame:
    """(id, size, source, source_size, target, copies) per row: how often the mix takes each document, whole; ``carry`` adds it as a struct ``row``.

    Every document of a source is expected ``target / source_size`` times. The whole part of that is
    certain; the rest p is drawn by Pareto order sampling: documents in order of the odds of their random number
    over the odds of p, of which a fixed number is taken. To come near the target in words, not only in
    documents, the numbers are fixed per stratum of like sizes (within a fifth), largest first, each making
    up for what rounding cost the ones before.

    The rank where a stratum ends is found by counts over cells of the order, so only one cell of a stratum
    is ever sorted: a source with a third of all rows costs no single task.

    NULL, empty and wordless texts have size 0 and are never taken beyond the certain copies. NULL is a source of its own. Rows
    of one id share a random number; equal ones are ranked by size. An empty table gives an empty
    result; other columns are ignored.
    """
    whole = [F.struct("*").alias("row")] if carry else []
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *whole), "mix")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    aims = aims.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    aims = stored(aims.withColumn("certain", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("certain")), "mix")
    bits = F.length(F.bin("size"))
    # size down to its three leading bits
    stratum = F.when(F.col("size") < 4, F.col("size")).otherwise(bits * 8 + F.expr("size >> greatest(length(bin(size)) - 3, 0)"))
    u, p = uniform(F.col("id"), salt), F.col("p")
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).drop(aims["source"]).withColumn("stratum", stratum.cast("int")).withColumn(
        "odds", F.when((p > 0) & (F.col("size") > 0), odds)).withColumn("cell", F.floor(F.col("odds") / (1 + F.col("odds")) * CELLS).cast("int"))
    cells = ranked.where("odds IS NOT NULL").groupBy("source", "stratum", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("p").alias("p"))
    strata = cells.groupBy("source", "stratum").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.first("p").alias("p"))
    plan = strata.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("stratum", "n", "words", "p")), asc=False).alias("all"))
    plan = plan.select("source", F.explode(F.aggregate(
        "all", F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<stratum:int,take:bigint>>").alias("takes")),
        _serve, lambda acc: acc["takes"])).alias("t")).select("source", "t.*")
    upto = Window.partitionBy("source", "stratum").orderBy("cell")
    last = cells.withColumn("upto", F.sum("n").over(upto)).join(
        plan.select(F.col("source").alias("s"), F.col("stratum").alias("t"), "take"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t"))).where("upto >= take AND upto - n < take").select(
        "s", "t", F.col("cell").alias("last"), (F.col("take") - F.col("upto") + F.col("n")).alias("of_last"))
    if carry:
        last = F.broadcast(last)  # a row per source and stratum, so that whole rows stay where they are
    placed = ranked.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t")), "left").drop("s", "t")
    edge = placed.where("cell = last")
    rank = F.row_number().over(Window.partitionBy("source", "stratum").orderBy("odds", "id", "size", *[F.xxhash64("row") for _ in whole]))
    drawn = placed.where("NOT coalesce(cell = last, false)").withColumn("drawn", F.coalesce(F.col("cell") < F.col("last"), F.lit(False))).unionByName(
        edge.withColumn("drawn", rank <= F.col("of_last")))
    copies = (F.col("certain") + F.col("drawn").cast("long")).alias("copies")
    return drawn.select("id", "size", "source", "source_size", "target", copies, *["row" for _ in whole])


def _serve(acc: Column, x: Column) -> Column:
    """Take the number of documents of this stratum whose words come nearest to its part and what is owed."""
    due = acc["owed"] + x["words"] * x["p"]
    mean = x["words"] / x["n"]
    take = F.least(F.greatest(F.floor(due / mean + F.lit(0.5)), F.lit(0)), x["n"]).cast("bigint")
    return F.struct((due - take * mean).alias("owed"),
                    F.concat(acc["takes"], F.array(F.struct(x["stratum"].alias("stratum"), take.alias("take")))).alias("takes"))
