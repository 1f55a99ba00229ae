"""Every configured feature of a few sampled rows, evaluated again by as-of joins instead of windows.

Shares no code with the window path: each sampled row meets the earlier rows of its player (and those of its opponent) by a
join on ``date <``, a history is the non-null values of one kind, and its last N are found per sampled row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from antecede.operators.quality import close
from antecede.operators.skew import checked_broadcast, lookup
from antecede.plans.features import FeatureConfig

ROW = ["s_match", "s_player"]
KEYS = [*ROW, "stat_target"]
AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "median": F.median}


def _ratio(pair: tuple[str, str]) -> Column:
    above, below = (F.col(c).cast("double") for c in pair)
    return F.when(below > 0, above / below)


def _inputs(config: FeatureConfig) -> list[Column]:
    """What a history row offers to each target: its value and the two ratios."""
    return [c for i, t in enumerate(config.targets) for c in (
        F.col(t.source).cast("double").alias(f"x_value{i}"), _ratio(t.rate).alias(f"x_rate{i}"),
        _ratio(t.percentage).alias(f"x_pct{i}"))]


def _long(pairs: DataFrame, config: FeatureConfig, kinds, order: Sequence[str]) -> DataFrame:
    """One row per pair, target and kind of history that has a value; ``kinds(i)`` maps a kind to its value."""
    items = [F.struct(F.lit(t.name).alias("stat_target"), F.lit(kind).alias("kind"), value.cast("double").alias("v"))
             for i, t in enumerate(config.targets) for kind, value in kinds(i).items()]
    out = pairs.select(*ROW, "x_date", *order, F.explode(F.array(*items)).alias("e"))
    return out.select(*ROW, "x_date", *order, "e.*").where("v IS NOT NULL")


def recompute_features(rows: DataFrame, matches: DataFrame, config: FeatureConfig, *, match: str = "match_id",
                       player: str = "player_id", opponent: str = "opponent_id", date: str = "event_date",
                       order: Sequence[str] = ("match_id",), completed: str = "completed",
                       result: str = "is_winner") -> DataFrame:
    """Features and flags of the rows of ``matches`` named by (match, player) in ``rows``, one row per target.

    ``rows`` is the small side and broadcast behind a count. A sampled row of a hot key may meet very much history: totals
    are mergeable, and of the last-N histories only N rows per sampled row pass the shuffle. NULL keys equal each other, as in
    a window; a NULL opponent has no form. An empty sample gives an empty result.
    """
    sample = lookup(matches, rows.select(match, player).distinct(), [match, player], how="left_semi", null_safe=True)
    sample = sample.select(
        F.col(match).alias("s_match"), F.col(player).alias("s_player"), F.col(opponent).alias("s_opponent"),
        F.col(date).alias("s_date"), F.col(config.category_column).alias("s_category"),
        F.coalesce(F.col(completed), F.lit(False)).alias("s_counts"),
        *[F.col(src).alias(f"c_{out}") for out, src in config.context.items()],
        *[(F.col(a).cast("double") - F.col(b).cast("double")).alias(f"c_{out}") for out, (a, b) in config.derived.items()],
        *[F.col(t.source).cast("double").alias(f"c_target{i}") for i, t in enumerate(config.targets)])
    keys = checked_broadcast(sample.select(*ROW, "s_opponent", "s_date", "s_category"))
    ranks = [f"x_order{i}" for i, _ in enumerate(order)]
    past = matches.select(
        F.col(match).alias("x_match"), F.col(player).alias("x_player"), F.col(opponent).alias("x_opponent"),
        F.col(date).alias("x_date"), F.col(config.category_column).alias("x_category"), F.col(result).alias("x_won"),
        F.coalesce(F.col(completed), F.lit(False)).alias("x_counts"),
        *[F.col(c).alias(r) for c, r in zip(order, ranks)], *_inputs(config))

    own = past.join(keys, F.col("x_player").eqNullSafe(F.col("s_player")) & (F.col("x_date") < F.col("s_date")))
    same_category, met = (F.col(f"x_{c}").eqNullSafe(F.col(f"s_{c}")) for c in ("category", "opponent"))

    def of_player(i: int) -> dict[str, Column]:
        value = F.col(f"x_value{i}")
        return {"own": value, "category": F.when(same_category, value), "rate": F.col(f"x_rate{i}"),
                "pct": F.col(f"x_pct{i}"), "meeting": F.when(met, value), "won": F.when(met, F.col("x_won").cast("int"))}

    # what the opponent conceded: the other side of the opponent's own earlier matches
    faced = past.where("x_counts").select("x_match", "x_player", "x_date", F.col("x_opponent").alias("y_player"), *ranks).join(
        keys, (F.col("x_player") == F.col("s_opponent")) & (F.col("x_date") < F.col("s_date")))
    scored = past.select(F.col("x_match").alias("y_match"), F.col("x_player").alias("y_scorer"),
                         *[F.col(f"x_value{i}") for i, _ in enumerate(config.targets)])
    faced = faced.join(scored, (F.col("x_match") == F.col("y_match")) & (F.col("y_player") == F.col("y_scorer")))
    measured = _long(own.where("x_counts"), config, of_player, ranks).unionByName(
        _long(faced, config, lambda i: {"conceded": F.col(f"x_value{i}")}, ranks))

    def of(kind: str, window: int | None = None) -> Column:
        ok = F.col("kind") == kind
        return F.when(ok if window is None else ok & (F.col("k") <= window), F.col("v"))

    last = {f"rolling_{a}_{n}": AGGREGATES[a](of("own", n)) for a in config.aggregations for n in config.rolling_windows}
    last |= {"category_rolling_mean": F.avg(of("category", config.category_window)),
             "category_rolling_n_observations": F.count(of("category", config.category_window)),
             "__rate": F.avg(of("rate", config.rate_window)), "__pct": F.avg(of("pct", config.rate_window)),
             "__conceded": F.avg(of("conceded", config.rate_window))}
    totals = {"career_to_date_mean": F.avg(of("own")), "history_observations": F.count(of("own")),
              "head_to_head_average": F.avg(of("meeting")), "head_to_head_matches": F.count(of("won")),
              "head_to_head_win_rate": F.avg(of("won"))}
    most = max(*config.rolling_windows, config.category_window, config.rate_window)
    newest = W.partitionBy(*KEYS, "kind").orderBy(F.col("x_date").desc(), *[F.col(r).desc() for r in ranks])
    tail = measured.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most)

    out = sample.withColumn("__t", F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("stat_target"), F.col(f"c_target{i}").alias("target_value"))
        for i, t in enumerate(config.targets)]))).select(*sample.columns, "__t.*")
    out = lookup(out, tail.groupBy(*KEYS).agg(*[c.alias(n) for n, c in last.items()]), KEYS, list(last), null_safe=True)
    out = lookup(out, measured.groupBy(*KEYS).agg(*[c.alias(n) for n, c in totals.items()]), KEYS, list(totals), null_safe=True)
    out = lookup(out, own.groupBy(*ROW).agg(F.max("x_date").alias("__before")), ROW, ["__before"], null_safe=True)
    there = matches.select(F.col(match).alias("s_match"), F.col(player).alias("s_opponent"), F.lit(True).alias("__there"))
    out = lookup(out, there, ["s_match", "s_opponent"], ["__there"])
    out = out.fillna(0, ["history_observations", "category_rolling_n_observations", "head_to_head_matches"])
    out = out.withColumns({"rest_days": F.datediff("s_date", "__before"), "__conceded": F.when(F.col("__there"), F.col("__conceded"))})

    for attr, source in (("rate_output", "__rate"), ("percentage_output", "__pct"), ("opponent_output", "__conceded")):
        for name in dict.fromkeys(getattr(t, attr) for t in config.targets):
            mine = [t.name for t in config.targets if getattr(t, attr) == name]
            out = out.withColumn(name, F.when(F.col("stat_target").isin(mine), F.col(source)))
    enough = F.col("history_observations") >= config.minimum_history
    out = out.withColumns({
        **{c: F.col(f"c_{c}") for c in [*config.context, *config.derived]}, "has_sufficient_history": enough,
        "is_training_eligible": enough & F.col("s_counts") & F.col("target_value").isNotNull()})
    return out.select(F.col("s_match").alias(match), F.col("s_player").alias(player), "stat_target",
                      *config.feature_columns, "target_value", "has_sufficient_history", "is_training_eligible")


def disagreements(built: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``expected`` with ``wrong``: the names of the columns in which ``built`` differs. A row that was not built is wrong in
    ``missing`` as well. Numbers agree within the tolerance of :func:`close`, everything else exactly."""
    names = [c for c in expected.columns if c not in keys]
    both = lookup(expected, built.withColumn("__built", F.lit(True)), keys,
                  {**{f"__b_{c}": c for c in names}, "__built": "__built"}, null_safe=True)

    def same(c: str) -> Column:
        if isinstance(expected.schema[c].dataType, T.NumericType):
            return close(F.col(f"__b_{c}").cast("double"), F.col(c).cast("double"))
        return F.col(f"__b_{c}").eqNullSafe(F.col(c))

    wrong = F.array_compact(F.array(F.when(F.col("__built").isNull(), F.lit("missing")),
                                    *[F.when(~same(c), F.lit(c)) for c in names]))
    return both.select(*expected.columns, wrong.alias("wrong"))
