"""The denormalised report of predictions, lines and outcomes, and the read queries over it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.functions.text import model_family, title_label, version_stem
from antecede.operators.latest import latest_by
from antecede.operators.skew import checked_broadcast, lookup
from antecede.session import ensure_checkpoint_dir

REAL, DEMO = "real", "demo"


def is_demo(player: str = "player_id") -> Column:
    """Exact prefix: in LIKE the underscore would match any character."""
    return F.col(player).startswith("demo_")


def outcome(prop: str, columns: Mapping[str, str]) -> Column:
    """The stat column named by the prop key; an unknown key has no outcome."""
    picks = [F.when(F.col(prop) == key, F.col(c).cast("double")) for key, c in columns.items()]
    return F.coalesce(*picks)


def known_outcome(prop: str, columns: Mapping[str, str], event: str, as_of: dt.date) -> Column:
    return F.when(F.col(event) <= F.lit(as_of), outcome(prop, columns))


def edge_columns(prediction: str = "prediction", line: str = "line") -> dict[str, Column]:
    edge = F.col(prediction) - F.col(line)
    return {
        "edge": edge,
        "normalized_edge": edge / F.nullif(F.col("upperci") - F.col("lowerci"), F.lit(0.0)),
        "side": F.when(F.col(line).isNotNull(), F.when(F.col(prediction) >= F.col(line), "Over").otherwise("Under")),
    }


def latest_features(features: DataFrame) -> DataFrame:
    return latest_by(features, ["match_id", "player_id", "stat_target"],
                     F.struct("created_at", "feature_version"), ["feature_version", "rolling_average"])


def latest_injuries(injuries: DataFrame) -> DataFrame:
    return latest_by(injuries, ["player_id", "event_date"], F.struct("captured_at", "injury_id"), ["status"])


#: Columns that only one optional side of the report brings.
OPPONENT_COLUMNS = ("opponent", "matchup")
STATUS_COLUMNS = ("status",)
FEATURE_COLUMNS = ("feature_version", "rolling_average")
LINE_COLUMNS = ("provider", "provider_event_id", "book", "line", "over_price", "under_price", "captured_at")
PRICED_COLUMNS = ("edge", "normalized_edge", "side")


def fact_report(predictions: DataFrame, players: DataFrame, props: DataFrame, matches: DataFrame, odds: DataFrame,
                features: DataFrame, injuries: DataFrame, *, outcomes: Mapping[str, str], as_of: dt.date,
                columns: Sequence[str] | None = None) -> DataFrame:
    """One row per prediction and matching line; predictions without a line keep one row.

    Inner: player, prop, match. Left: opponent, newest features, lines, newest status. Names and status meet the match rows,
    of which there is one per player and match; then predictions, features and lines, which share (match_id, player_id), are
    joined on it, the lines last, as they alone multiply rows. With ``columns`` only these are returned, and left sides that
    bring none of them are not joined: without any column of a line there is one row per prediction.
    """
    def wanted(names: Sequence[str]) -> bool:
        return columns is None or any(c in columns for c in names)

    stats = sorted(set(outcomes.values()))
    rows = matches.select("match_id", "player_id", "event_date", "tournament", "surface", "opponent_id", *stats)
    rows = lookup(rows, players, ["player_id"], {"player": "full_name", "tour": "tour"}, how="inner")
    brought = ["event_date", "tournament", "surface", "player", "tour", *stats]
    if wanted(OPPONENT_COLUMNS):
        rows = lookup(rows, players, {"opponent_id": "player_id"}, {"opponent": "full_name"})
        brought.append("opponent")
    if wanted(STATUS_COLUMNS):
        rows = lookup(rows, latest_injuries(injuries), ["player_id", "event_date"], ["status"])
        brought.append("status")
    # a handful of keys: without the checked broadcast all facts would shuffle onto them
    facts = lookup(predictions, checked_broadcast(props), {"prop_type": "prop_key"}, {"__label": "display_label"}, how="inner")
    facts = lookup(facts, rows, ["match_id", "player_id"], brought, how="inner")
    if wanted(FEATURE_COLUMNS):
        facts = lookup(facts, latest_features(features),
                       {"match_id": "match_id", "player_id": "player_id", "prop_type": "stat_target"}, FEATURE_COLUMNS)
    if wanted(LINE_COLUMNS + PRICED_COLUMNS):
        facts = lookup(facts, odds, ["match_id", "player_id", "prop_type"], LINE_COLUMNS).withColumns(edge_columns())
    if "opponent" in facts.columns:
        facts = facts.withColumn("matchup", F.concat(F.col("player"), F.lit(" vs "), F.coalesce("opponent", F.lit("TBD"))))
    facts = facts.withColumns({
        "prop_label": F.coalesce("__label", title_label("prop_type")),
        "actual_value": known_outcome("prop_type", outcomes, "event_date", as_of),
        "is_demo": is_demo(), "data_mode": F.when(is_demo(), DEMO).otherwise(REAL)})
    facts = facts.withColumns({"prediction_error": F.col("actual_value") - F.col("prediction"),
                               "signed_error": F.col("prediction") - F.col("actual_value")})
    return facts.drop("__label", *stats) if columns is None else facts.select(*columns)


# --- filters ----------------------------------------------------------------------------------------

def only(df: DataFrame, mode: str | None = None, **equals: str | None) -> DataFrame:
    """Optional equality filters; ``prop_type`` compares without case; None means no filter."""
    if mode is not None:
        if mode not in (REAL, DEMO):
            raise ValueError("mode must be 'real' or 'demo'")
        df = df.where(F.col("data_mode") == mode)
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.lower(name) == value.lower() if name == "prop_type" else F.col(name) == value)
    return df


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.where(text.contains(term.lower()))


# --- queries ----------------------------------------------------------------------------------------

def overview(fact: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Headline counts. Each distinct count is the row count of a coarser group, so rows are never multiplied.

    The report is read once, down to a row per prediction and book, which is stored; both kinds of groups start from there.
    """
    ensure_checkpoint_dir(fact.sparkSession)
    market_keys = ["match_id", "player_id", "prop_type"]
    stored = fact.groupBy(*market_keys, "prediction_id", "book").agg(
        F.max(F.abs("normalized_edge")).alias("edge"), F.max("rolling_average").alias("ra"),
        F.max("predictiontimestamp").alias("ts")).checkpoint()
    pred = stored.groupBy("prediction_id", *market_keys).agg(F.max("edge").alias("edge"), F.max("ra").alias("ra"), F.max("ts").alias("ts"))
    market = pred.groupBy("match_id", "player_id", "prop_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("edge") >= threshold).alias("e"), F.max("ra").alias("ra"),
        F.max("ts").alias("ts"))
    match = market.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.count("ra").alias("f"),
        F.max("ts").alias("ts"))
    zero = F.lit(0).cast("long")
    counts = match.agg(
        F.coalesce(F.sum("m"), zero).alias("active_prop_markets"),
        F.coalesce(F.sum("n"), zero).alias("predictions_generated"),
        F.coalesce(F.sum("e"), zero).alias("value_edges_found"), F.count(F.lit(1)).alias("match_rows"),
        F.coalesce(F.sum("f"), zero).alias("feature_rows"), F.max("ts").alias("latest_prediction_timestamp"))
    lines = stored.select(*market_keys, "book").distinct().agg(F.count(F.lit(1)).alias("market_rows"))
    return counts.crossJoin(F.broadcast(lines))  # one row each


def top_edges(fact: DataFrame, n: int = 8) -> DataFrame:
    return fact.orderBy(F.abs("normalized_edge").desc_nulls_last(), "prediction_id", "book", "captured_at", "line",
                        "over_price").limit(n)


def predictions_page(fact: DataFrame, n: int = 200) -> DataFrame:
    return fact.orderBy(F.col("event_date").desc(), F.abs("normalized_edge").desc_nulls_last(), "player",
                        "prediction_id", "book", "captured_at", "line", "over_price").limit(n)


def matches_on(fact: DataFrame, day: dt.date) -> DataFrame:
    return fact.where(F.col("event_date") == F.lit(day)).select("matchup", "event_date", "tournament", "surface").distinct()


def model_versions(fact: DataFrame) -> DataFrame:
    """Distinct predictions and first/last use per version; lines fan out, so predictions collapse first."""
    keys = ["modelversion", "sport", "prop_type", "prop_label"]
    one = fact.groupBy(*keys, "prediction_id").agg(F.min("predictiontimestamp").alias("a"),
                                                   F.max("predictiontimestamp").alias("z"))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("prediction_count"), F.min("a").alias("first_seen"),
                                  F.max("z").alias("last_seen"))


def accuracy_by_run(predictions: DataFrame, matches: DataFrame, metric_log: DataFrame, props: DataFrame, *,
                    outcomes: Mapping[str, str]) -> DataFrame:
    """Accuracy per version of the newest backtest run, next to its baseline and interval diagnostics."""
    runs = predictions.where(F.col("modelversion").contains("_backtest_"))
    newest = F.broadcast(runs.agg(F.max("predictiontimestamp").alias("run_timestamp")))
    rows = runs.where(~is_demo()).join(newest, F.col("predictiontimestamp") == F.col("run_timestamp"))
    stats = sorted(set(outcomes.values()))
    rows = lookup(rows, matches, ["match_id", "player_id"], stats, how="inner")
    rows = rows.withColumn("actual", outcome("prop_type", outcomes)).where("actual IS NOT NULL")
    rows = rows.withColumn("err", F.col("prediction") - F.col("actual"))
    both = F.col("lowerci").isNotNull() & F.col("upperci").isNotNull()
    in_fold = F.col("fold_number") > 0
    keys = ["modelversion", "sport", "prop_type", "run_timestamp"]
    # folds per version are few: collapse to (version, fold) first, then to version
    part = rows.groupBy(*keys, "fold_number").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(both).alias("i"), F.sum(F.abs("err")).alias("ae"),
        F.sum(F.col("err") * F.col("err")).alias("se"), F.sum("err").alias("e"),
        F.count_if(both & F.col("actual").between(F.col("lowerci"), F.col("upperci"))).alias("c"),
        F.min(F.when(in_fold, F.col("fold_cutoff_date"))).alias("first_cutoff"),
        F.max(F.when(in_fold, F.col("fold_test_end_date"))).alias("last_test_end"))
    total = F.sum("n")
    out = part.groupBy(*keys).agg(
        total.alias("scored_rows"), F.sum("i").alias("interval_scored_rows"), F.count_if(in_fold).alias("fold_count"),
        F.min("first_cutoff").alias("first_cutoff"), F.max("last_test_end").alias("last_test_end"),
        (F.sum("ae") / total).alias("mae"), F.sqrt(F.sum("se") / total).alias("rmse"),
        (F.sum("e") / total).alias("mean_bias"), F.try_divide(F.sum("c"), F.sum("i")).alias("interval_coverage"))
    out = out.withColumn("model_family", model_family("modelversion"))
    peers = W.partitionBy("sport", "prop_type")  # one row per version
    out = out.withColumn("baseline_mae", F.max(F.when(F.col("model_family") == "baseline", F.col("mae"))).over(peers))
    gain = F.try_divide(F.col("baseline_mae") - F.col("mae"), F.col("baseline_mae")) * 100.0
    out = out.withColumns({
        "mae_improvement_over_baseline": F.when(F.col("model_family") == "baseline", 0.0).otherwise(gain),
        "stem": version_stem("modelversion")})
    log = metric_log.join(newest.withColumnRenamed("run_timestamp", "__run"), F.col("run_timestamp") == F.col("__run"))
    pooled = log.where("fold_number = 0").groupBy("modelversion", "sport", "stat_target").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("metric_value"))).alias(m)
        for m in ("interval_crossing_count", "interval_repair_count")])
    out = lookup(out, pooled, {"stem": "modelversion", "sport": "sport", "prop_type": "stat_target"},
                 ["interval_crossing_count", "interval_repair_count"])
    out = lookup(out, checked_broadcast(props), {"prop_type": "prop_key"}, {"__label": "display_label"})
    out = out.withColumn("prop_label", F.coalesce("__label", title_label("prop_type")))
    return out.drop("baseline_mae", "stem", "__label")


def display_order(accuracy: DataFrame) -> DataFrame:
    place = F.when(F.col("model_family") == "baseline", 0).when(F.col("model_family") == "GBM", 1).when(
        F.col("model_family") == "ensemble", 2).otherwise(3)
    return accuracy.orderBy("prop_type", place, "modelversion")


def player_trend(fact: DataFrame, player_id: str, stat: str, known_stats: Sequence[str], mode: str = REAL,
                 model_version: str | None = None) -> DataFrame:
    """One player's matches for the most recently used model: the newest line per match."""
    if stat.lower() not in known_stats:
        raise ValueError("stat must be a supported prop key")
    rows = only(fact, mode, player_id=player_id, prop_type=stat, modelversion=model_version)
    used = rows.groupBy("modelversion").agg(F.max("predictiontimestamp").alias("ts"))
    chosen = F.broadcast(used.agg(F.max_by("modelversion", F.struct("ts", "modelversion")).alias("__chosen")))
    rows = rows.join(chosen, F.col("modelversion") == F.col("__chosen"))
    # captured newest first, then book, both with missing values last
    ranked = F.struct(F.col("captured_at").isNull(), -F.unix_micros(F.col("captured_at").cast("timestamp")),
                      F.col("book").isNull(), "book", "line", "over_price")
    best = rows.groupBy("match_id").agg(F.min_by(F.struct(
        "event_date", "opponent", F.col("actual_value").alias("value"), "rolling_average",
        F.col("line").alias("posted_line")), ranked).alias("s"))
    return best.select("match_id", "s.*").orderBy("event_date", "match_id")


def market_comparison(predictions: DataFrame, matches: DataFrame, odds: DataFrame, outcomes: Mapping[str, str]) -> DataFrame:
    """Pre-event line pairs and those with a known completed outcome, plus their providers."""
    stats = sorted(set(outcomes.values()))
    real = predictions.where(~is_demo()).select("prediction_id", "match_id", "player_id", "prop_type")
    rows = lookup(real, matches, ["match_id", "player_id"], ["event_date", "match_completed", *stats], how="inner")
    lines = odds.where((F.col("provider") != "demo") & F.col("line").isNotNull())
    rows = lookup(rows, lines, ["match_id", "player_id", "prop_type"], ["provider", "book", "captured_at"], how="inner")
    rows = rows.where(F.to_date("captured_at") <= F.col("event_date"))
    known = F.coalesce("match_completed", F.lit(False)) & outcome("prop_type", outcomes).isNotNull()
    pairs = rows.groupBy("prediction_id", "provider", "book", "captured_at").agg(F.max(known).alias("known"))
    by_provider = pairs.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("k"))
    names = F.array_sort(F.collect_set(F.when(F.col("k") > 0, F.col("provider"))))  # one entry per provider
    zero = F.lit(0).cast("long")
    return by_provider.agg(
        F.coalesce(F.sum("n"), zero).alias("prediction_line_pairs"),
        F.coalesce(F.sum("k"), zero).alias("known_result_pairs"), F.coalesce(F.sum("k"), zero).alias("paired_rows"),
        F.array_join(names, ",").alias("providers"))


def odds_results(odds: DataFrame, matches: DataFrame, players: DataFrame, sources: DataFrame, *, tour: str,
                 outcomes: Mapping[str, str]) -> DataFrame:
    """Lines anchored on verified results, whether or not anything predicted them.

    Names and sources meet the match rows; the lines, of which there are most, are joined last and moved once.
    """
    stats = sorted(set(outcomes.values()))
    rows = lookup(matches, players.where(F.col("tour") == tour), ["player_id"], {"player": "full_name"}, how="inner")
    rows = lookup(rows, players, {"opponent_id": "player_id"}, {"opponent": "full_name"}, how="inner")
    rows = lookup(rows, sources, ["match_id"], ["final_score", "source_url"], how="inner")
    out = lookup(odds, rows, ["match_id", "player_id"],
                 ["event_date", "tournament", "is_winner", *stats, "final_score", "source_url", "player", "opponent"], how="inner")
    return out.withColumn("actual_value", outcome("prop_type", outcomes)).drop(*stats)


def line_search(fact: DataFrame, term: str, descending: bool = True) -> DataFrame:
    """Rows with a line whose text contains the term, by normalised edge; a missing edge counts as lowest."""
    rows = search(fact.where("line IS NOT NULL"), term, ["player", "matchup", "prop_label", "book", "tournament"])
    edge = F.col("normalized_edge")
    return rows.orderBy(edge.desc_nulls_last() if descending else edge.asc_nulls_first(), "prediction_id", "book",
                        "captured_at", "line")


def prop_options(props: DataFrame, observed: DataFrame) -> DataFrame:
    """Dictionary keys and keys seen in data, each once."""
    return props.select("prop_key").union(observed.select(F.col("prop_type").alias("prop_key"))).distinct()


def prop_rows(fact: DataFrame) -> DataFrame:
    """Display shape: numbers stay null, the side defaults to Over."""
    numbers = ["line", "prediction", "lowerci", "upperci", "edge", "normalized_edge", "over_price", "under_price",
               "actual_value", "prediction_error"]
    return fact.select("prediction_id", "player", "matchup", "prop_label", *[F.col(c).cast("double").alias(c) for c in numbers],
                       F.coalesce("side", F.lit("Over")).alias("side"), "book", "is_demo")


def paired_totals(odds: DataFrame, results: DataFrame) -> DataFrame:
    """Resolved and open line counts, and whether the resolved ones equal the rows the report shows."""
    counts = odds.agg(F.count_if(F.col("match_id").isNotNull()).alias("paired_rows"),
                      F.count_if(F.col("match_id").isNull()).alias("unresolved_rows"))
    visible = results.agg(F.count(F.lit(1)).alias("visible_rows"))
    return counts.crossJoin(F.broadcast(visible)).withColumn("consistent", F.col("paired_rows") == F.col("visible_rows"))


def version_census(predictions: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Stored non-demo rows of the versions about to be written; any row means refuse."""
    return predictions.where(F.col("modelversion").isin(list(versions)) & ~is_demo()).groupBy("modelversion").agg(
        F.count(F.lit(1)).alias("rows"))


def expected_versions(targets: Sequence[str], families: Sequence[str] = ("baseline", "gbm", "ensemble")) -> list[str]:
    return [f"{family}_v1_{target}" for target in targets for family in families]


def importance_summary(log: DataFrame, n: int = 15) -> DataFrame:
    """Mean gain and splits over quantiles, strongest first."""
    out = log.groupBy("feature_name").agg(F.avg("importance_gain").alias("mean_gain"), F.avg("importance_split").alias("mean_split"))
    return out.orderBy(F.col("mean_gain").desc(), F.col("mean_split").desc(), "feature_name").limit(n)


def rank_importance(log: DataFrame) -> DataFrame:
    w = W.partitionBy("quantile").orderBy(F.col("importance_gain").desc(), "feature_index")
    return log.withColumn("importance_rank", F.row_number().over(w))  # one row per feature
