"""Scans of stored tables; filters and columns are pushed to the files, partitions are pruned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.operators.skew import lookup
from antecede.plans.features import backfill_from_json
from antecede.plans.report import is_demo


def match_history(matches: DataFrame, players: DataFrame, tour: str | None = "ATP",
                  profile: Mapping[str, str] | None = None) -> DataFrame:
    """Real player-match facts of one tour with profile columns; a missing start date is the event date."""
    known = players if tour is None else players.where(F.col("tour") == tour)
    rows = matches.where(~is_demo())
    if "tourney_date" in rows.columns:
        rows = rows.withColumn("tourney_date", F.coalesce("tourney_date", "event_date"))
    return lookup(rows, known, ["player_id"], dict(profile or {}), how="inner")


def read_features(spark: SparkSession, path: str, sport: str, feature_version: str, stat_target: str) -> DataFrame:
    """Real rows of one (sport, version, target)."""
    rows = spark.read.parquet(path)
    wanted = (F.col("sport") == sport) & (F.col("feature_version") == feature_version) & (F.col("stat_target") == stat_target)
    return rows.where(wanted & ~is_demo())


def read_features_backfilled(spark: SparkSession, path: str, sport: str, feature_version: str, stat_target: str,
                             columns: Mapping[str, str], json_column: str = "feature_values") -> DataFrame:
    """As above, with typed columns completed out of the stored JSON vector."""
    return backfill_from_json(read_features(spark, path, sport, feature_version, stat_target), json_column, columns)


def member_predictions(predictions: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Rows of the listed versions as one long frame; a version without rows simply has none."""
    rows = predictions.where(F.col("modelversion").isin(list(versions)) & ~is_demo())
    return rows.select("player_id", "match_id", F.col("modelversion").alias("member"), "prediction", "lowerci", "upperci")
