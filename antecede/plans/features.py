"""Config-driven feature build: every target, every history, one exchange on the player."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from antecede.operators.pit import Prior, opponent_value, strict_prior

NAME = re.compile(r"^[a-z][a-z0-9_]*$")


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """NULL unless the denominator is positive."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def with_flags(df: DataFrame, *, minimum_history: int, history: str = "history_observations",
               completed: str = "completed", target: str = "target_value") -> DataFrame:
    enough = F.col(history) >= minimum_history
    return df.withColumns({
        "has_sufficient_history": enough,
        "is_training_eligible": enough & F.coalesce(F.col(completed), F.lit(False)) & F.col(target).isNotNull(),
    })


@dataclass(frozen=True)
class Target:
    """One stat target. Ratios are (numerator, denominator) columns."""

    name: str
    source: str
    rate: tuple[str, str]
    percentage: tuple[str, str]
    rate_output: str = "rolling_rate"
    percentage_output: str = "rolling_percentage"
    opponent_output: str = "opponent_conceded_rate"


@dataclass(frozen=True)
class FeatureConfig:
    sport: str
    feature_version: str
    targets: Sequence[Target]
    rolling_windows: Sequence[int] = (3, 5, 10, 20)
    aggregations: Sequence[str] = ("mean", "std")
    minimum_history: int = 5
    category_column: str = "category"
    category_window: int = 20
    rate_window: int = 10
    context: Mapping[str, str] = field(default_factory=dict)
    derived: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.targets:
            raise ValueError("at least one target is required")
        for name in [*self.feature_columns, *[t.name for t in self.targets]]:
            if not NAME.match(name):
                raise ValueError(f"not a feature identifier: {name!r}")

    @property
    def feature_columns(self) -> list[str]:
        rolling = [f"rolling_{a}_{n}" for a in self.aggregations for n in self.rolling_windows]
        per_target = [x for t in self.targets for x in (t.rate_output, t.percentage_output)]
        named = ["category_rolling_mean", "category_rolling_n_observations", *per_target, "rest_days",
                 "head_to_head_average", "head_to_head_matches", "head_to_head_win_rate",
                 *[t.opponent_output for t in self.targets], "career_to_date_mean", "history_observations"]
        return list(dict.fromkeys([*rolling, *named, *self.context, *self.derived]))


def by_target(df: DataFrame, config: FeatureConfig) -> DataFrame:
    """One row per source row and target, carrying that target's value and ratio inputs."""
    entries = [
        F.struct(
            F.lit(t.name).alias("stat_target"),
            F.col(t.source).cast("double").alias("target_value"),
            safe_ratio(*t.rate).alias("__rate"),
            safe_ratio(*t.percentage).alias("__pct"),
        )
        for t in config.targets
    ]
    return df.withColumn("__t", F.explode(F.array(*entries))).select(*df.columns, "__t.*")


def build_features(matches: DataFrame, config: FeatureConfig, *, match: str = "match_id",
                   player: str = "player_id", opponent: str = "opponent_id", date: str = "event_date",
                   order: Sequence[str] = ("match_id",), completed: str = "completed",
                   result: str = "is_winner", hot_rows: int | None = None) -> DataFrame:
    """Long by stat_target, one column per feature; eligibility flags last.

    What the opponent concedes is what others scored against it, so the opponent's form is the history
    of rows naming it as opponent: an exchange on the opponent instead of computing every player's
    history a second time for a join. The only thing read off the opponent's own row is whether it
    exists and counts; both rows of a match carry the same date.
    """
    marked = matches.withColumns({"__counts": F.coalesce(F.col(completed), F.lit(False)), "__won": F.col(result).cast("int")})
    marked = opponent_value(marked, match, player, opponent, {"__opponent_counts": "__counts"})
    long = by_target(marked, config)

    own = (player, "stat_target")
    rolling = {f"rolling_{a}_{n}": (a, n) for a in config.aggregations for n in config.rolling_windows}
    rolling["career_to_date_mean"] = ("mean", None)
    n = config.rate_window
    priors = [
        Prior(own, "target_value", rolling, {"history_observations": None}),
        Prior((*own, config.category_column), "target_value",
              {"category_rolling_mean": ("mean", config.category_window)},
              {"category_rolling_n_observations": config.category_window}),
        Prior(own, "__rate", {"__rolling_rate": ("mean", n)}),
        Prior(own, "__pct", {"__rolling_pct": ("mean", n)}),
        Prior((*own, opponent), "target_value", {"head_to_head_average": ("mean", None)}),
        Prior((*own, opponent), "__won", {"head_to_head_win_rate": ("mean", None)},
              {"head_to_head_matches": None}),
    ]
    built = strict_prior(long, priors, anchor=own, date=date, order=order, eligible=completed,
                         rest={"rest_days": own}, hot_rows=hot_rows, hot_by=[player], probe=matches.select(player),
                         probe_share=len(config.targets))
    against = (opponent, "stat_target")
    built = strict_prior(
        built, [Prior(against, "target_value", {"__form": ("mean", n)})], anchor=against, date=date, order=order,
        eligible="__opponent_counts", hot_rows=hot_rows, hot_by=[opponent], probe=matches.select(opponent),
        probe_share=len(config.targets))
    built = built.withColumn("__opponent_form", F.when(F.col("__opponent_counts").isNotNull(), F.col("__form")))

    def pick(source: str, attr: str) -> dict[str, Column]:
        names = dict.fromkeys(getattr(t, attr) for t in config.targets)
        return {
            name: F.when(F.col("stat_target").isin([t.name for t in config.targets if getattr(t, attr) == name]),
                         F.col(source))
            for name in names
        }

    built = built.withColumns({**pick("__rolling_rate", "rate_output"), **pick("__rolling_pct", "percentage_output"),
                               **pick("__opponent_form", "opponent_output")})
    context = {out: F.col(src) for out, src in config.context.items() if out != src}
    derived = {out: F.col(a).cast("double") - F.col(b).cast("double") for out, (a, b) in config.derived.items()}
    if context:
        built = built.withColumns(context)
    if derived:
        built = built.withColumns(derived)
    built = with_flags(built, minimum_history=config.minimum_history, completed=completed)
    return built.select(
        player, match, date, F.lit(config.sport).alias("sport"),
        F.lit(config.feature_version).alias("feature_version"), "stat_target", *config.feature_columns,
        "target_value", "has_sufficient_history", "is_training_eligible")


def feature_json(columns: Sequence[str]) -> Column:
    """The whole vector as one JSON object; missing values stay present as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def expand_json(df: DataFrame, json_column: str, types: Mapping[str, str]) -> DataFrame:
    """Expose configured JSON keys that are not already columns."""
    wanted = {k: t for k, t in types.items() if k not in df.columns}
    if not wanted:
        return df
    schema = ", ".join(f"`{k}` {t}" for k, t in wanted.items())
    parsed = df.withColumn("__json", F.from_json(json_column, schema))
    return parsed.select(*df.columns, *[F.col(f"__json.`{k}`").alias(k) for k in wanted])


def backfill_from_json(df: DataFrame, json_column: str, columns: Mapping[str, str]) -> DataFrame:
    """Typed column if it has a value, else the same key out of the stored JSON vector."""
    values = F.from_json(json_column, "map<string,string>")
    fixed = {
        c: F.coalesce(F.col(c), values[c].try_cast(t)) if c in df.columns else values[c].try_cast(t)
        for c, t in columns.items()
    }
    return df.withColumns(fixed)
