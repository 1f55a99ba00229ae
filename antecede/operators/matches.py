"""Winner/loser source rows to player rows, identifiers, profiles and ingest reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.text import clean, compact_date, nullable_decimal, tolerant_int
from antecede.operators.skew import lookup

# fixed values: days after the tournament start, by round
ROUND_DAYS = {"Q1": -1, "Q2": -1, "Q3": -1, "Q4": -1, "R128": 0, "R64": 1, "R32": 2, "R16": 3, "QF": 4, "SF": 5, "F": 6}

# fixed values: score text marking an unfinished match
UNFINISHED = ["RET", "W/O", "WO", "DEF", "ABN", "ABD"]

# fixed values: stat name and its source suffix after w_ / l_
STATS = {"aces": "ace", "double_faults": "df", "serve_points": "svpt", "first_serves_in": "1stIn",
         "first_serves_won": "1stWon", "second_serves_won": "2ndWon", "service_games": "SvGms",
         "bp_saved": "bpSaved", "bp_faced": "bpFaced"}


def event_date(start: Column, round_name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROUND_DAYS.items() for x in pair])
    return F.date_add(start, F.coalesce(F.try_element_at(table, F.upper(F.trim(round_name))), F.lit(0)))


def is_completed(score: Column, best_of: Column) -> Column:
    """A side reached the sets needed to win; unfinished markers, no score or no format mean no."""
    text = F.trim(F.replace(F.upper(F.coalesce(score, F.lit(""))), F.lit("."), F.lit("")))
    marked = reduce(lambda a, b: a | b, [text.contains(m) for m in UNFINISHED])
    sets = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"^\d+-\d+"))

    def won(group_a: int, group_b: int) -> Column:
        return F.size(F.filter(sets, lambda t: (
            F.regexp_extract(t, r"^(\d+)-(\d+)", group_a).cast("int")
            > F.regexp_extract(t, r"^(\d+)-(\d+)", group_b).cast("int"))))

    needed = F.floor(best_of / 2) + 1
    played = (text != "") & ~marked & (F.size(sets) > 0) & (F.coalesce(best_of, F.lit(0)) != 0)
    return F.coalesce(played & (F.greatest(won(1, 2), won(2, 1)) >= needed), F.lit(False))


def stats_valid(s: dict[str, Column]) -> Column:
    """No negative count and no part larger than its whole; missing values prove nothing."""
    broken = [c < 0 for c in s.values()]
    broken += [s["first_serves_in"] > s["serve_points"], s["aces"] > s["serve_points"],
               s["double_faults"] > s["serve_points"], s["first_serves_won"] > s["first_serves_in"],
               s["bp_saved"] > s["bp_faced"]]
    return ~reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in broken])


def with_parsed(rows: DataFrame) -> DataFrame:
    """Typed helper columns next to the raw text: dates, completion and both stat blocks."""
    typed = {"tourney_day": compact_date("tourney_date"), "match_number": tolerant_int("match_num"),
             "best_of_sets": tolerant_int("best_of")}
    for side in ("w", "l"):
        typed.update({f"{side}__{name}": tolerant_int(f"{side}_{suffix}") for name, suffix in STATS.items()})
    out = rows.withColumns(typed)
    return out.withColumns({
        "event_day": event_date(F.col("tourney_day"), F.coalesce("round", F.lit(""))),
        "completed": is_completed(F.col("score"), F.col("best_of_sets")),
        "w__valid": stats_valid({n: F.col(f"w__{n}") for n in STATS}),
        "l__valid": stats_valid({n: F.col(f"l__{n}") for n in STATS}),
    })


def identified() -> Column:
    """Source row carries a stable match and both players."""
    return (clean("tourney_id").isNotNull() & tolerant_int("match_num").isNotNull()
            & clean("winner_id").isNotNull() & clean("loser_id").isNotNull())


def _side(side: str, match_id: Column) -> Column:
    me, other = ("winner", "loser") if side == "w" else ("loser", "winner")
    far = "l" if side == "w" else "w"
    valid, far_valid = F.col(f"{side}__valid"), F.col(f"{far}__valid")
    stats = [F.when(valid, F.col(f"{side}__{n}")).alias(n) for n in STATS]
    broken = F.when(valid & far_valid, F.col(f"{far}__bp_faced") - F.col(f"{far}__bp_saved"))
    return F.struct(
        match_id.alias("match_id"), F.col("event_day").alias("event_date"), F.col("tourney_day").alias("tourney_date"),
        F.trim("tourney_name").alias("tournament"), clean("surface").alias("surface"), clean("round").alias("round"),
        F.trim(f"{me}_id").alias("player_id"), F.trim(f"{other}_id").alias("opponent_id"),
        F.lit(side == "w").alias("is_winner"), tolerant_int("minutes").alias("minutes"),
        tolerant_int("draw_size").alias("draw_size"), clean("tourney_level").alias("tourney_level"),
        F.col("match_number").alias("match_num"), F.col("best_of_sets").alias("best_of"), clean("score").alias("score"),
        F.col("completed").alias("match_completed"),
        tolerant_int(f"{me}_seed").alias("player_seed"), clean(f"{me}_entry").alias("player_entry"),
        tolerant_int(f"{other}_seed").alias("opponent_seed"), clean(f"{other}_entry").alias("opponent_entry"),
        tolerant_int(f"{me}_rank").alias("player_rank"), tolerant_int(f"{other}_rank").alias("opponent_rank"),
        tolerant_int(f"{me}_rank_points").alias("player_rank_points"),
        tolerant_int(f"{other}_rank_points").alias("opponent_rank_points"),
        nullable_decimal(f"{me}_age").alias("player_age"), *stats, broken.alias("break_points_won"))


def expand_matches(rows: DataFrame, match_id: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Each identified source row becomes exactly two player rows with sides swapped."""
    parsed = with_parsed(rows.where(identified()))
    key = F.col(match_id) if match_id else F.concat_ws("-", F.trim("tourney_id"), F.col("match_number"))
    both = parsed.select(*keep, F.explode(F.array(_side("w", key), _side("l", key))).alias("s"))
    return both.select(*keep, "s.*")


def player_snapshots(rows: DataFrame, order: Sequence[str], tour: str = "ATP") -> DataFrame:
    """Profile of both sides as of the tournament start; within a row the winner counts first."""
    def profile(me: str, position: int) -> Column:
        return F.struct(
            F.trim(f"{me}_id").alias("player_id"), F.trim(f"{me}_name").alias("full_name"), F.lit(tour).alias("tour"),
            clean(f"{me}_hand").alias("hand"), clean(f"{me}_ioc").alias("country"),
            tolerant_int(f"{me}_ht").alias("height_cm"), tolerant_int(f"{me}_rank").alias("rank_position"),
            tolerant_int(f"{me}_rank_points").alias("rank_points"),
            compact_date("tourney_date").alias("profile_as_of"), F.lit(position).alias("side"))
    both = rows.select(*order, F.explode(F.array(profile("winner", 0), profile("loser", 1))).alias("s"))
    return both.select(*order, "s.*").where(F.col("player_id") != "")


def latest_profiles(snapshots: DataFrame, order: Sequence[str]) -> DataFrame:
    """Newest snapshot per player, the later row on equal dates: a mergeable max_by, no sort per player."""
    data = [c for c in snapshots.columns if c not in ("player_id", "side", *order)]
    best = F.max_by(F.struct(*data), F.struct("profile_as_of", *order, "side"))
    return snapshots.groupBy("player_id").agg(best.alias("s")).select("player_id", "s.*")


SIGNATURE = ["tourney_id", "match_num", "tourney_date", "winner_id", "loser_id", "score"]


def unique_match_ids(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row of a key keeps it, exact repeats disappear, other rows get a longer key.

    The owner of a key is a mergeable min_by and comes back by join, so one key repeated without end
    stays splittable. Two different rows under one longer key are an error.
    """
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in SIGNATURE}
    base = F.concat_ws("-", text["tourney_id"], text["match_num"])
    longer = F.concat_ws("-", base, text["tourney_date"], text["winner_id"], text["loser_id"])
    tagged = rows.withColumns({
        "__base": base, "__sig": F.to_json(F.struct(*[text[c].alias(c) for c in SIGNATURE])), "__long": longer})
    columns = [*tagged.columns]
    # one row per (key, signature): repeats collapse before any wider shuffle
    first = tagged.groupBy("__base", "__sig").agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("s")).select("s.*")
    owner = first.groupBy("__base").agg(F.min_by("__sig", F.struct(*order)).alias("__owner"))
    marked = lookup(first, owner, ["__base"], ["__owner"])
    own = F.col("__sig") == F.col("__owner")
    marked = marked.withColumn("unique_id", F.when(own, F.col("__base")).otherwise(F.col("__long")))
    clash = marked.where(~own).groupBy("__long").agg(F.count(F.lit(1)).alias("__n"))
    marked = lookup(marked, clash.where("__n > 1"), {"unique_id": "__long"}, ["__n"])
    checked = F.when(F.col("__n").isNull(), F.col("unique_id")).otherwise(F.raise_error(F.concat(
        F.lit("cannot disambiguate match key "), F.col("__base"))))
    return marked.withColumn("unique_id", checked).select(*rows.columns, "unique_id")


def season_report(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per source file: rows in and out, usable stats, gaps and the date range."""
    ok = identified()
    parsed = with_parsed(rows)
    aces = F.when(F.col("w__valid"), F.col("w__aces")).isNotNull().cast("int") + F.when(
        F.col("l__valid"), F.col("l__aces")).isNotNull().cast("int")
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("source_rows"), (2 * F.count_if(ok)).alias("output_rows"),
        F.sum(F.when(ok, aces).otherwise(0)).alias("non_null_ace_rows"),
        F.count_if(ok & ~F.col("completed")).alias("incomplete_matches"),
        F.count_if(ok & clean("surface").isNull()).alias("null_surface_matches"),
        F.count_if(~ok).alias("invalid_rows"),
        F.sum(F.when(ok, (~F.col("w__valid")).cast("int") + (~F.col("l__valid")).cast("int")).otherwise(0)).alias(
            "invalid_stat_sides"),
        F.min(F.when(ok, F.col("event_day"))).alias("min_event_date"),
        F.max(F.when(ok, F.col("event_day"))).alias("max_event_date"))


def duplicate_report(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows, and rows that repeat the signature of an earlier one, per ``by``; the first in ``order`` is no duplicate.

    Repeats are counted per (``by``, signature) before anything else moves, so one row repeated without end costs one row.
    """
    signature = F.to_json(F.struct(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in SIGNATURE]))
    seen = rows.withColumn("__sig", signature).groupBy(*by, "__sig").agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__at"))
    # every row but the first of each signature; the firsts are counted for the file they stand in
    firsts = seen.groupBy("__sig").agg(F.min_by(F.struct(*by), "__at").alias("f")).groupBy(
        *[F.col(f"f.{c}").alias(c) for c in by]).agg(F.count(F.lit(1)).alias("__kept"))
    out = lookup(seen.groupBy(*by).agg(F.sum("__n").alias("source_rows")), firsts, by, ["__kept"], null_safe=True)
    return out.select(*by, "source_rows", (F.col("source_rows") - F.coalesce("__kept", F.lit(0))).alias("duplicate_rows"))


def season_filter(df: DataFrame, seasons: Sequence[int], tourney: str = "tourney_date", event: str = "event_date") -> DataFrame:
    return df.where(F.year(F.coalesce(tourney, event)).isin(list(seasons)))


def require_fresh(df: DataFrame, season: int, today: dt.date, date: str = "event_date", days: int = 21) -> dt.date | None:
    """Newest date of the current season must be recent; other seasons are exempt."""
    newest = df.agg(F.max(date).alias("d")).first().d
    if season == today.year and (newest is None or (today - newest).days > days):
        raise ValueError(f"season {season} is stale: newest event {newest}, limit {days} days")
    return newest


def player_history(matches: DataFrame, players: DataFrame, name: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """One player's matches with the opponent's name, newest first."""
    p = players.select(F.col("player_id").alias("__p"), F.col("full_name").alias("player"))
    o = players.select(F.col("player_id").alias("__o"), F.col("full_name").alias("opponent"))
    # the one searched player is filtered before the join, so the fact side is reduced by a tiny side
    wanted = p.where(F.lower("player") == name.lower())
    rows = matches.join(wanted, matches["player_id"] == F.col("__p"))
    rows = rows.join(o, F.col("opponent_id") == F.col("__o"), "left").drop("__p", "__o")
    if seasons:
        rows = season_filter(rows, seasons)
    return rows.orderBy(F.col("event_date").desc(), F.col("match_id").desc())
