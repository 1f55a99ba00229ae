"""Price-line snapshots: layouts, quarantine, Over/Under pivot, identity and fixture resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.text import (
    clean, decimal_or_null, fold_case, name_aliases, normalise_name, prop_key, side_of, tour_label, utc_timestamp)
from antecede.operators.sinks import kept_copy
from antecede.operators.skew import checked_broadcast, lookup

# fixed values: the two accepted layouts
RAW_COLUMNS = ["captured_at", "fixture_id", "league", "tournament", "start_date", "home_player", "away_player",
               "sportsbook", "market_id", "market", "player_id", "selection", "normalized_selection", "points",
               "price", "odds_id"]
PIVOT_COLUMNS = ["captured_at", "fixture_id", "league", "tournament", "start_date", "home_player", "away_player",
                 "book", "market_id", "market", "provider_player_name", "provider_player_id", "normalized_selection",
                 "line", "is_main", "over_price", "under_price", "over_odds_id", "under_odds_id"]
# fixed values: columns that the raw layout may have besides
OPTIONAL_COLUMNS = ["player_name", "selection_player", "participant", "selection_line"]


def detect_layout(columns: Sequence[str]) -> str:
    """pivot wins when its columns are present; otherwise raw; otherwise an error naming both gaps."""
    pivot_gap = sorted(set(PIVOT_COLUMNS) - set(columns))
    raw_gap = sorted(set(RAW_COLUMNS) - set(columns))
    if not pivot_gap:
        return "pivot"
    if not raw_gap:
        return "raw"
    raise ValueError(f"unknown snapshot layout: raw lacks {raw_gap}, pivot lacks {pivot_gap}")


def pivot_to_sides(df: DataFrame, shared: Sequence[str], over: dict[str, str], under: dict[str, str],
                   blank: Sequence[str]) -> DataFrame:
    """Two rows per input; a side whose ``blank`` columns are all empty is dropped.

    ``over`` and ``under`` map output columns to that side's source columns.
    """
    def side(name: str, columns: dict[str, str]) -> Column:
        return F.struct(F.lit(name).alias("side"), *[F.col(src).alias(out) for out, src in columns.items()])

    both = df.select(*shared, F.explode(F.array(side("over", over), side("under", under))).alias("s"))
    out = both.select(*shared, "s.*")
    present = F.coalesce(*[clean(F.col(c).cast("string")) for c in blank]).isNotNull()
    return out.where(present)


def to_raw_layout(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Either layout as raw rows with a ``side``; ``keep`` names ordering columns to carry."""
    if detect_layout(df.columns) == "pivot":
        shared = [*keep, "captured_at", "fixture_id", "league", "tournament", "start_date", "home_player", "away_player",
                  "market_id", "market"]
        renamed = df.select("*", F.col("book").alias("sportsbook"), F.col("provider_player_id").alias("player_id"),
                            F.col("provider_player_name").alias("player_name"), F.col("line").alias("points"))
        out = pivot_to_sides(renamed, [*shared, "sportsbook", "player_id", "player_name", "points"],
                             {"price": "over_price", "odds_id": "over_odds_id"},
                             {"price": "under_price", "odds_id": "under_odds_id"}, ["price", "odds_id"])
        return out.withColumns({"selection": F.initcap("side"), "normalized_selection": F.col("side"),
                                "selection_line": F.col("points"), "selection_player": F.lit(None).cast("string"),
                                "participant": F.lit(None).cast("string")})
    have = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    out = df.select(*keep, *RAW_COLUMNS, *have)
    out = out.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL_COLUMNS if c not in have})
    return out.withColumn("side", side_of(F.col("selection_line"), F.col("normalized_selection"), F.col("selection")))


def selected_player(df_has_side: str = "side") -> Column:
    """Explicit name, else the home or away name equal to the selection, else the one inside it, else blank."""
    text = F.concat_ws(" ", F.coalesce("selection", F.lit("")), F.coalesce("normalized_selection", F.lit("")))
    inside = normalise_name(text)
    selection = normalise_name("selection")

    def same(c: str) -> Column:
        return F.when(clean("selection").isNotNull() & F.col(df_has_side).isNotNull() & clean(c).isNotNull()
                      & ((F.trim(c) == F.trim("selection")) | (normalise_name(c) == selection)), F.trim(c))

    def within(c: str) -> Column:
        return F.when(clean(c).isNotNull() & inside.contains(normalise_name(c)), F.trim(c))

    return F.coalesce(clean("player_name"), clean("selection_player"), clean("participant"), same("home_player"),
                      same("away_player"), within("home_player"), within("away_player"), F.lit(""))


def before_start(start: str = "start_at", captured: str = "captured_at") -> Column:
    return F.col(start) > F.col(captured)


def pre_event_census(df: DataFrame, start: str = "start_at", captured: str = "captured_at") -> DataFrame:
    ok = before_start(start, captured)
    return df.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(ok).alias("kept_rows"),
                  F.count_if(~ok).alias("skipped_post_start"), F.count_if(ok.isNull()).alias("invalid_rows"))


AFTER_START = "after start"


def tagged_captures(raw: DataFrame, keep: Sequence[str] = (), whole: bool = True) -> DataFrame:
    """Every captured row, parsed, with the reason to leave it out; NULL for a usable one. One bad row never empties a snapshot.

    Unless ``whole``, a row that is left out has only the ``keep`` columns and its reason.
    """
    # a row's values are parsed once: predicates stop at the generator, where a plain projection would repeat every parse in each of them
    parsed = {
        "captured_at": utc_timestamp("captured_at"), "start_at": utc_timestamp("start_date"), "prop_type": prop_key("market"),
        "provider_player_id": clean("player_id"), "side": F.col("side"), "line": decimal_or_null("points"), "price": decimal_or_null("price")}
    once = F.explode(F.array(F.struct(*[v.alias(c) for c, v in parsed.items()]))).alias("__once")
    named = [c for c in raw.columns if c not in (*keep, *parsed)]
    typed = raw.select(*keep, *named, once).select(*keep, *named, "__once.*")
    late = F.coalesce(F.col("start_at") <= F.col("captured_at"), F.lit(False))
    reason = F.coalesce(
        F.when(F.col("captured_at").isNull() | F.col("start_at").isNull(), F.lit("timestamp")),
        F.when(late, F.lit(AFTER_START)),
        F.when(F.col("provider_player_id").isNull(), F.lit("player id")),
        F.when(F.col("line").isNull(), F.lit("points")), F.when(F.col("side").isNull(), F.lit("side")),
        F.when(F.col("price").isNull(), F.lit("price")), F.when(F.col("prop_type").isNull(), F.lit("market")))
    told = {
        "captured_at": F.col("captured_at"), "start_at": F.col("start_at"), "fixture_id": F.trim("fixture_id"), "league": F.trim("league"),
        "tournament": F.trim("tournament"), "home_player": F.trim("home_player"), "away_player": F.trim("away_player"),
        "book": F.trim("sportsbook"), "market_id": clean("market_id"), "market": F.trim("market"), "prop_type": F.col("prop_type"),
        "provider_player_id": F.col("provider_player_id"), "provider_player_name": selected_player(), "side": F.col("side"),
        "line": F.col("line"), "price": F.col("price"), "odds_id": clean("odds_id")}
    if not whole:
        told = {c: F.when(F.col("reason").isNull(), v) for c, v in told.items()}
    return typed.withColumn("reason", reason).select(*keep, *[v.alias(c) for c, v in told.items()], "reason")


def parse_captures(raw: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable, dropped after start, quarantined with a reason); each of them parses for itself."""
    tagged = tagged_captures(raw, keep)
    return (tagged.where(F.col("reason").isNull()).drop("reason"),
            tagged.where(F.col("reason") == AFTER_START).drop("reason"),
            tagged.where(F.col("reason").isNotNull() & (F.col("reason") != AFTER_START)))


GROUP = ["fixture_id", "book", "market", "provider_player_id", "line"]


def pivot_sides(df: DataFrame, order: Sequence[str], group: Sequence[str] = tuple(GROUP),
                metadata: Sequence[str] = (), name: str | None = "provider_player_name") -> DataFrame:
    """One row per group: first row's metadata, last price and id of each side, last non-empty name.

    Every aggregate is mergeable, so a group repeated in a third of all rows is combined before the
    shuffle. ``order`` must be total within a group.
    """
    at = F.struct(*order)

    def last(side: str, column: str) -> Column:
        return F.max_by(F.col(column), F.when(F.col("side") == side, at))

    aggs = [F.min_by(F.struct(*metadata), at).alias("__m")] if metadata else []
    if name:
        aggs.append(F.max_by(F.col(name), F.when(F.coalesce(F.col(name), F.lit("")) != "", at)).alias(name))
    out = df.groupBy(*group).agg(*aggs, last("over", "price").alias("over_price"), last("under", "price").alias("under_price"),
                                 last("over", "odds_id").alias("__o"), last("under", "odds_id").alias("__u"))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.array("__o", "__u"))))
    out = out.withColumn("provider_odds_id", F.when(F.size(ids) > 0, F.array_join(ids, "|")))
    picked = [F.col(f"__m.{c}").alias(c) for c in metadata]
    return out.select(*group, *picked, *([F.coalesce(name, F.lit("")).alias(name)] if name else []), "over_price",
                      "under_price", "provider_odds_id")


def alias_table(players: DataFrame) -> DataFrame:
    """(tour, alias, player_id): every normalised alias of every named player.

    Names are gathered per player before they become aliases: a row per player is moved and kept, not one per alias.
    """
    named = players.where(clean("player_id").isNotNull() & clean("full_name").isNotNull())
    base = named.select(tour_label("tour").alias("tour"), F.trim("player_id").alias("player_id"),
                        normalise_name("full_name").alias("__n"))
    each = base.groupBy("tour", "player_id").agg(F.collect_set("__n").alias("__n"))
    aliases = F.array_distinct(F.flatten(F.transform("__n", name_aliases)))
    return each.select("tour", F.explode(aliases).alias("alias"), "player_id")


def alias_collisions(players: DataFrame) -> DataFrame:
    """Aliases owned by several players, over the whole table.

    One alias can belong to very many players, so they are listed one per row, not gathered.
    """
    pairs = alias_table(players).select("alias", "player_id").distinct()
    shared = pairs.groupBy("alias").agg(F.count(F.lit(1)).alias("players")).where("players > 1")
    return lookup(pairs, shared, ["alias"], ["players"], how="inner")


def _unique_owner(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with exactly one owner; min = max replaces a distinct count and merges map-side."""
    found = pairs.groupBy(*keys).agg(F.min("player_id").alias("player_id"), F.max("player_id").alias("__other"))
    return found.where(F.col("player_id") == F.col("__other")).drop("__other")


def name_owners(players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope, alias, player_id) of every exact text and of every normalised alias with one owner in its scope, a tour or all of them."""
    named = players.where(clean("player_id").isNotNull() & clean("full_name").isNotNull())
    raw = named.select(tour_label("tour").alias("tour"), fold_case(F.trim("full_name")).alias("alias"),
                       F.trim("player_id").alias("player_id"))

    def scoped(pairs: DataFrame) -> DataFrame:
        scopes = F.array_compact(F.array(F.lit("*"), F.col("tour")))
        return _unique_owner(pairs.select(F.explode(scopes).alias("scope"), "alias", "player_id"), ["scope", "alias"])

    return scoped(raw), scoped(alias_table(players))


def resolve_names(names: DataFrame, players: DataFrame | tuple[DataFrame, DataFrame], name: str = "name", tour: str = "tour") -> DataFrame:
    """Distinct (name, tour) -> player_id and stage raw, normalized or unresolved.

    Exact text first, then the normalised alias; several owners never resolve. A known tour restricts
    both stages to players of that tour, an unknown one searches all. ``players`` may be their ``name_owners``.
    """
    raw, norm = name_owners(players) if isinstance(players, DataFrame) else players
    wanted = names.select(name, tour).distinct().withColumns({
        "__tour": F.coalesce(tour, F.lit("*")), "__raw": fold_case(F.trim(F.coalesce(name, F.lit("")))),
        "__norm": normalise_name(name)})
    out = lookup(wanted, raw, {"__tour": "scope", "__raw": "alias"}, {"__r": "player_id"})
    out = lookup(out, norm, {"__tour": "scope", "__norm": "alias"}, {"__n": "player_id"})
    stage = F.when(F.col("__r").isNotNull(), "raw").when(F.col("__n").isNotNull(), "normalized").otherwise("unresolved")
    return out.select(name, tour, F.coalesce("__r", "__n").alias("player_id"), stage.alias("stage"))


def with_player(df: DataFrame, resolved: DataFrame, name: str, tour: str, out: str, stage: str | None = None) -> DataFrame:
    columns = {out: "player_id", **({stage: "stage"} if stage else {})}
    return lookup(df, resolved, {name: resolved.columns[0], tour: resolved.columns[1]}, columns, null_safe=True)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")]


def played_pairs(matches: DataFrame) -> DataFrame:
    """One row per match, unordered pair, date and normalised tournament."""
    return matches.where("opponent_id IS NOT NULL").select(
        *_pair(F.col("player_id"), F.col("opponent_id")), F.col("event_date").alias("__d"),
        normalise_name("tournament").alias("__t"), "match_id").distinct()


def resolve_fixtures(fixtures: DataFrame, matches: DataFrame, *, row_id: Sequence[str], home: str = "home_id",
                     away: str = "away_id", selected: str = "selected_id", start: str = "start_at",
                     tournament: str = "tournament") -> DataFrame:
    """row_id -> match_id: same unordered pair and date, same tournament when one is given, exactly one match.

    ``matches`` may be their ``played_pairs``.
    """
    played = matches if "__a" in matches.columns else played_pairs(matches)
    h, a, s = F.col(home), F.col(away), F.col(selected)
    usable = fixtures.where(h.isNotNull() & a.isNotNull() & (h != a) & ((s == h) | (s == a)))
    rows = usable.select(*row_id, *_pair(h, a), F.to_date(start).alias("__d"),
                         normalise_name(tournament).alias("__want"))
    found = rows.join(played, ["__a", "__b", "__d"]).where((F.col("__want") == "") | (F.col("__want") == F.col("__t")))
    one = found.groupBy(*row_id).agg(F.min("match_id").alias("match_id"), F.max("match_id").alias("__other"))
    return one.where(F.col("match_id") == F.col("__other")).drop("__other")


def resolution_report(rows: DataFrame, stage: str = "stage") -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("odds_rows"), F.count_if(F.col(stage) == "raw").alias("raw_matches"),
        F.count_if(F.col(stage) == "normalized").alias("normalized_matches"),
        F.count_if(F.col(stage) == "unresolved").alias("unresolved_names"),
        (F.count_if(F.col(stage) != "unresolved") / total).alias("name_resolution_rate"),
        F.count_if(F.col("match_id").isNull()).alias("unresolved_fixture_rows"))


def unresolved_names(rows: DataFrame, stage: str = "stage", name: str = "provider_player_name") -> DataFrame:
    missing = rows.where(F.col(stage) == "unresolved")
    label = F.coalesce(clean(name), F.lit("<blank>"))
    return missing.groupBy(label.alias("provider_player_name"), "league").agg(F.count(F.lit(1)).alias("row_count"))


def prepare_snapshot(raw: DataFrame, players: DataFrame, matches: DataFrame, provider: str, order: Sequence[str],
                     snapshot: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows for the line table with both keys or neither, plus the late and quarantined rows.

    ``raw`` is in either layout, or already in the raw one with its ``side``. ``snapshot`` names columns of ``order`` that tell
    snapshots apart: sides meet only within one, so two captures of a line stay two rows; they are columns of the rows too.
    """
    raw = raw if "side" in raw.columns else to_raw_layout(raw, keep=order)
    usable, late, bad = parse_captures(raw, keep=order)
    return resolve_snapshot(usable, players, matches, provider, order, snapshot), late, bad


def resolve_snapshot(usable: DataFrame, players: DataFrame | tuple[DataFrame, DataFrame], matches: DataFrame, provider: str,
                     order: Sequence[str], snapshot: Sequence[str] = ()) -> DataFrame:
    """Usable captures as rows for the line table with both keys or neither.

    Names and fixtures are resolved for each distinct fixture and name; the lines meet them once.
    """
    meta = ["market_id", "league", "tournament", "home_player", "away_player", "start_at", "captured_at", "prop_type"]
    lines = pivot_sides(usable, [*order, "side"], group=[*GROUP, *snapshot], metadata=meta).withColumn("__tour", tour_label("league"))
    lines = kept_copy(lines, "pivoted-lines")  # their names are counted before they are joined: parsed and paired once
    told = ["fixture_id", "tournament", "start_at", "home_player", "away_player", "provider_player_name", "__tour"]
    asked = kept_copy(lines.select(*told).distinct(), "asked-fixtures")
    names = asked.select(F.explode(F.array("provider_player_name", "home_player", "away_player")).alias("name"),
                         F.col("__tour").alias("tour"))
    resolved = checked_broadcast(kept_copy(resolve_names(names, players), "resolved-names"))
    named = with_player(asked, resolved, "provider_player_name", "__tour", "selected_id", "stage")
    named = with_player(named, resolved, "home_player", "__tour", "home_id")
    named = kept_copy(with_player(named, resolved, "away_player", "__tour", "away_id"), "named-fixtures")
    # spellings of one name ask for the same match
    key = ["fixture_id", "tournament", "start_at", "home_id", "away_id", "selected_id"]
    found = resolve_fixtures(named.select(*key).distinct(), matches, row_id=key)
    answers = lookup(named, found, key, ["match_id"], null_safe=True)
    rows = lookup(lines, answers, told, ["selected_id", "stage", "match_id"], null_safe=True)
    paired = F.col("match_id").isNotNull()
    return rows.select(
        "match_id", F.when(paired, F.col("selected_id")).alias("player_id"), "book", "prop_type", "line", "over_price",
        "under_price", "captured_at", F.lit(provider).alias("provider"), F.col("fixture_id").alias("provider_event_id"),
        F.col("start_at").alias("provider_event_start_at"), F.col("market_id").alias("provider_market_id"),
        "provider_odds_id", "provider_player_id",
        F.coalesce(clean("provider_player_name"), F.lit("<blank>")).alias("provider_player_name"), "league", "stage",
        F.when(paired, F.col("captured_at")).alias("resolved_at"), *snapshot)
