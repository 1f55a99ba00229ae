"""Result pages: links, cards, embedded event data and fail-closed verification."""

from __future__ import annotations

import json
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.text import name_key, utc_timestamp
from antecede.operators.quality import duplicate_keys, require_empty
from antecede.operators.skew import lookup
from antecede.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class PageFormat:
    """Patterns of one result site."""

    base: str = "https://www.wtatennis.com"
    # fixed values: markup the pages use
    player_link: str = r'href="/players/(\d+)/([^"/]+)"'
    match_link: str = r'href="(/tournaments/\d+/[^"/]+/\d{4}/scores/[LR]S\d+)"'
    card_split: str = r'<div\s+class="tennis-match js-tennis-match '
    ld_json: str = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
    team_row: str = r'(?s)<tr class="match-table__row js-team-[ab]([^"]*)".*?href="/players/(\d+)/[^"]+"'
    person_id: str = r"^https://www\.wtatennis\.com/players/(\d+)/[^/]+$"


EVENT_SCHEMA = ("`@type` string, startDate string, competitor array<struct<`@id`:string,name:string>>, "
                "additionalProperty array<struct<name:string,value:string>>")


def links(pages: DataFrame, html: str, pattern: str, keep: list[str], group: int = 1) -> DataFrame:
    """Every match of a pattern with its position."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(group))
    return pages.select(*keep, F.posexplode(found).alias("position", "link"))


def cards(pages: DataFrame, html: str, pattern: str, keep: list[str]) -> DataFrame:
    """Page pieces after each card marker; the piece before the first marker is no card."""
    parts = pages.select(*keep, F.posexplode(F.split(html, pattern)).alias("position", "card"))
    return parts.where("position > 0")


def unescape(text: Column) -> Column:
    """Character references to characters: numeric ones by rule, named ones from the HTML standard's table.

    An unknown name, a number beyond the character set and a lone ampersand stay as they are.
    """
    # a map is searched from its first entry, so the references of XML, which are nearly all there are, have one of their own
    xml = F.create_map(*[F.lit(x) for n in ("quot;", "amp;", "lt;", "gt;", "apos;") for x in (n, html5[n])])
    named = F.from_json(F.lit(json.dumps({n: c for n, c in html5.items() if n.endswith(";")})), "map<string,string>")
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), F.lit(1))

    def decode(piece: Column) -> Column:
        hexed = F.when(piece.rlike("^&#[xX]"), F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);$", 1)).otherwise(
            F.conv(F.regexp_extract(piece, "^&#([0-9]+);$", 1), 10, 16))
        code = F.conv(hexed, 16, 10).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32"))
        name = F.substring(piece, 2, 1 << 20)
        return F.when(~piece.startswith("&") | (piece == "&"), piece).when(piece.startswith("&#"), F.coalesce(number, piece)).otherwise(
            F.coalesce(F.try_element_at(xml, name), F.try_element_at(named, name), piece))

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def embedded_events(html: Column, fmt: PageFormat) -> Column:
    """Sports events with competitors and a start date out of all embedded JSON blocks."""
    blobs = F.regexp_extract_all(html, F.lit(fmt.ld_json), F.lit(1))
    parsed = F.transform(blobs, lambda b: F.from_json(unescape(b), EVENT_SCHEMA))
    return F.filter(parsed, lambda e: (e["@type"] == "SportsEvent") & (F.size(e["competitor"]) > 0)
                    & (F.coalesce(e["startDate"], F.lit("")) != ""))


def archive_fixtures(rows: DataFrame, league: str = "WTA") -> DataFrame:
    """Distinct fixtures of an archive; a foreign league or two definitions of one id is an error."""
    require_empty(rows.where(F.upper(F.trim(F.coalesce("league", F.lit("")))) != league), f"archive must be {league} only")
    out = rows.select("fixture_id", "tournament", F.to_date(utc_timestamp("start_date")).alias("scheduled_date"),
                      F.col("home_player").alias("home"), F.col("away_player").alias("away")).distinct()
    require_empty(duplicate_keys(out, ["fixture_id"]), "conflicting fixture definitions")
    return out


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")]


def fixture_links(fixtures: DataFrame, pages: DataFrame, fmt: PageFormat) -> DataFrame:
    """fixture -> match page when exactly one card of its tournament holds both players' full names."""
    pieces = cards(pages, "html", fmt.card_split, ["tournament"])
    slugs = F.regexp_extract_all("card", F.lit(fmt.player_link), F.lit(2))
    first = F.regexp_extract("card", fmt.match_link, 1)
    named = pieces.select("tournament", slugs.alias("s"), first.alias("path")).where("size(s) = 2 AND path <> ''")
    # candidates are counted per pair before they meet the fixtures: a frequent pair costs one row, not one per card and fixture
    urls = named.select("tournament", *_pair(name_key(F.col("s")[0]), name_key(F.col("s")[1])), F.concat(F.lit(fmt.base), "path").alias("url")).distinct()
    candidates = urls.groupBy("tournament", "__a", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    wanted = fixtures.select(*fixtures.columns, *_pair(name_key("home"), name_key("away")))
    out = lookup(wanted, candidates, ["tournament", "__a", "__b"], ["n", "url"])
    n = F.when(F.col("__a") != F.col("__b"), F.coalesce("n", F.lit(0))).otherwise(0)
    return out.select(*fixtures.columns, F.when(n == 1, F.col("url")).alias("url"),
                      F.when(n != 1, F.concat(F.lit("matching cards: "), n)).alias("reason"))


def set_totals(score: Column) -> dict[str, Column]:
    """Games and sets from the winner's side; NULL unless every set is complete and the winner leads."""
    parts = F.transform(F.split(score, ","), lambda p: F.trim(p))
    whole = F.forall(parts, lambda p: p.rlike(r"^\d+-\d+(\(\d+\))?$"))
    pairs = F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"^(\d+)-(\d+)", 1).try_cast("int").alias("w"),
        F.regexp_extract(p, r"^(\d+)-(\d+)", 2).try_cast("int").alias("l")))

    def total(part: str) -> Column:
        return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + p[part])

    won = F.size(F.filter(pairs, lambda p: p["w"] > p["l"]))
    lost = F.size(F.filter(pairs, lambda p: p["w"] < p["l"]))
    ok = whole & (won > lost)
    return {name: F.when(ok, value) for name, value in (
        ("winner_games", total("w")), ("loser_games", total("l")), ("winner_sets", won), ("loser_sets", lost))}


def verify_results(candidates: DataFrame, pages: DataFrame, fmt: PageFormat) -> DataFrame:
    """Join fixtures to their page and confirm pair, date, score, number and winner, or say what failed.

    A page is read where it lies: only its events and flagged winners meet the fixtures, never its text.
    """
    states = F.regexp_extract_all("html", F.lit(fmt.team_row), F.lit(1))
    players = F.regexp_extract_all("html", F.lit(fmt.team_row), F.lit(2))
    flagged = F.filter(F.arrays_zip(states.alias("s"), players.alias("p")), lambda x: x["s"].contains("is-winner"))
    read = pages.select("url", embedded_events(F.col("html"), fmt).alias("__events"),
                        F.array_distinct(F.transform(flagged, lambda x: x["p"])).alias("__winners"))
    rows = lookup(candidates.where("url IS NOT NULL").drop("reason"), read, ["url"], ["__events", "__winners"])
    rows = rows.withColumn("__e", F.get("__events", F.lit(0)))
    rows = rows.withColumns({
        "__ids": F.transform("__e.competitor", lambda c: F.regexp_extract(F.coalesce(c["@id"], F.lit("")), fmt.person_id, 1)),
        "__names": F.transform("__e.competitor", lambda c: name_key(c["name"])),
        "score": _property("Final Score"), "match_number": _property("Match Number"), "round": _property("Round")})
    rows = rows.withColumns(set_totals(F.col("score")))
    pair = F.array_sort(F.array(name_key("home"), name_key("away")))
    checks = {
        "event": F.size("__events") == 1,
        "competitors": F.size("__e.competitor") == 2,
        "player ids": F.forall("__ids", lambda i: i != ""),
        "pair": F.array_sort("__names") == pair,
        "date": F.col("__e.startDate").try_cast("date") == F.col("scheduled_date"),
        "score": (F.col("score") != "") & (F.col("match_number") != "")
                 & F.endswith("url", F.concat(F.lit("/scores/"), "match_number")),
        "winner": (F.size("__winners") == 1) & F.array_contains("__ids", F.get("__winners", F.lit(0))),
        "sets": F.col("winner_sets").isNotNull(),
    }
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    rows = rows.withColumn("reason", failed)
    good = F.col("reason").isNull()
    winner = F.get("__winners", F.lit(0))
    people = F.transform(F.col("__e.competitor"), lambda c: F.struct(
        F.regexp_extract(c["@id"], fmt.person_id, 1).alias("player_id"), c["name"].alias("name")))
    both = F.transform(people, lambda p: F.struct(
        p["player_id"].alias("player_id"), p["name"].alias("name"), (p["player_id"] == winner).alias("is_winner"),
        F.when(p["player_id"] == winner, F.col("winner_games")).otherwise(F.col("loser_games")).alias("games_won"),
        F.when(p["player_id"] == winner, F.col("winner_sets")).otherwise(F.col("loser_sets")).alias("sets_won")))
    return rows.select(*candidates.drop("reason").columns, "reason", F.when(good, F.col("score")).alias("score"),
                       F.when(good, F.col("match_number")).alias("match_number"),
                       F.when(good, F.col("round")).alias("round"), F.when(good, both).alias("players"))


def _property(name: str) -> Column:
    hits = F.filter("__e.additionalProperty", lambda p: p["name"] == name)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def result_rows(verified: DataFrame, prefix: str = "wta", code: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(players, two match rows per result, one provenance row); two fixtures on one match is an error."""
    ensure_checkpoint_dir(verified.sparkSession)
    code = code if code is not None else F.col("tournament")
    # checked once and read three times: verification runs once
    good = verified.checkpoint().where("reason IS NULL").withColumn("match_id", F.concat_ws("-", F.lit(prefix), F.year("scheduled_date"), code, "match_number"))
    require_empty(duplicate_keys(good, ["match_id"]), "several fixtures map to one match")
    both = good.select("match_id", F.col("scheduled_date").alias("event_date"), "tournament", "round", "players",
                       F.posexplode("players").alias("i", "p"))
    other = F.get("players", 1 - F.col("i"))
    rows = both.select("match_id", "event_date", "tournament", "round", F.col("p.player_id").alias("player_id"),
                       other["player_id"].alias("opponent_id"), F.col("p.is_winner").alias("is_winner"),
                       F.col("p.games_won").alias("games_won"), F.col("p.sets_won").alias("sets_won"))
    people = both.select(F.col("p.player_id").alias("player_id"), F.col("p.name").alias("full_name")).distinct()
    sources = good.select("match_id", F.col("url").alias("source_url"), F.col("score").alias("final_score"))
    return people, rows, sources
