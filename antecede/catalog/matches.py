"""Match ingest over winner/loser rows that Spark derives from the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from antecede.catalog.registry import query, table
from antecede.operators import matches as m, sinks
from antecede.sources.csv_text import BYTE_ORDER_MARK
from antecede.sources.match_csv import REQUIRED, read_matches

# raw source rows: file 0 has every match, file 1 repeats those whose winner event is a purchase
SOURCE_EXPR = {
    "tourney_id": "concat('T', m % 7)", "tourney_name": "concat('Cup ', m % 7)",
    "surface": "CASE w.event_type WHEN 'click' THEN 'Hard' WHEN 'view' THEN ' Clay ' WHEN 'error' THEN '' ELSE 'Grass' END",
    "draw_size": "'32'", "tourney_level": "CASE WHEN w.k < 50 THEN 'A' ELSE 'G' END",
    "tourney_date": "{ymd}", "match_num": "CASE WHEN w.k = 13 THEN 'x' ELSE cast(m % 500 AS {str}) END",
    "winner_id": "cast(w.user_id AS {str})", "loser_id": "CASE WHEN l.k = 17 THEN ' ' ELSE cast(l.user_id AS {str}) END",
    "winner_seed": "CASE WHEN w.k < 20 THEN 'Q' ELSE cast(w.k AS {str}) END", "loser_seed": "''",
    "winner_entry": "''", "loser_entry": "'WC'",
    "winner_name": "concat('Player ', w.user_id)", "loser_name": "concat('Player ', l.user_id)",
    "winner_hand": "'R'", "loser_hand": "'L'", "winner_ioc": "'FRA'", "loser_ioc": "''",
    "winner_ht": "cast(170 + w.k % 30 AS {str})", "loser_ht": "cast(170 + l.k % 30 AS {str})",
    "winner_age": "'25.5'", "loser_age": "''",
    "winner_rank": "cast(w.k AS {str})", "loser_rank": "concat(cast(l.k AS {str}), '.0')",
    "winner_rank_points": "cast(w.k * 10 AS {str})", "loser_rank_points": "cast(l.k * 10 AS {str})",
    "score": "CASE w.event_type WHEN 'click' THEN '6-4 6-3' WHEN 'view' THEN '7-6(5) 4-6 6-2' "
             "WHEN 'error' THEN '6-4 2-1 Ret.' WHEN 'signup' THEN '' ELSE '6-2 6-1 3-6' END",
    "best_of": "CASE WHEN w.k % 10 = 0 THEN '5' WHEN w.k % 10 = 1 THEN '' ELSE '3' END",
    "round": "CASE l.k % 6 WHEN 0 THEN 'R128' WHEN 1 THEN 'R32' WHEN 2 THEN 'QF' WHEN 3 THEN 'F' WHEN 4 THEN 'Q2' ELSE 'RR' END",
    "minutes": "cast(floor(w.value) AS {int_str})",
}
for _s in ("w", "l"):
    SOURCE_EXPR.update({
        f"{_s}_ace": f"cast({_s}.k % 25 AS {{str}})", f"{_s}_df": f"cast({_s}.k % 9 - 1 AS {{str}})",
        f"{_s}_svpt": f"cast(floor({_s}.value) AS {{int_str}})", f"{_s}_1stIn": f"cast({_s}.k AS {{str}})",
        f"{_s}_1stWon": f"cast({_s}.k - {_s}.k % 3 AS {{str}})", f"{_s}_2ndWon": "''",
        f"{_s}_SvGms": "'10'", f"{_s}_bpSaved": f"cast({_s}.k % 4 AS {{str}})", f"{_s}_bpFaced": f"cast({_s}.k % 6 AS {{str}})"})

SOURCE_SQL = r"""
e AS (SELECT event_id, event_id // 2 AS m, ts, user_id, event_type, value,
             CAST(regexp_extract(props, '\d+') AS INT) AS k FROM events),
pr AS (SELECT a.m, CASE WHEN a.value >= b.value THEN a ELSE b END AS w, CASE WHEN a.value >= b.value THEN b ELSE a END AS l
       FROM e a JOIN e b ON a.m = b.m AND a.event_id < b.event_id),
s0 AS (SELECT m, w.event_type AS kind, """ + ", ".join(
    f'{e.format(ymd="strftime(least(w.ts, l.ts), $$%Y%m%d$$)", str="VARCHAR", int_str="BIGINT)::VARCHAR")} AS "{c}"'.replace(
        "BIGINT)::VARCHAR))", "BIGINT)::VARCHAR)").replace(")::VARCHAR)", ")::VARCHAR")
    for c, e in SOURCE_EXPR.items()) + """ FROM pr),
src AS (SELECT 0 AS file_idx, * FROM s0 UNION ALL SELECT 1, * FROM s0 WHERE kind = 'purchase')
"""


def source(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id", "event_id div 2 AS m", "ts", "user_id", "event_type", "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k")
    row = F.struct("event_id", "ts", "user_id", "event_type", "value", "k")
    pairs = e.groupBy("m").agg(F.min_by(row, "event_id").alias("a"), F.max_by(row, "event_id").alias("b"))
    pairs = pairs.selectExpr("m", "IF(a.value >= b.value, a, b) AS w", "IF(a.value >= b.value, b, a) AS l")
    fill = dict(ymd="date_format(least(w.ts, l.ts), 'yyyyMMdd')", str="STRING", int_str="STRING")
    one = pairs.select("m", F.col("w.event_type").alias("kind"),
                       *[F.expr(e.format(**fill)).alias(c) for c, e in SOURCE_EXPR.items()])
    again = one.where("kind = 'purchase'").withColumn("file_idx", F.lit(1))
    return one.withColumn("file_idx", F.lit(0)).unionByName(again)


INT = "CASE WHEN regexp_full_match(trim({0}), '[+-]?\\d+(\\.\\d*)?') THEN trunc(CAST(trim({0}) AS DOUBLE))::INT END"


def _i(c: str) -> str:
    return INT.format(f'"{c}"')


_STATS_SQL = ", ".join(f'{_i(f"{s}_{suf}")} AS {s}__{n}' for s in ("w", "l") for n, suf in m.STATS.items())
_VALID = " AND ".join(["coalesce({s}__%s >= 0, true)" % n for n in m.STATS] + [
    "coalesce({s}__first_serves_in <= {s}__serve_points, true)", "coalesce({s}__aces <= {s}__serve_points, true)",
    "coalesce({s}__double_faults <= {s}__serve_points, true)",
    "coalesce({s}__first_serves_won <= {s}__first_serves_in, true)", "coalesce({s}__bp_saved <= {s}__bp_faced, true)"])

PARSED_SQL = SOURCE_SQL + f""",
p0 AS (SELECT *, strptime(tourney_date, '%Y%m%d')::DATE AS td, {_i('match_num')} AS mn, {_i('best_of')} AS bo, {_STATS_SQL}
       FROM src),
p1 AS (SELECT *, (trim(tourney_id) <> '' AND mn IS NOT NULL AND trim(winner_id) <> '' AND trim(loser_id) <> '') AS ok,
  td + CASE upper(round) WHEN 'R128' THEN 0 WHEN 'R64' THEN 1 WHEN 'R32' THEN 2 WHEN 'R16' THEN 3 WHEN 'QF' THEN 4
       WHEN 'SF' THEN 5 WHEN 'F' THEN 6 WHEN 'Q1' THEN -1 WHEN 'Q2' THEN -1 WHEN 'Q3' THEN -1 WHEN 'Q4' THEN -1 ELSE 0 END AS ed,
  coalesce(score <> '' AND NOT regexp_matches(upper(score), 'RET|W/O|WO|DEF|ABN|ABD') AND bo > 0
    AND greatest(len(list_filter(string_split(score, ' '), lambda t: TRY_CAST(regexp_extract(t, '^(\\d+)-(\\d+)', 1) AS INT)
                                > TRY_CAST(regexp_extract(t, '^(\\d+)-(\\d+)', 2) AS INT))),
                 len(list_filter(string_split(score, ' '), lambda t: TRY_CAST(regexp_extract(t, '^(\\d+)-(\\d+)', 1) AS INT)
                                < TRY_CAST(regexp_extract(t, '^(\\d+)-(\\d+)', 2) AS INT)))) >= bo // 2 + 1, false) AS done,
  {_VALID.format(s='w')} AS w__valid, {_VALID.format(s='l')} AS l__valid FROM p0)
"""


def _side_sql(s: str) -> str:
    me, other, far = ("winner", "loser", "l") if s == "w" else ("loser", "winner", "w")
    stats = ", ".join(f"CASE WHEN {s}__valid THEN {s}__{n} END AS {n}" for n in m.STATS)
    return f"""SELECT file_idx, tourney_id || '-' || mn AS match_id, ed AS event_date, td AS tourney_date,
  nullif(trim(surface), '') AS surface, trim({me}_id) AS player_id, trim({other}_id) AS opponent_id, {s == 'w'} AS is_winner,
  {_i('minutes')} AS minutes, bo AS best_of, nullif(score, '') AS score, done AS match_completed,
  {_i(f'{me}_seed')} AS player_seed, nullif({me}_entry, '') AS player_entry, {_i(f'{me}_rank')} AS player_rank,
  {_i(f'{other}_rank')} AS opponent_rank, CAST(CAST(nullif({me}_age, '') AS DECIMAL(8,4)) AS VARCHAR) AS player_age, {stats},
  CASE WHEN {s}__valid AND {far}__valid THEN {far}__bp_faced - {far}__bp_saved END AS break_points_won
FROM p1 WHERE ok"""


@query("expand_match_rows", f"WITH {PARSED_SQL} {_side_sql('w')} UNION ALL {_side_sql('l')}")
def expand_match_rows(spark, sf):
    out = m.expand_matches(source(spark, sf), keep=["file_idx"])
    return out.select(
        "file_idx", "match_id", "event_date", "tourney_date", "surface", "player_id", "opponent_id", "is_winner", "minutes",
        "best_of", "score", "match_completed", "player_seed", "player_entry", "player_rank", "opponent_rank",
        F.col("player_age").cast("string").alias("player_age"), *m.STATS, "break_points_won")


# files 0 and 1 of the fixture as CSV: the second with its columns backwards, a byte order mark, one more column and every row again
@query("match_csv_ingest", f"""WITH {SOURCE_SQL}
SELECT tourney_id, match_num, tourney_date, winner_id, trim(loser_id) AS loser_id, score, surface_kind, count(*) AS rows, count(*) FILTER (again) AS rows_of_second
FROM (SELECT *, false AS again, trim(surface) AS surface_kind FROM s0 UNION ALL SELECT *, true, trim(surface) FROM s0 WHERE kind = 'purchase'
      UNION ALL SELECT *, true, trim(surface) FROM s0 WHERE kind = 'purchase') GROUP BY ALL""")
def match_csv_ingest(spark, sf):
    """Match files written as CSV and read back in the given order, each by its own header."""
    rows = source(spark, sf)
    first, second = sinks.scratch_path(spark, "matches-0"), sinks.scratch_path(spark, "matches-1")
    csv = dict(header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows.where("file_idx = 0").select(*REQUIRED).write.options(**csv).csv(first)
    again = rows.where("file_idx = 1").select(*REQUIRED[::-1], F.lit("x").alias("remark"))
    again.unionByName(again).withColumnRenamed(REQUIRED[-1], BYTE_ORDER_MARK + REQUIRED[-1]).write.options(**csv).csv(second)
    read = read_matches(spark, [first, second]).withColumn("again", F.col("file_idx") == 1)
    keys = ["tourney_id", "match_num", "tourney_date", "winner_id"]
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("loser_id", "score", "surface")}  # an empty field is read as missing
    return read.groupBy(*keys, F.trim(text["loser_id"]).alias("loser_id"), text["score"].alias("score"), F.trim(text["surface"]).alias("surface_kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("again").alias("rows_of_second"))


@query("score_completion", f"""WITH {PARSED_SQL}
SELECT score, bo AS best_of, done AS match_completed, count(*) AS matches FROM p1 GROUP BY ALL""")
def score_completion(spark, sf):
    rows = m.with_parsed(source(spark, sf))
    return rows.groupBy("score", F.col("best_of_sets").alias("best_of"), F.col("completed").alias("match_completed")).agg(
        F.count(F.lit(1)).alias("matches"))


@query("stat_validity", f"""WITH {PARSED_SQL} SELECT m, file_idx, w__valid AS winner_valid, l__valid AS loser_valid FROM p1""")
def stat_validity(spark, sf):
    return m.with_parsed(source(spark, sf)).select(
        "m", "file_idx", F.col("w__valid").alias("winner_valid"), F.col("l__valid").alias("loser_valid"))


@query("dedupe_match_ids", f"""WITH {SOURCE_SQL},
d AS (SELECT *, tourney_id || '-' || match_num AS base, concat_ws('|', tourney_id, match_num, tourney_date, trim(winner_id),
                trim(loser_id), score) AS sig FROM src),
o AS (SELECT *, first_value(sig) OVER (PARTITION BY base ORDER BY file_idx, m) AS owner,
             row_number() OVER (PARTITION BY base, sig ORDER BY file_idx, m) AS rep FROM d)
SELECT m, file_idx, CASE WHEN sig = owner THEN base
  ELSE base || '-' || tourney_date || '-' || trim(winner_id) || '-' || trim(loser_id) END AS match_id FROM o WHERE rep = 1""")
def dedupe_match_ids(spark, sf):
    out = m.unique_match_ids(source(spark, sf), ["file_idx", "m"])
    return out.select("m", "file_idx", F.col("unique_id").alias("match_id"))


@query("latest_profile", f"""WITH {SOURCE_SQL},
s AS (SELECT file_idx, m, 0 AS side, trim(winner_id) AS player_id, winner_name AS full_name, winner_hand AS hand,
        nullif(winner_ioc, '') AS country, {_i('winner_ht')} AS height_cm, {_i('winner_rank')} AS rank_position,
        strptime(tourney_date, '%Y%m%d')::DATE AS profile_as_of FROM src
      UNION ALL SELECT file_idx, m, 1, trim(loser_id), loser_name, loser_hand, nullif(loser_ioc, ''), {_i('loser_ht')},
        {_i('loser_rank')}, strptime(tourney_date, '%Y%m%d')::DATE FROM src)
SELECT player_id, full_name, hand, country, height_cm, rank_position, profile_as_of FROM s WHERE player_id <> ''
QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY profile_as_of DESC, file_idx DESC, m DESC, side DESC) = 1""")
def latest_profile(spark, sf):
    order = ["file_idx", "m"]
    out = m.latest_profiles(m.player_snapshots(source(spark, sf), order), order)
    return out.select("player_id", "full_name", "hand", "country", "height_cm", "rank_position", "profile_as_of")


@query("season_report", f"""WITH {PARSED_SQL}
SELECT file_idx, count(*) AS source_rows, 2 * count(*) FILTER (ok) AS output_rows,
  CAST(count(*) FILTER (ok AND w__valid AND w__aces IS NOT NULL) + count(*) FILTER (ok AND l__valid AND l__aces IS NOT NULL)
    AS BIGINT) AS non_null_ace_rows,
  count(*) FILTER (ok AND NOT done) AS incomplete_matches, count(*) FILTER (ok AND trim(surface) = '') AS null_surface_matches,
  count(*) FILTER (NOT ok) AS invalid_rows,
  count(*) FILTER (ok AND NOT w__valid) + count(*) FILTER (ok AND NOT l__valid) AS invalid_stat_sides,
  min(ed) FILTER (ok) AS min_event_date, max(ed) FILTER (ok) AS max_event_date FROM p1 GROUP BY file_idx""")
def season_report(spark, sf):
    return m.season_report(source(spark, sf), ["file_idx"])


@query("duplicate_report", f"""WITH {SOURCE_SQL},
d AS (SELECT *, row_number() OVER (PARTITION BY tourney_id, match_num, tourney_date, trim(winner_id), trim(loser_id), score
        ORDER BY file_idx, m) AS rep FROM src)
SELECT file_idx, count(*) AS source_rows, count(*) FILTER (rep > 1) AS duplicate_rows FROM d GROUP BY 1""")
def duplicate_report(spark, sf):
    return m.duplicate_report(source(spark, sf), ["file_idx"], ["file_idx", "m"])


@query("freshness", f"""WITH {PARSED_SQL}
SELECT year(ed) AS season, max(ed) AS newest, DATE '2024-02-20' - max(ed) > 21 AS stale FROM p1 WHERE ok GROUP BY 1""")
def freshness(spark, sf):
    rows = m.expand_matches(source(spark, sf))
    today = F.lit(dt.date(2024, 2, 20))
    out = rows.groupBy(F.year("event_date").cast("bigint").alias("season")).agg(F.max("event_date").alias("newest"))
    return out.withColumn("stale", F.datediff(today, "newest") > 21)


@query("player_season_history", f"""WITH {PARSED_SQL}, h AS ({_side_sql('w')} UNION ALL {_side_sql('l')})
SELECT event_date, match_id, 'Player ' || player_id AS player, 'Player ' || opponent_id AS opponent, is_winner, aces, score
FROM h WHERE player_id = '8' AND year(tourney_date) = 2024""")
def player_season_history(spark, sf):
    src = source(spark, sf)
    players = m.latest_profiles(m.player_snapshots(src, ["file_idx", "m"]), ["file_idx", "m"])
    out = m.player_history(m.expand_matches(src), players, "player 8", [2024])
    return out.select("event_date", "match_id", "player", "opponent", "is_winner", "aces", "score")
