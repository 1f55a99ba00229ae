"""Line snapshots over lineitem and orders; names over customers, suppliers and document words."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog.registry import query, r6, s6, table
from antecede.catalog.views import LINES_SQL, lines
from antecede.functions.text import normalise_name, prop_key, side_of, tour_label
from antecede.operators import lines as ops
from antecede.operators.skew import checked_broadcast, lookup

ORDER = ["captured_at", "l_linenumber", "l_suppkey", "odds_id"]
GROUP = ["fixture_id", "book", "provider_player_id", "line"]


def pre_event(spark, sf):
    return lines(spark, sf).where(ops.before_start())


@query("pre_event_filter", f"""WITH {LINES_SQL}
SELECT count(*) AS source_rows, count(*) FILTER (start_at > captured_at) AS kept_rows,
  count(*) FILTER (start_at <= captured_at) AS skipped_post_start, 0::BIGINT AS invalid_rows FROM l""")
def pre_event_filter(spark, sf):
    return ops.pre_event_census(lines(spark, sf))


_LAST = "arg_max({c}, (captured_at, l_linenumber, l_suppkey, odds_id)) FILTER (side = '{s}')"
# the group key is coarser than the data on purpose: repeats decide by order
PIVOT_SQL = f"""{LINES_SQL},
pv AS (SELECT fixture_id, book, line, min(captured_at) AS captured_at,
  {_LAST.format(c='price', s='over')} AS over_price, {_LAST.format(c='price', s='under')} AS under_price,
  {_LAST.format(c='odds_id', s='over')} AS o, {_LAST.format(c='odds_id', s='under')} AS u
  FROM l WHERE start_at > captured_at GROUP BY fixture_id, book, line)
"""
COARSE = ["fixture_id", "book", "line"]


def pivoted(spark, sf):
    return ops.pivot_sides(pre_event(spark, sf), ORDER, group=COARSE, metadata=["captured_at"], name=None)


@query("over_under_pivot", f"""WITH {PIVOT_SQL}
SELECT fixture_id, book, line, captured_at, over_price, under_price,
  CASE WHEN o IS NULL THEN u WHEN u IS NULL THEN o ELSE least(o, u) || '|' || greatest(o, u) END AS provider_odds_id FROM pv""")
def over_under_pivot(spark, sf):
    return pivoted(spark, sf)


@query("pivot_to_sides", f"""WITH {PIVOT_SQL}
SELECT fixture_id, book, line, captured_at, 'over' AS side, over_price AS price FROM pv WHERE over_price IS NOT NULL
UNION ALL SELECT fixture_id, book, line, captured_at, 'under', under_price FROM pv WHERE under_price IS NOT NULL""")
def pivot_to_sides(spark, sf):
    return ops.pivot_to_sides(pivoted(spark, sf), [*COARSE, "captured_at"], {"price": "over_price"},
                              {"price": "under_price"}, ["price"])


# --- names ------------------------------------------------------------------------------------

WORDS_SQL = r"""
wd AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]+')) AS name FROM documents),
nm AS (SELECT name FROM wd WHERE name <> '' UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier)
"""
_NORM = ("trim(regexp_replace(replace(lower(regexp_replace(strip_accents({0}), '([a-z])([A-Z])', '\\1 \\2', 'g')), "
         "'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))")


def words(spark, sf):
    docs = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("name"))
    return (docs.where("name <> ''").union(table(spark, sf, "customer").select("c_name"))
            .union(table(spark, sf, "supplier").select("s_name")).distinct())


@query("name_normalise", f"WITH {WORDS_SQL} SELECT name, {_NORM.format('name')} AS normalised FROM nm")
def name_normalise(spark, sf):
    return words(spark, sf).select("name", normalise_name("name").alias("normalised"))


# players are people named by three words; most share initials, so aliases collide
PEOPLE_SQL = r"""
pe AS (SELECT CAST(c_custkey AS VARCHAR) AS player_id, p_name || ' ' || chr(CAST(97 + c_custkey % 26 AS INT)) ||
              CASE WHEN c_nationkey % 2 = 0 THEN 'Ánsen' ELSE 'o''Neill' END AS full_name,
              CASE WHEN c_nationkey % 3 = 0 THEN 'ATP' WHEN c_nationkey % 3 = 1 THEN 'WTA Tour' END AS tour
       FROM customer JOIN part ON p_partkey = c_custkey)
"""


def people(spark, sf):
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    return c.join(p, c["c_custkey"] == p["p_partkey"]).selectExpr(
        "CAST(c_custkey AS STRING) AS player_id",
        "concat(p_name, ' ', char(97 + c_custkey % 26), IF(c_nationkey % 2 = 0, 'Ánsen', 'o\\'Neill')) AS full_name",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'ATP' WHEN c_nationkey % 3 = 1 THEN 'WTA Tour' END AS tour")


ALIAS_SQL = PEOPLE_SQL + f""",
pn AS (SELECT *, CASE WHEN tour LIKE 'WTA%' THEN 'WTA' ELSE tour END AS t, {_NORM.format('full_name')} AS n FROM pe),
tk AS (SELECT player_id, t, n, string_split(n, ' ') AS w FROM pn WHERE n <> ''),
al AS (SELECT DISTINCT player_id, t, alias FROM (
  SELECT player_id, t, n AS alias FROM tk
  UNION ALL SELECT player_id, t, array_to_string(w[i:], ' ') || ' ' || n[1] FROM (
    SELECT *, unnest(range(2, len(w) + 1)) AS i FROM tk)
  UNION ALL SELECT player_id, t, n[1] || ' ' || array_to_string(w[i:], ' ') FROM (
    SELECT *, unnest(range(2, len(w) + 1)) AS i FROM tk)))
"""


@query("name_aliases", f"WITH {ALIAS_SQL} SELECT player_id, t AS tour, alias FROM al")
def name_aliases_query(spark, sf):
    return ops.alias_table(people(spark, sf)).select("player_id", "tour", "alias")


@query("alias_collisions", f"""WITH {ALIAS_SQL}
SELECT alias, player_id, count(*) OVER (PARTITION BY alias) AS players FROM (SELECT DISTINCT alias, player_id FROM al)
QUALIFY players > 1""")
def alias_collisions(spark, sf):
    return ops.alias_collisions(people(spark, sf)).select("alias", "player_id", "players")


# Captures: names as a provider spells them (accents lost, initials, other tours), one per order.
CAPTURE_SQL = r"""
cp AS (SELECT o_orderkey AS fixture_id, CAST(o_orderdate AS TIMESTAMP) AS start_at,
  CASE WHEN o_orderstatus = 'O' THEN 'ATP Challenger' WHEN o_orderstatus = 'F' THEN 'WTA' ELSE 'ITF' END AS league,
  CASE WHEN o_orderpriority = '1-URGENT' THEN pe.full_name
       WHEN o_orderpriority = '2-HIGH' THEN strip_accents(upper(pe.full_name))
       WHEN o_orderpriority = '3-MEDIUM' THEN array_to_string(string_split(pe.full_name, ' ')[2:], ' ') || ' ' || pe.full_name[1]
       WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'nobody' END AS name
  FROM orders JOIN pe ON pe.player_id = CAST(o_custkey AS VARCHAR))
"""


def captures(spark, sf):
    o, p = table(spark, sf, "orders"), people(spark, sf)
    joined = o.join(p, p["player_id"] == o["o_custkey"].cast("string"))
    from antecede.functions.text import strip_accents
    words_ = F.split("full_name", " ")
    name = (F.when(F.col("o_orderpriority") == "1-URGENT", F.col("full_name"))
            .when(F.col("o_orderpriority") == "2-HIGH", strip_accents(F.upper("full_name")))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat_ws(
                " ", F.array_join(F.slice(words_, 2, F.size(words_)), " "), F.substring("full_name", 1, 1)))
            .when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.lit("nobody")))
    return joined.select(F.col("o_orderkey").alias("fixture_id"), F.col("o_orderdate").alias("start_at"), F.expr(
        "CASE WHEN o_orderstatus = 'O' THEN 'ATP Challenger' WHEN o_orderstatus = 'F' THEN 'WTA' ELSE 'ITF' END").alias("league"),
        name.alias("name"))


RESOLVE_SQL = ALIAS_SQL + "," + CAPTURE_SQL + f""",
ct AS (SELECT *, CASE league WHEN 'ATP Challenger' THEN 'ATP' WHEN 'WTA' THEN 'WTA' END AS tour, {_NORM.format('name')} AS n FROM cp),
rw AS (SELECT c.fixture_id, min(pn.player_id) AS id FROM ct c JOIN pn ON lower(pn.full_name) = lower(trim(c.name))
       AND (c.tour IS NULL OR c.tour = pn.t) GROUP BY 1 HAVING count(DISTINCT pn.player_id) = 1),
nr AS (SELECT c.fixture_id, min(al.player_id) AS id FROM ct c JOIN al ON al.alias = c.n
       AND (c.tour IS NULL OR c.tour = al.t) GROUP BY 1 HAVING count(DISTINCT al.player_id) = 1),
rs AS (SELECT ct.*, coalesce(rw.id, nr.id) AS player_id, CASE WHEN rw.id IS NOT NULL THEN 'raw' WHEN nr.id IS NOT NULL
       THEN 'normalized' ELSE 'unresolved' END AS stage
       FROM ct LEFT JOIN rw USING (fixture_id) LEFT JOIN nr USING (fixture_id))
"""


def resolved(spark, sf):
    rows = captures(spark, sf).withColumn("tour", tour_label("league"))
    found = checked_broadcast(ops.resolve_names(rows, people(spark, sf)))
    return ops.with_player(rows, found, "name", "tour", "player_id", "stage")


@query("name_resolution", f"WITH {RESOLVE_SQL} SELECT fixture_id, name, tour, player_id, stage FROM rs")
def name_resolution(spark, sf):
    return resolved(spark, sf).select("fixture_id", "name", "tour", "player_id", "stage")


@query("name_resolution_report", f"""WITH {RESOLVE_SQL}
SELECT count(*) AS odds_rows, count(*) FILTER (stage = 'raw') AS raw_matches,
  count(*) FILTER (stage = 'normalized') AS normalized_matches, count(*) FILTER (stage = 'unresolved') AS unresolved_names,
  {s6("count(*) FILTER (stage <> 'unresolved') / count(*)")} AS name_resolution_rate,
  count(*) FILTER (player_id IS NULL) AS unresolved_fixture_rows FROM rs""")
def name_resolution_report(spark, sf):
    out = ops.resolution_report(resolved(spark, sf).withColumn("match_id", F.col("player_id")))
    return out.withColumn("name_resolution_rate", r6("name_resolution_rate"))


UNRESOLVED_SQL = RESOLVE_SQL + """,
un AS (SELECT coalesce(nullif(trim(name), ''), '<blank>') AS provider_player_name, league, count(*) AS row_count,
              min(start_at) AS first_seen, max(start_at) AS last_seen
       FROM rs WHERE stage = 'unresolved' GROUP BY ALL)
"""


@query("unresolved_names", f"WITH {UNRESOLVED_SQL} SELECT provider_player_name, league, row_count FROM un")
def unresolved_names(spark, sf):
    return ops.unresolved_names(resolved(spark, sf), name="name")


@query("source_tours", f"""WITH {RESOLVE_SQL} SELECT DISTINCT tour FROM ct WHERE tour IS NOT NULL""")
def source_tours(spark, sf):
    return captures(spark, sf).select(tour_label("league").alias("tour")).where("tour IS NOT NULL").distinct()


# Fixtures: the two players of an H match, the wrong pair for some, tournament known for some.
@query("fixture_resolution", r"""WITH e AS (SELECT event_id, event_id // 2 AS m, ts, user_id, event_type FROM events),
h AS (SELECT a.m AS match_id, a.event_id, a.user_id AS player_id, b.user_id AS opponent_id,
             CAST(least(a.ts, b.ts) AS DATE) AS event_date, 'Cup ' || least(a.event_type, b.event_type) AS tournament,
             a.event_type
      FROM e a JOIN e b ON a.m = b.m AND a.event_id <> b.event_id AND a.user_id <> b.user_id),
f AS (SELECT event_id AS row_id, player_id AS selected_id, player_id AS home_id, opponent_id AS away_id, event_date AS d,
             CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'other' ELSE upper(tournament) END AS want FROM h),
c AS (SELECT f.row_id, m.match_id FROM f JOIN (SELECT DISTINCT match_id, least(player_id, opponent_id) AS a,
        greatest(player_id, opponent_id) AS b, event_date, tournament FROM h) m
      ON m.a = least(home_id, away_id) AND m.b = greatest(home_id, away_id) AND m.event_date = f.d
         AND (want = '' OR lower(want) = lower(m.tournament))),
u AS (SELECT row_id, min(match_id) AS match_id FROM c GROUP BY 1 HAVING count(DISTINCT match_id) = 1)
SELECT f.row_id, u.match_id, CASE WHEN u.match_id IS NOT NULL THEN selected_id END AS player_id FROM f LEFT JOIN u USING (row_id)""")
def fixture_resolution(spark, sf):
    from antecede.catalog.views import history
    e = table(spark, sf, "events")
    h = history(spark, sf)
    first = e.groupBy(F.expr("event_id div 2").alias("match_id")).agg(
        F.concat(F.lit("Cup "), F.min("event_type")).alias("tournament"))
    m = lookup(h, first, ["match_id"], ["tournament"])
    fixtures = m.selectExpr(
        "event_id AS row_id", "player_id AS selected_id", "player_id AS home_id", "opponent_id AS away_id",
        "CAST(event_date AS TIMESTAMP) AS start_at",
        "CASE category WHEN 'click' THEN '' WHEN 'view' THEN 'other' ELSE upper(tournament) END AS tournament")
    found = ops.resolve_fixtures(fixtures, m, row_id=["row_id"])
    out = lookup(fixtures, found, ["row_id"], ["match_id"])
    return out.select("row_id", "match_id", F.when(F.col("match_id").isNotNull(), F.col("selected_id")).alias("player_id"))


@query("side_and_market", r"""SELECT CASE WHEN t.side = '' THEN NULL ELSE t.side END AS side, prop_type, count(*) AS rows FROM (
  SELECT regexp_extract(lower(l_linestatus_text), '\b(over|under)\b', 1) AS side,
    CASE market WHEN 'Player Aces' THEN 'aces' WHEN 'Double-Faults' THEN 'double_faults' WHEN 'GamesWon' THEN 'games_won' END AS prop_type
  FROM (SELECT CASE l_linestatus WHEN 'O' THEN 'Total OVER ' || l_quantity ELSE CASE l_returnflag WHEN 'A' THEN 'undergo' ELSE 'Under' END END
          AS l_linestatus_text,
        CASE l_returnflag WHEN 'A' THEN 'Player Aces' WHEN 'N' THEN 'Double-Faults' WHEN 'R' THEN CASE l_linestatus WHEN 'O' THEN 'GamesWon'
          ELSE 'Corners' END END AS market FROM lineitem)) t GROUP BY ALL""")
def side_and_market(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "CASE l_linestatus WHEN 'O' THEN concat('Total OVER ', l_quantity) ELSE CASE l_returnflag WHEN 'A' THEN 'undergo' "
        "ELSE 'Under' END END AS selection",
        "CASE l_returnflag WHEN 'A' THEN 'Player Aces' WHEN 'N' THEN 'Double-Faults' WHEN 'R' THEN CASE l_linestatus "
        "WHEN 'O' THEN 'GamesWon' ELSE 'Corners' END END AS market")
    return li.groupBy(side_of(F.col("selection")).alias("side"), prop_key("market").alias("prop_type")).agg(
        F.count(F.lit(1)).alias("rows"))
