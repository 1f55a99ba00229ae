
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.catalog.registry import table
from antecede.operators.pit import Prior, strict_prior

# --- H: two player rows per match, from events -------------------------------------------------

H_SQL = r"""
e AS (SELECT event_id, event_id // 2 AS match_id, ts, user_id, event_type, value,
             CAST(regexp_extract(props, '\d+') AS INT) AS k FROM events),
h AS (SELECT a.match_id, a.event_id, a.user_id AS player_id, b.user_id AS opponent_id,
             CAST(least(a.ts, b.ts) AS DATE) AS event_date, a.event_type AS category,
             a.value AS amount, CASE WHEN a.event_type <> 'view' THEN a.k END AS units, a.k AS k,
             a.event_type <> 'error' AS completed,
             (a.value > b.value OR (a.value = b.value AND a.event_id < b.event_id)) AS is_winner,
             b.k AS opponent_k, CAST(hour(a.ts) // 8 AS INT) AS slot
      FROM e a JOIN e b ON a.match_id = b.match_id AND a.event_id <> b.event_id AND a.user_id <> b.user_id)
"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        "event_id", F.expr("event_id div 2").alias("match_id"), "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    row = F.struct("event_id", "ts", "user_id", "event_type", "value", "k")
    pairs = e.groupBy("match_id").agg(
        F.min_by(row, "event_id").alias("a"), F.max_by(row, "event_id").alias("b"))
    pairs = pairs.where("a.event_id <> b.event_id AND a.user_id <> b.user_id")
    both = pairs.select("match_id", F.explode(F.array(
        F.struct(F.col("a").alias("own"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("s"))
    return both.selectExpr(
        "match_id", "s.own.event_id AS event_id", "s.own.user_id AS player_id", "s.other.user_id AS opponent_id",
        "CAST(least(s.own.ts, s.other.ts) AS DATE) AS event_date", "s.own.event_type AS category",
        "s.own.value AS amount", "CASE WHEN s.own.event_type <> 'view' THEN s.own.k END AS units",
        "s.own.k AS k", "s.own.event_type <> 'error' AS completed",
        "(s.own.value > s.other.value OR (s.own.value = s.other.value AND s.own.event_id < s.other.event_id)) "
        "AS is_winner",
        "s.other.k AS opponent_k", "CAST(hour(s.own.ts) div 8 AS INT) AS slot")


# --- B: evaluation panel, from orders ----------------------------------------------------------

FOLD_START, FOLD_END = dt.date(1997, 1, 1), dt.date(2001, 8, 1)
TARGET = "spend"
MINIMUM_HISTORY = 3
MINIMUM_GROUP = 30
BASE_WINDOW = 5

PANEL_SQL = f"""
b0 AS (SELECT o_custkey AS player_id, o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS event_date,
              o_totalprice AS target_value, o_orderpriority AS priority, o_orderstatus AS status,
              o_orderstatus <> 'P' AS completed FROM orders),
b1 AS (SELECT r.match_id, x.target_value AS v,
              row_number() OVER (PARTITION BY r.match_id ORDER BY x.event_date DESC, x.match_id DESC) AS k
       FROM b0 r JOIN b0 x ON x.player_id = r.player_id AND x.event_date < r.event_date
            AND x.completed AND x.target_value IS NOT NULL),
b2 AS (SELECT match_id, count(*) AS n, avg(v) FILTER (k <= 3) AS rolling_mean_3,
              stddev_samp(v) FILTER (k <= 3) AS rolling_std_3, avg(v) FILTER (k <= 5) AS rolling_mean_5,
              stddev_samp(v) FILTER (k <= 5) AS rolling_std_5 FROM b1 GROUP BY match_id),
b AS (SELECT b0.*, coalesce(n, 0) AS history_observations, rolling_mean_3, rolling_std_3, rolling_mean_5,
             rolling_std_5, coalesce(n, 0) >= {MINIMUM_HISTORY} AS has_sufficient_history,
             coalesce(n, 0) >= {MINIMUM_HISTORY} AND coalesce(completed, false) AND target_value IS NOT NULL
               AS is_training_eligible
      FROM b0 LEFT JOIN b2 USING (match_id))
"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    from antecede.plans.features import with_flags

    base = table(spark, sf, "orders").selectExpr(
        "o_custkey AS player_id", "o_orderkey AS match_id", "CAST(o_orderdate AS DATE) AS event_date",
        "o_totalprice AS target_value", "o_orderpriority AS priority", "o_orderstatus AS status",
        "o_orderstatus <> 'P' AS completed")
    outputs = {f"rolling_{a}_{n}": (a, n) for n in (3, 5) for a in ("mean", "std")}
    built = strict_prior(
        base, [Prior(("player_id",), "target_value", outputs, {"history_observations": None})],
        anchor=["player_id"], date="event_date", order=["match_id"], eligible="completed")
    return with_flags(built, minimum_history=MINIMUM_HISTORY)


# --- L: line captures in the raw layout, from lineitem and orders ---------------------------------

LINES_SQL = """
l AS (SELECT l_orderkey AS fixture_id, l_suppkey % 5 AS book, l_partkey AS provider_player_id, l_quantity AS line,
             CASE l_linestatus WHEN 'O' THEN 'over' ELSE 'under' END AS side, l_extendedprice AS price,
             CAST(l_shipdate AS TIMESTAMP) AS captured_at, CAST(o_orderdate AS TIMESTAMP) AS start_at,
             o_custkey AS player_id, l_linenumber, l_suppkey,
             l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS odds_id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).selectExpr(
        "l_orderkey AS fixture_id", "l_suppkey % 5 AS book", "l_partkey AS provider_player_id", "l_quantity AS line",
        "CASE l_linestatus WHEN 'O' THEN 'over' ELSE 'under' END AS side", "l_extendedprice AS price",
        "l_shipdate AS captured_at", "o_orderdate AS start_at", "o_custkey AS player_id", "l_linenumber", "l_suppkey",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS odds_id")
