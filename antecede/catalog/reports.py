"""Report queries over the R view: predictions on the B panel, lines from lineitem, status from events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from antecede.catalog.evaluation import CAL_SQL, FOLDS, TEST_SQL, r3, s3
from antecede.catalog.registry import query, r6, s6, table
from antecede.catalog.views import PANEL_SQL, panel
from antecede.operators import quality
from antecede.operators.latest import latest_run
from antecede.plans import report, scoring, walkforward
from antecede.sources import tables as scans

AS_OF = dt.date(2000, 6, 30)
OUTCOMES = {"spend": "spend", "half_spend": "half_spend"}
LIVE_AT, RUN1_AT, RUN2_AT = (dt.datetime(2026, 1, d, 12) for d in (1, 2, 3))
PROPS = [("spend", "orders", "Spend"), ("half_spend", "orders", None)]

R_SQL = f"""{PANEL_SQL},
pl AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'demo_' ELSE 'p' END || c_custkey AS player_id,
         c_name AS full_name, n_name AS tour FROM customer JOIN nation ON c_nationkey = n_nationkey),
ma AS (SELECT o_orderkey AS match_id, a.player_id, b.player_id AS opponent_id, CAST(o_orderdate AS DATE) AS event_date,
         o_orderpriority AS tournament, o_orderstatus AS surface, o_orderstatus <> 'P' AS match_completed,
         o_totalprice AS spend, o_totalprice / 2 AS half_spend
       FROM orders JOIN pl a ON a.c_custkey = o_custkey LEFT JOIN pl b ON b.c_custkey = o_custkey + 1),
pp AS (SELECT b.match_id, pl.player_id, 'orders' AS sport, b.* EXCLUDE (match_id, player_id) FROM b
       JOIN pl ON pl.c_custkey = b.player_id WHERE has_sufficient_history),
pd AS (SELECT 'baseline_v1_spend:' || match_id AS prediction_id, match_id, player_id, sport, 'spend' AS prop_type,
         rolling_mean_5 AS prediction, rolling_mean_5 - rolling_std_5 AS lowerci, rolling_mean_5 + rolling_std_5 AS upperci,
         'baseline_v1_spend' AS modelversion, TIMESTAMP '{LIVE_AT}' AS predictiontimestamp FROM pp
       UNION ALL SELECT 'gbm_v1_spend:' || match_id, match_id, player_id, sport, 'spend', rolling_mean_3,
         rolling_mean_3 - rolling_std_3, rolling_mean_3 + rolling_std_3, 'gbm_v1_spend', TIMESTAMP '{RUN1_AT}' FROM pp
       UNION ALL SELECT 'baseline_v1_half_spend:' || match_id, match_id, player_id, sport, 'half_spend', rolling_mean_5 / 2,
         NULL, NULL, 'baseline_v1_half_spend', TIMESTAMP '{LIVE_AT}' FROM pp),
pt(prop_key, sport, display_label) AS (VALUES ('spend', 'orders', 'Spend'), ('half_spend', 'orders', NULL)),
od AS (SELECT l_orderkey AS match_id, pl.player_id, 'book' || (l_suppkey % 5) AS book,
         CASE l_linestatus WHEN 'O' THEN 'spend' ELSE 'half_spend' END AS prop_type, l_extendedprice AS line,
         l_quantity AS over_price, l_discount AS under_price, CAST(l_shipdate AS TIMESTAMP) AS captured_at,
         CASE l_returnflag WHEN 'A' THEN 'demo' ELSE 'prov' || l_returnflag END AS provider,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey AS provider_event_id
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pl ON pl.c_custkey = o_custkey),
fe AS (SELECT match_id, player_id, 'spend' AS stat_target, 'v1' AS feature_version, rolling_mean_3 AS rolling_average,
         1 AS created_at FROM pp
       UNION ALL SELECT match_id, player_id, 'spend', 'v2', rolling_mean_5, 2 FROM pp WHERE priority <> '1-URGENT'),
ij AS (SELECT event_id AS injury_id, 'p' || user_id AS player_id, DATE '1995-01-01' + CAST(event_id * 7919 % 2400 AS INT) AS event_date,
         event_type AS status, ts AS captured_at FROM events),
lf AS (SELECT DISTINCT ON (match_id, player_id, stat_target) * FROM fe
       ORDER BY match_id, player_id, stat_target, created_at DESC, feature_version DESC),
li AS (SELECT DISTINCT ON (player_id, event_date) * FROM ij ORDER BY player_id, event_date, captured_at DESC, injury_id DESC),
f0 AS (SELECT pd.*, p.full_name AS player, p.tour, ma.event_date, ma.tournament, ma.surface,
         coalesce(pt.display_label, 'Half Spend') AS prop_label, od.provider, od.provider_event_id, od.book, od.line,
         od.over_price, od.under_price, od.captured_at, pd.prediction - od.line AS edge,
         (pd.prediction - od.line) / nullif(pd.upperci - pd.lowerci, 0) AS normalized_edge,
         CASE WHEN od.line IS NULL THEN NULL WHEN pd.prediction >= od.line THEN 'Over' ELSE 'Under' END AS side,
         o.full_name AS opponent, p.full_name || ' vs ' || coalesce(o.full_name, 'TBD') AS matchup, li.status,
         lf.feature_version, lf.rolling_average, left(pd.player_id, 5) = 'demo_' AS is_demo,
         CASE WHEN left(pd.player_id, 5) = 'demo_' THEN 'demo' ELSE 'real' END AS data_mode,
         CASE WHEN ma.event_date > DATE '{AS_OF}' THEN NULL
              ELSE CASE pd.prop_type WHEN 'spend' THEN ma.spend WHEN 'half_spend' THEN ma.half_spend END END AS actual_value
       FROM pd JOIN pl p USING (player_id) JOIN pt ON pt.prop_key = pd.prop_type
       JOIN ma ON ma.match_id = pd.match_id AND ma.player_id = pd.player_id
       LEFT JOIN pl o ON o.player_id = ma.opponent_id
       LEFT JOIN lf ON lf.match_id = pd.match_id AND lf.player_id = pd.player_id AND lf.stat_target = pd.prop_type
       LEFT JOIN od ON od.match_id = pd.match_id AND od.player_id = pd.player_id AND od.prop_type = pd.prop_type
       LEFT JOIN li ON li.player_id = pd.player_id AND li.event_date = ma.event_date),
fact AS (SELECT *, actual_value - prediction AS prediction_error, prediction - actual_value AS signed_error FROM f0)
"""

NUMBERS = ["prediction", "lowerci", "upperci", "edge", "rolling_average", "actual_value", "prediction_error", "signed_error"]
TEXTS = ["prediction_id", "match_id", "player_id", "player", "opponent", "matchup", "tour", "sport", "event_date", "tournament",
         "surface", "prop_type", "prop_label", "modelversion", "provider", "provider_event_id", "book", "line", "over_price",
         "under_price", "captured_at", "side", "status", "feature_version", "is_demo", "data_mode"]
SHOWN = ", ".join(TEXTS + [f"{s3(c)} AS {c}" for c in NUMBERS] + [f"{s6('normalized_edge')} AS normalized_edge"])


def shown(df):
    return df.select(*TEXTS, *[r3(c).alias(c) for c in NUMBERS], r6("normalized_edge").alias("normalized_edge"))


def players(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).selectExpr(
        "c_custkey", "concat(IF(c_mktsegment = 'MACHINERY', 'demo_', 'p'), c_custkey) AS player_id",
        "c_name AS full_name", "n_name AS tour")


def props(spark):
    return spark.createDataFrame(PROPS, "prop_key string, sport string, display_label string")


def _named(df, spark, sf, key="o_custkey", out="player_id"):
    p = players(spark, sf).select(F.col("c_custkey").alias("__c"), F.col("player_id").alias(out))
    return df.join(p, F.col(key) == F.col("__c")).drop("__c")


def matches(spark, sf):
    o = _named(table(spark, sf, "orders"), spark, sf)
    other = players(spark, sf).select((F.col("c_custkey") - 1).alias("__c"), F.col("player_id").alias("opponent_id"))
    return o.join(other, F.col("o_custkey") == F.col("__c"), "left").selectExpr(
        "o_orderkey AS match_id", "player_id", "opponent_id", "CAST(o_orderdate AS DATE) AS event_date",
        "o_orderpriority AS tournament", "o_orderstatus AS surface", "o_orderstatus <> 'P' AS match_completed",
        "o_totalprice AS spend", "o_totalprice / 2 AS half_spend")


def panel_named(spark, sf):
    b = panel(spark, sf).where("has_sufficient_history").withColumnRenamed("player_id", "__player")
    return _named(b, spark, sf, "__player").withColumn("sport", F.lit("orders"))


def predictions(spark, sf, base=None):
    base = base if base is not None else panel_named(spark, sf)

    def model(version, prop, point, std, at):
        p = F.expr(point)
        s = F.expr(std).cast("double")
        return F.struct(
            F.concat(F.lit(f"{version}:"), F.col("match_id")).alias("prediction_id"), F.lit(prop).alias("prop_type"),
            p.alias("prediction"), (p - s).alias("lowerci"), (p + s).alias("upperci"), F.lit(version).alias("modelversion"),
            F.lit(at.isoformat()).cast("timestamp_ntz").alias("predictiontimestamp"))

    # one pass over the panel, not one for each model
    models = F.array(
        model("baseline_v1_spend", "spend", "rolling_mean_5", "rolling_std_5", LIVE_AT),
        model("gbm_v1_spend", "spend", "rolling_mean_3", "rolling_std_3", RUN1_AT),
        model("baseline_v1_half_spend", "half_spend", "rolling_mean_5 / 2", "NULL", LIVE_AT))
    rows = base.select("match_id", "player_id", "sport", F.explode(models).alias("m"))
    return rows.select("m.prediction_id", "match_id", "player_id", "sport", "m.prop_type", "m.prediction", "m.lowerci", "m.upperci",
                       "m.modelversion", "m.predictiontimestamp")


def odds(spark, sf):
    o = _named(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), spark, sf)  # names meet the orders, so that the long table is moved once
    li = table(spark, sf, "lineitem")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return rows.selectExpr(
        "l_orderkey AS match_id", "player_id", "concat('book', l_suppkey % 5) AS book",
        "CASE l_linestatus WHEN 'O' THEN 'spend' ELSE 'half_spend' END AS prop_type", "l_extendedprice AS line",
        "l_quantity AS over_price", "l_discount AS under_price", "l_shipdate AS captured_at",
        "CASE l_returnflag WHEN 'A' THEN 'demo' ELSE concat('prov', l_returnflag) END AS provider",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS provider_event_id")


def features(spark, sf, base=None):
    base = base if base is not None else panel_named(spark, sf)
    v1 = base.select("match_id", "player_id", F.lit("spend").alias("stat_target"), F.lit("v1").alias("feature_version"),
                     F.col("rolling_mean_3").alias("rolling_average"), F.lit(1).alias("created_at"))
    v2 = base.where("priority <> '1-URGENT'").select(
        "match_id", "player_id", F.lit("spend").alias("stat_target"), F.lit("v2").alias("feature_version"),
        F.col("rolling_mean_5").alias("rolling_average"), F.lit(2).alias("created_at"))
    return v1.unionByName(v2)


def injuries(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS injury_id", "concat('p', user_id) AS player_id",
        "date_add(DATE'1995-01-01', CAST(event_id * 7919 % 2400 AS INT)) AS event_date", "event_type AS status",
        "ts AS captured_at")


def fact(spark, sf, columns=None):
    base = panel_named(spark, sf)
    return report.fact_report(
        predictions(spark, sf, base), players(spark, sf), props(spark), matches(spark, sf), odds(spark, sf),
        features(spark, sf, base), injuries(spark, sf), outcomes=OUTCOMES, as_of=AS_OF, columns=columns)


#: Columns of the report that a page needs; sides that bring none of them are not joined.
OVERVIEW = ["prediction_id", "match_id", "player_id", "prop_type", "book", "normalized_edge", "rolling_average", "predictiontimestamp", "data_mode"]
MATCH_DAY = ["matchup", "event_date", "tournament", "surface", "data_mode"]
VERSIONS = ["modelversion", "sport", "prop_type", "prop_label", "prediction_id", "predictiontimestamp", "data_mode"]


@query("fact_report", f"WITH {R_SQL} SELECT {SHOWN} FROM fact")
def fact_report(spark, sf):
    return shown(fact(spark, sf))


@query("latest_features", f"WITH {R_SQL} SELECT match_id, player_id, stat_target, feature_version, {s3('rolling_average')} AS rolling_average FROM lf")
def latest_features(spark, sf):
    return report.latest_features(features(spark, sf)).withColumn("rolling_average", r3("rolling_average"))


@query("latest_status", f"WITH {R_SQL} SELECT player_id, event_date, status FROM li")
def latest_status(spark, sf):
    return report.latest_injuries(injuries(spark, sf))


_TIES = "prediction_id, book NULLS FIRST, captured_at NULLS FIRST, line NULLS FIRST, over_price NULLS FIRST"


@query("top_edges", f"""WITH {R_SQL} SELECT {SHOWN} FROM (SELECT * FROM fact WHERE data_mode = 'real'
ORDER BY abs(normalized_edge) DESC NULLS LAST, {_TIES} LIMIT 8)""")
def top_edges(spark, sf):
    return shown(report.top_edges(report.only(fact(spark, sf), "real")))


@query("predictions_page", f"""WITH {R_SQL} SELECT {SHOWN} FROM (SELECT * FROM fact
WHERE data_mode = 'demo' AND modelversion = 'gbm_v1_spend' AND lower(prop_type) = 'spend'
ORDER BY event_date DESC, abs(normalized_edge) DESC NULLS LAST, player, {_TIES} LIMIT 200)""")
def predictions_page(spark, sf):
    rows = report.only(fact(spark, sf), "demo", modelversion="gbm_v1_spend", prop_type="SPEND")
    return shown(report.predictions_page(rows))


@query("overview_kpis", f"""WITH {R_SQL} SELECT count(DISTINCT (match_id, player_id, prop_type)) AS active_prop_markets,
  count(DISTINCT prediction_id) AS predictions_generated,
  count(DISTINCT prediction_id) FILTER (abs(normalized_edge) >= 0.5) AS value_edges_found,
  count(DISTINCT match_id) AS match_rows, count(DISTINCT (match_id, player_id, book, prop_type)) AS market_rows,
  count(DISTINCT (match_id, player_id, prop_type)) FILTER (rolling_average IS NOT NULL) AS feature_rows,
  max(predictiontimestamp) AS latest_prediction_timestamp FROM fact WHERE data_mode = 'real'""")
def overview_kpis(spark, sf):
    return report.overview(report.only(fact(spark, sf, OVERVIEW), "real"))


@query("matches_on_day", f"""WITH {R_SQL} SELECT DISTINCT matchup, event_date, tournament, surface FROM fact
WHERE event_date = DATE '{AS_OF}' AND data_mode = 'real'""")
def matches_on_day(spark, sf):
    return report.matches_on(report.only(fact(spark, sf, MATCH_DAY), "real"), AS_OF)


@query("model_versions", f"""WITH {R_SQL} SELECT modelversion, sport, prop_type, prop_label,
  count(DISTINCT prediction_id) AS prediction_count, min(predictiontimestamp) AS first_seen,
  max(predictiontimestamp) AS last_seen FROM fact WHERE data_mode = 'real' GROUP BY ALL""")
def model_versions(spark, sf):
    return report.model_versions(report.only(fact(spark, sf, VERSIONS), "real"))


@query("player_trend", f"""WITH {R_SQL},
r AS (SELECT * FROM fact WHERE player_id = 'p8' AND prop_type = 'spend' AND data_mode = 'real'),
s AS (SELECT modelversion FROM r GROUP BY 1 ORDER BY max(predictiontimestamp) DESC, modelversion DESC LIMIT 1)
SELECT match_id, event_date, opponent, actual_value AS value, {s3('rolling_average')} AS rolling_average, line AS posted_line
FROM (SELECT DISTINCT ON (match_id) * FROM r WHERE modelversion = (SELECT modelversion FROM s)
      ORDER BY match_id, captured_at DESC NULLS LAST, book ASC NULLS LAST, line, over_price)""")
def player_trend(spark, sf):
    out = report.player_trend(fact(spark, sf), "p8", "spend", list(OUTCOMES))
    return out.withColumn("rolling_average", r3("rolling_average"))


@query("market_pairs", f"""WITH {R_SQL},
pairs AS (SELECT DISTINCT prediction_id, od.provider, od.book, od.captured_at, ma.match_completed AND
            CASE pd.prop_type WHEN 'spend' THEN ma.spend IS NOT NULL WHEN 'half_spend' THEN ma.half_spend IS NOT NULL END AS known
          FROM pd JOIN ma USING (match_id, player_id) JOIN od ON od.match_id = pd.match_id AND od.player_id = pd.player_id
               AND od.prop_type = pd.prop_type
          WHERE left(pd.player_id, 5) <> 'demo_' AND od.provider <> 'demo' AND line IS NOT NULL
                AND CAST(od.captured_at AS DATE) <= ma.event_date)
SELECT count(*) AS prediction_line_pairs, count(*) FILTER (known) AS known_result_pairs, count(*) FILTER (known) AS paired_rows,
  array_to_string(list_sort(list(DISTINCT provider) FILTER (known)), ',') AS providers FROM pairs""")
def market_pairs(spark, sf):
    return report.market_comparison(predictions(spark, sf), matches(spark, sf), odds(spark, sf), OUTCOMES)


@query("line_search", f"""WITH {R_SQL} SELECT {SHOWN} FROM fact WHERE line IS NOT NULL AND contains(lower(concat_ws(' ',
  player, matchup, prop_label, book, tournament)), 'urgent')""")
def line_search(spark, sf):
    return shown(report.line_search(fact(spark, sf), "Urgent"))


@query("prop_rows", f"""WITH {R_SQL} SELECT prediction_id, player, matchup, prop_label, line, {s3('prediction')} AS prediction,
  {s3('lowerci')} AS lowerci, {s3('upperci')} AS upperci, {s3('edge')} AS edge, {s6('normalized_edge')} AS normalized_edge,
  over_price, under_price, {s3('actual_value')} AS actual_value, {s3('prediction_error')} AS prediction_error,
  coalesce(side, 'Over') AS side, book, is_demo FROM fact""")
def prop_rows(spark, sf):
    out = report.prop_rows(fact(spark, sf))
    return out.withColumns({c: r3(c) for c in ("prediction", "lowerci", "upperci", "edge", "actual_value", "prediction_error")}
                           ).withColumn("normalized_edge", r6("normalized_edge"))


@query("prop_options", f"WITH {R_SQL} SELECT prop_key FROM pt UNION SELECT prop_type FROM od")
def prop_options(spark, sf):
    return report.prop_options(props(spark), odds(spark, sf))


@query("odds_results", f"""WITH {R_SQL},
so AS (SELECT match_id, CAST(round(spend) AS BIGINT)::VARCHAR AS final_score, 'https://example.org/' || match_id AS source_url FROM ma
       WHERE match_completed)
SELECT od.*, ma.event_date, ma.tournament, so.final_score, so.source_url, p.full_name AS player, o.full_name AS opponent,
  ma.match_completed AS is_winner, CASE od.prop_type WHEN 'spend' THEN ma.spend WHEN 'half_spend' THEN ma.half_spend END AS actual_value
FROM od JOIN ma ON ma.match_id = od.match_id AND ma.player_id = od.player_id JOIN so ON so.match_id = ma.match_id
JOIN pl p ON p.player_id = od.player_id AND p.tour = 'NATION_3' JOIN pl o ON o.player_id = ma.opponent_id""")
def odds_results(spark, sf):
    return _results(spark, sf)


def _results(spark, sf):
    ma = matches(spark, sf).withColumn("is_winner", F.col("match_completed"))
    sources = ma.where("match_completed").select(
        "match_id", F.round("spend").cast("long").cast("string").alias("final_score"),
        F.concat(F.lit("https://example.org/"), F.col("match_id")).alias("source_url"))
    return report.odds_results(odds(spark, sf), ma, players(spark, sf), sources, tour="NATION_3", outcomes=OUTCOMES)


@query("paired_totals", f"""WITH {R_SQL}, v AS (SELECT count(*) AS n FROM od JOIN ma ON ma.match_id = od.match_id
  AND ma.player_id = od.player_id AND ma.match_completed JOIN pl p ON p.player_id = od.player_id AND p.tour = 'NATION_3'
  JOIN pl o ON o.player_id = ma.opponent_id)
SELECT count(od.match_id) AS paired_rows, count(*) FILTER (od.match_id IS NULL) AS unresolved_rows, any_value(v.n) AS visible_rows,
  count(od.match_id) = any_value(v.n) AS consistent FROM od, v""")
def paired_totals(spark, sf):
    return report.paired_totals(odds(spark, sf), _results(spark, sf))


@query("row_census", f"""WITH {R_SQL}, c AS (SELECT 'players' AS t, player_id FROM pl UNION ALL SELECT 'matches', player_id FROM ma
  UNION ALL SELECT 'odds', player_id FROM od UNION ALL SELECT 'predictions', player_id FROM pd)
SELECT t AS table_name, count(*) AS total_rows, count(*) FILTER (left(player_id, 5) <> 'demo_') AS real_rows,
  count(*) FILTER (left(player_id, 5) = 'demo_') AS demo_rows FROM c GROUP BY 1""")
def row_census(spark, sf):
    out = None
    for name, df in (("players", players(spark, sf)), ("matches", matches(spark, sf)), ("odds", odds(spark, sf)),
                     ("predictions", predictions(spark, sf))):
        part = quality.census(df, "player_id").select(F.lit(name).alias("table_name"), "total_rows", "real_rows", "demo_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("version_census", f"""WITH {R_SQL} SELECT modelversion, count(*) AS rows FROM pd WHERE left(player_id, 5) <> 'demo_'
AND modelversion IN ('baseline_v1_spend', 'gbm_v1_spend', 'ensemble_v1_spend') GROUP BY 1""")
def version_census(spark, sf):
    return report.version_census(predictions(spark, sf), report.expected_versions(["spend"]))


@query("picker_values", f"""WITH {R_SQL} SELECT DISTINCT modelversion, prop_type, data_mode FROM fact""")
def picker_values(spark, sf):
    return fact(spark, sf, ["modelversion", "prop_type", "data_mode"]).distinct()


@query("key_relabel", """SELECT CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'aces' WHEN '2-high' THEN 'games_won'
  ELSE lower(o_orderpriority) END AS prop_key, regexp_replace('v_' || o_orderstatus || '_games', '_games$', '_games_won') AS modelversion,
  count(*) AS rows FROM orders GROUP BY ALL""")
def key_relabel(spark, sf):
    """Legacy labels to stable keys and version names."""
    key = F.lower("o_orderpriority")
    return table(spark, sf, "orders").groupBy(
        F.when(key == "1-urgent", "aces").when(key == "2-high", "games_won").otherwise(key).alias("prop_key"),
        F.regexp_replace(F.concat(F.lit("v_"), F.col("o_orderstatus"), F.lit("_games")), "_games$", "_games_won").alias(
            "modelversion")).agg(F.count(F.lit(1)).alias("rows"))


@query("match_history_scan", f"""WITH {R_SQL} SELECT match_id, ma.player_id, opponent_id, event_date, full_name FROM ma
JOIN pl ON pl.player_id = ma.player_id WHERE tour = 'NATION_3' AND left(ma.player_id, 5) <> 'demo_'""")
def match_history_scan(spark, sf):
    out = scans.match_history(matches(spark, sf), players(spark, sf), "NATION_3", {"full_name": "full_name"})
    return out.select("match_id", "player_id", "opponent_id", "event_date", "full_name")


@query("feature_scan", f"""WITH {R_SQL} SELECT match_id, player_id, {s3('rolling_average')} AS rolling_average FROM fe
WHERE stat_target = 'spend' AND feature_version = 'v2' AND left(player_id, 5) <> 'demo_'""")
def feature_scan(spark, sf):
    """Features stored by version, one version read back by partition."""
    from antecede.operators import sinks
    path = sinks.scratch_path(spark, "feature-table")
    rows = features(spark, sf).withColumn("sport", F.lit("orders"))
    sinks.replace_partitions(rows, path, ["sport", "feature_version", "stat_target"])
    out = scans.read_features(spark, path, "orders", "v2", "spend")
    return out.select("match_id", "player_id", r3("rolling_average").alias("rolling_average"))


@query("member_scan", f"""WITH {R_SQL} SELECT modelversion AS member, count(*) AS rows, {s3('sum(prediction) / count(*)')} AS mean_prediction
FROM pd WHERE modelversion IN ('baseline_v1_spend', 'gbm_v1_spend', 'absent') AND left(player_id, 5) <> 'demo_' GROUP BY 1""")
def member_scan(spark, sf):
    rows = scans.member_predictions(predictions(spark, sf), ["baseline_v1_spend", "gbm_v1_spend", "absent"])
    return rows.groupBy("member").agg(F.count(F.lit(1)).alias("rows"), (F.sum("prediction") / F.count(F.lit(1))).alias("mean_prediction")
                                      ).withColumn("mean_prediction", r3("mean_prediction"))


# --- accuracy of the newest backtest run ------------------------------------------------------------

STAMP = "20260103T120000000000Z"
RUNS_SQL = R_SQL + f""", {CAL_SQL}, {TEST_SQL},
tp AS (SELECT te.*, pl.player_id AS pid FROM te JOIN pl ON pl.c_custkey = te.player_id),
bt AS (SELECT match_id, pid AS player_id, 'baseline_v1_spend_backtest_{STAMP}' AS modelversion, rolling_mean_5 AS prediction,
         rolling_mean_5 - rolling_std_5 AS lowerci, rolling_mean_5 + rolling_std_5 AS upperci, TIMESTAMP '{RUN2_AT}' AS ts,
         fold_number, cutoff_date, test_end_date FROM tp
       UNION ALL SELECT match_id, pid, 'ensemble_v1_spend_backtest_{STAMP}', rolling_mean_3, rolling_mean_3 - rolling_std_3,
         rolling_mean_3 + rolling_std_3, TIMESTAMP '{RUN2_AT}', fold_number, cutoff_date, test_end_date FROM tp
       UNION ALL SELECT match_id, pid, 'gbm_v1_spend_backtest_old', rolling_mean_3, NULL, NULL, TIMESTAMP '{RUN1_AT}',
         fold_number, cutoff_date, test_end_date FROM tp),
bs AS (SELECT bt.*, ma.spend AS actual, prediction - spend AS err FROM bt JOIN ma USING (match_id, player_id)
       WHERE ts = (SELECT max(ts) FROM bt) AND left(player_id, 5) <> 'demo_' AND spend IS NOT NULL),
bm AS (SELECT modelversion, count(*) AS scored_rows, count(*) FILTER (lowerci IS NOT NULL AND upperci IS NOT NULL) AS interval_scored_rows,
         count(DISTINCT fold_number) FILTER (fold_number > 0) AS fold_count, min(cutoff_date) - 1 AS first_cutoff,
         max(test_end_date) AS last_test_end, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, avg(err) AS mean_bias,
         avg((actual BETWEEN lowerci AND upperci)::INT) FILTER (lowerci IS NOT NULL AND upperci IS NOT NULL) AS interval_coverage
       FROM bs GROUP BY 1),
bd AS (SELECT modelversion, count(*) FILTER (lowerci > upperci) AS crossing,
         count(*) FILTER (lowerci > upperci OR prediction < 0 OR lowerci < 0 OR lowerci > prediction OR upperci < prediction) AS repaired
       FROM bt WHERE ts = (SELECT max(ts) FROM bt) GROUP BY 1),
ba AS (SELECT bm.*, CASE WHEN modelversion LIKE 'baseline%' THEN 'baseline' ELSE 'ensemble' END AS model_family,
         crossing, repaired FROM bm JOIN bd USING (modelversion))
"""


def _runs(spark, sf):
    te = walkforward.test_rows(panel(spark, sf), FOLDS).withColumnRenamed("player_id", "__player")
    te = _named(te, spark, sf, "__player")

    def run(version, point, std, at):
        p, s = F.expr(point), F.expr(std).cast("double")
        return te.select(
            "match_id", "player_id", F.lit("orders").alias("sport"), F.lit("spend").alias("prop_type"), "target_value",
            p.alias("prediction"), (p - s).alias("lowerci"), (p + s).alias("upperci"), F.lit(version).alias("modelversion"),
            F.lit(at.isoformat()).cast("timestamp_ntz").alias("predictiontimestamp"), "fold_number",
            F.date_sub("cutoff_date", 1).alias("fold_cutoff_date"), F.col("test_end_date").alias("fold_test_end_date"))

    return (run(f"baseline_v1_spend_backtest_{STAMP}", "rolling_mean_5", "rolling_std_5", RUN2_AT)
            .unionByName(run(f"ensemble_v1_spend_backtest_{STAMP}", "rolling_mean_3", "rolling_std_3", RUN2_AT))
            .unionByName(run("gbm_v1_spend_backtest_old", "rolling_mean_3", "NULL", RUN1_AT)))


def _run_log(rows):
    newest = latest_run(rows, "predictiontimestamp")
    scores = scoring.score(newest, by=["modelversion", "sport", "prop_type", "predictiontimestamp"])
    stem = F.split_part("modelversion", F.lit("_backtest_"), F.lit(1))
    keyed = scores.select("*", F.col("prop_type").alias("stat_target"), F.col("predictiontimestamp").alias("run_timestamp"),
                          ).withColumn("modelversion", stem)
    return scoring.melt_metrics(keyed, ["modelversion", "sport", "stat_target", "fold_number", "run_timestamp"],
                                [m for m in scoring.METRICS if m != "mae_improvement_over_baseline"])


@query("accuracy_by_run", f"""WITH {RUNS_SQL}
SELECT modelversion, 'orders' AS sport, 'spend' AS prop_type, 'Spend' AS prop_label, scored_rows, interval_scored_rows,
  {s3('mae')} AS mae, {s3('rmse')} AS rmse, {s3('mean_bias')} AS mean_bias, {s6('interval_coverage')} AS interval_coverage,
  {s6("CASE WHEN model_family = 'baseline' THEN 0.0 ELSE (b.bmae - mae) / b.bmae * 100 END")} AS mae_improvement_over_baseline,
  model_family, TIMESTAMP '{RUN2_AT}' AS run_timestamp, fold_count, first_cutoff, last_test_end,
  crossing::DOUBLE AS interval_crossing_count, repaired::DOUBLE AS interval_repair_count
FROM ba, (SELECT mae AS bmae FROM ba WHERE model_family = 'baseline') b""")
def accuracy_by_run(spark, sf):
    rows = _runs(spark, sf)
    out = report.accuracy_by_run(rows, matches(spark, sf), _run_log(rows), props(spark), outcomes={"spend": "spend"})
    out = report.display_order(out)
    return out.withColumns({c: r3(c) for c in ("mae", "rmse", "mean_bias")}).withColumns(
        {c: r6(c) for c in ("interval_coverage", "mae_improvement_over_baseline")})
