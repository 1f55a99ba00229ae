"""Upserts, guarded writes, row rules and result pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog.evaluation import SCORED_SQL, baseline_oof, r3, s3, TARGET, RUN_STAMP, RUN_AT
from antecede.catalog.registry import query, table
from antecede.operators import pages as pg, quality, sinks, slices
from antecede.plans import scoring, walkforward

# --- upserts: stored rows from finished orders, incoming rows from open ones -------------------------

PROFILE_SQL = """
ex AS (SELECT o_custkey AS player_id, o_totalprice AS height,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS DATE) END AS profile_as_of FROM orders
       WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
ic AS (SELECT o_custkey AS player_id, o_totalprice AS height,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS DATE) END AS profile_as_of, o_orderkey AS seq
       FROM orders WHERE o_orderstatus <> 'F'),
un AS (SELECT *, NULL::BIGINT AS seq, 0 AS src FROM ex UNION ALL SELECT player_id, height, profile_as_of, seq, 1 FROM ic)
"""


def _profiles(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        "o_custkey AS player_id", "o_totalprice AS height", "o_orderkey AS seq", "o_orderstatus", "o_orderdate",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS DATE) END AS profile_as_of")
    at = F.struct("o_orderdate", "seq")
    # the order date is part of the order so that a missing as-of date can be the stored value
    existing = o.where("o_orderstatus = 'F'").groupBy("player_id").agg(
        F.max_by(F.struct("height", "profile_as_of"), at).alias("s")).select("player_id", "s.*")
    return existing, o.where("o_orderstatus <> 'F'").select("player_id", "height", "profile_as_of", "seq")


@query("upsert_newer", f"""WITH {PROFILE_SQL} SELECT player_id, height, profile_as_of FROM un
QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY profile_as_of DESC NULLS LAST, src DESC, seq DESC) = 1""")
def upsert_newer(spark, sf):
    existing, incoming = _profiles(spark, sf)
    return sinks.upsert_newer(existing, incoming, ["player_id"], "profile_as_of", "seq")


@query("upsert_last", f"""WITH {PROFILE_SQL} SELECT player_id, height, profile_as_of FROM un
QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY src DESC, seq DESC NULLS LAST) = 1""")
def upsert_last(spark, sf):
    existing, incoming = _profiles(spark, sf)
    return sinks.upsert_last(existing, incoming, ["player_id"], "seq")


# a fifth of the lines has no resolved match: those may only meet lines of the same ids
TWO_KEY_SQL = """
b AS (SELECT CASE WHEN l_partkey % 5 > 0 THEN l_orderkey END AS match_id, l_suppkey % 5 AS book, l_quantity AS line, l_extendedprice AS price,
        'prov' || (l_suppkey % 2) AS provider, l_orderkey AS event, CASE WHEN l_returnflag <> 'R' THEN l_orderkey || '-' || l_linenumber END AS odds_id,
        CAST(l_shipdate AS DATE) AS captured, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq,
        l_linestatus FROM lineitem),
x0 AS (SELECT * FROM b WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY provider, odds_id,
        CASE WHEN odds_id IS NULL THEN seq END ORDER BY seq) = 1),
ex AS (SELECT match_id, book, line, price, provider, event, odds_id, captured FROM x0
       QUALIFY row_number() OVER (PARTITION BY match_id, book, line, CASE WHEN match_id IS NULL THEN (provider, odds_id, event) END ORDER BY seq) = 1),
ic AS (SELECT match_id, book, line, price, provider, event, odds_id, captured, seq FROM b WHERE l_linestatus <> 'F'),
ia AS (SELECT * FROM ic WHERE odds_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provider, odds_id ORDER BY seq DESC) = 1),
al AS (SELECT ex.match_id, ex.book, ex.line, ex.price, ex.provider, ex.event, ex.odds_id, ex.captured, 0 AS src, NULL AS seq
       FROM ex ANTI JOIN ia ON ia.provider = ex.provider AND ia.odds_id = ex.odds_id
       UNION ALL SELECT ia.match_id, ia.book, ia.line, ia.price, ia.provider, ia.event, ia.odds_id, ia.captured,
         CASE WHEN ex.provider IS NULL THEN 1 ELSE 0 END, ia.seq
       FROM ia LEFT JOIN ex ON ia.provider = ex.provider AND ia.odds_id = ex.odds_id
       UNION ALL SELECT match_id, book, line, price, provider, event, odds_id, captured, 1, seq FROM ic WHERE odds_id IS NULL)
"""


def _two_key(spark, sf):
    li = table(spark, sf, "lineitem")
    # the natural key is the sequence: no numbering of rows in one task
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    b = li.select("*", seq.alias("seq")).selectExpr(
        "CASE WHEN l_partkey % 5 > 0 THEN l_orderkey END AS match_id", "l_suppkey % 5 AS book", "l_quantity AS line", "l_extendedprice AS price",
        "concat('prov', l_suppkey % 2) AS provider", "l_orderkey AS event",
        "CASE WHEN l_returnflag <> 'R' THEN concat_ws('-', l_orderkey, l_linenumber) END AS odds_id",
        "CAST(l_shipdate AS DATE) AS captured", "seq", "l_linestatus")
    cols = ["match_id", "book", "line", "price", "provider", "event", "odds_id", "captured"]
    old = b.where("l_linestatus = 'F'").groupBy("provider", "odds_id", F.when(F.col("odds_id").isNull(), F.col("seq"))).agg(
        F.min_by(F.struct(*[c for c in cols if c not in ("provider", "odds_id")], "seq"), "seq").alias("s")).select(
        "provider", "odds_id", "s.*")
    apart = F.when(F.col("match_id").isNull(), F.struct("provider", "odds_id", "event"))
    old = old.groupBy("match_id", "book", "line", apart).agg(
        F.min_by(F.struct("price", "provider", "event", "odds_id", "captured"), "seq").alias("s")).select(
        "match_id", "book", "line", "s.*").select(*cols)
    return old, b.where("l_linestatus <> 'F'").select(*cols, "seq")


@query("upsert_two_key", f"""WITH {TWO_KEY_SQL}
SELECT match_id, book, line, arg_max(price, (src, coalesce(seq, 0))) AS price, arg_min(provider, (src, coalesce(seq, 0))) AS provider,
  arg_max(event, (src, coalesce(seq, 0))) AS event, arg_max(coalesce(odds_id, '-'), (src, coalesce(seq, 0))) AS odds_id,
  arg_max(captured, (src, coalesce(seq, 0))) AS captured
FROM al GROUP BY match_id, book, line, CASE WHEN match_id IS NULL THEN (provider, odds_id, CASE WHEN odds_id IS NULL THEN event END) END""")
def upsert_two_key(spark, sf):
    existing, incoming = _two_key(spark, sf)
    out = sinks.upsert_two_key(existing, incoming, ["provider", "odds_id"], ["match_id", "book", "line"], "seq", fixed=["provider"],
                               provider=["provider", "event"])
    return out.withColumn("odds_id", F.coalesce("odds_id", F.lit("-")))


REGISTER_SQL = """
rg AS (SELECT o_orderpriority || '-' || (o_custkey % 100) AS name, CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'O' END AS s, count(*) AS row_count,
         CAST(min(o_orderdate) AS DATE) AS first_seen, CAST(max(o_orderdate) AS DATE) AS last_seen FROM orders GROUP BY ALL)
"""


def _register(spark, sf, rows):
    rows = table(spark, sf, "orders").where(rows)
    name = F.concat_ws("-", "o_orderpriority", F.col("o_custkey") % 100)
    return rows.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("o_orderdate").cast("date").alias("first_seen"),
        F.max("o_orderdate").cast("date").alias("last_seen"))


@query("register_merge", f"""WITH {REGISTER_SQL}
SELECT coalesce(i.name, e.name) AS name, coalesce(i.row_count, e.row_count) AS row_count,
  least(e.first_seen, i.first_seen) AS first_seen, coalesce(i.last_seen, e.last_seen) AS last_seen
FROM (SELECT * FROM rg WHERE s = 'F') e FULL JOIN (SELECT * FROM rg WHERE s = 'O') i USING (name)""")
def register_merge(spark, sf):
    return sinks.merge_register(_register(spark, sf, "o_orderstatus = 'F'"), _register(spark, sf, "o_orderstatus <> 'F'"), ["name"])


@query("register_prune", f"""WITH {REGISTER_SQL}
SELECT name, row_count, first_seen, last_seen FROM rg e WHERE s = 'F' AND EXISTS (
  SELECT 1 FROM orders o WHERE o_orderstatus = 'P' AND o_totalprice > 400000
  AND o.o_orderpriority || '-' || (o.o_custkey % 100) = e.name)""")
def register_prune(spark, sf):
    unresolved = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)
    rows = table(spark, sf, "orders").select(
        F.concat_ws("-", "o_orderpriority", F.col("o_custkey") % 100).alias("name"), F.when(~unresolved, F.col("o_orderkey")).alias("match_id"))
    return sinks.prune_register(_register(spark, sf, "o_orderstatus = 'F'"), rows, ["name"])


# --- files: written to the shared scratch folder and read back ----------------------------------------

@query("replace_by_version", """SELECT o_orderkey AS match_id, o_orderpriority AS feature_version,
  CASE WHEN o_orderstatus = 'F' THEN 'demo' ELSE 'real' END AS data_mode,
  CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders""")
def replace_by_version(spark, sf):
    """Rewriting one version's real rows leaves other versions and all demo rows as they were."""
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS match_id", "o_orderpriority AS feature_version", "o_totalprice AS v",
        "IF(o_orderstatus = 'F', 'demo', 'real') AS data_mode")
    path = sinks.scratch_path(spark, "features")
    sinks.replace_partitions(rows, path, ["data_mode", "feature_version"])
    again = rows.where("data_mode = 'real' AND feature_version = '1-URGENT'").withColumn("v", F.col("v") * 2)
    sinks.replace_partitions(again, path, ["data_mode", "feature_version"])
    return spark.read.parquet(path).select("match_id", "feature_version", "data_mode", "v")


SLICE = ["data_mode", "feature_version"]
REAL = {"data_mode": "real"}


def _versioned(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS match_id", "o_orderpriority AS feature_version", "o_totalprice AS v", "IF(o_orderstatus = 'F', 'demo', 'real') AS data_mode")


def _stored_versions(spark, sf):
    """(rows, folder of the table): demo and real versions, stored as two commits."""
    rows, path = _versioned(spark, sf), sinks.scratch_path(spark, "versions")
    slices.replace_slices(rows.where("data_mode = 'demo'"), path, SLICE, {"data_mode": "demo"})
    slices.replace_slices(rows.where("data_mode = 'real'"), path, SLICE, REAL)
    return rows, path


@query("replace_real_versions", """SELECT o_orderkey AS match_id, o_orderpriority AS feature_version,
  CASE WHEN o_orderstatus = 'F' THEN 'demo' ELSE 'real' END AS data_mode, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END * o_totalprice AS v
FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority <> '5-LOW'""")
def replace_real_versions(spark, sf):
    """A real rerun without one version: that version vanishes, the others are replaced, demo rows keep their files."""
    rows, path = _stored_versions(spark, sf)
    again = rows.where("data_mode = 'real' AND feature_version <> '5-LOW'").withColumn("v", F.col("v") * 2)
    slices.replace_slices(again, path, SLICE, REAL)
    return slices.read_slices(spark, path).select("match_id", "feature_version", "data_mode", "v")


@query("stored_as_built", """SELECT o_orderpriority AS feature_version, count(*) FILTER (o_orderstatus <> 'F') AS built_rows,
  count(*) FILTER (o_orderstatus <> 'F') AS stored_rows, count(*) FILTER (o_orderstatus = 'F') AS demo_before,
  count(*) FILTER (o_orderstatus = 'F') AS demo_after, false AS demo_changed FROM orders GROUP BY 1""")
def stored_as_built(spark, sf):
    """Counts around a real rerun: built against stored, and demo rows before and after it, by version."""
    rows, path = _stored_versions(spark, sf)
    real = rows.where("data_mode = 'real'")

    def census(df, name):
        return df.groupBy(F.col("feature_version").alias("table_name")).agg(F.count(F.lit(1)).alias(name))

    before = census(slices.read_slices(spark, path, {"data_mode": "demo"}), "demo_rows")
    slices.replace_slices(real, path, SLICE, REAL)
    saved = slices.read_slices(spark, path)
    after = census(saved.where("data_mode = 'demo'"), "demo_rows")
    changed = quality.census_changes(before, after).select("table_name", F.lit(True).alias("changed"))
    out = census(real, "built_rows").join(census(saved.where("data_mode = 'real'"), "stored_rows"), "table_name", "full")
    out = out.join(before.withColumnRenamed("demo_rows", "demo_before"), "table_name", "full").join(
        after.withColumnRenamed("demo_rows", "demo_after"), "table_name", "full").join(changed, "table_name", "left")
    counts = ["built_rows", "stored_rows", "demo_before", "demo_after"]
    return out.fillna(0, counts).select(F.col("table_name").alias("feature_version"), *counts,
                                        F.coalesce("changed", F.lit(False)).alias("demo_changed"))


@query("refuse_versions", """SELECT o_orderpriority AS feature_version, sum(o_totalprice)::DECIMAL(18, 2)::VARCHAR AS stored_v, true AS refused
FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def refuse_versions(spark, sf):
    """Versions that exist are not overwritten unless asked for: the rerun is refused and the stored values stay."""
    rows, path = _stored_versions(spark, sf)
    try:
        slices.replace_slices(rows.where("data_mode = 'real'").withColumn("v", F.col("v") * 2), path, SLICE, REAL, overwrite=False)
        refused = False
    except quality.AuditFailure:
        refused = True
    stored = slices.read_slices(spark, path, REAL).groupBy("feature_version").agg(
        F.sum(F.col("v").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("stored_v"))
    return stored.withColumn("refused", F.lit(refused))


@query("live_predictions", """SELECT o_custkey AS player_id, o_orderkey AS match_id, 'spend' AS prop_type, o_orderpriority AS modelversion,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END * o_totalprice AS prediction, true AS backtest_refused FROM orders
WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'F'""")
def live_predictions(spark, sf):
    """A rerun of one live version replaces that version whole; a backtest version is refused here."""
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey AS player_id", "o_orderkey AS match_id", "'orders' AS sport", "'spend' AS prop_type", "o_orderpriority AS modelversion",
        "o_totalprice AS prediction", "o_orderstatus")
    path = sinks.scratch_path(spark, "live")
    sinks.write_predictions(rows, path)
    rerun = rows.where("modelversion = '1-URGENT' AND o_orderstatus <> 'F'").withColumn("prediction", F.col("prediction") * 2)
    sinks.write_predictions(rerun, path)
    try:
        sinks.write_predictions(rows.withColumn("modelversion", F.lit("v_backtest_1")), path)
        refused = False
    except quality.AuditFailure:
        refused = True
    return spark.read.parquet(path).select("player_id", "match_id", "prop_type", "modelversion", "prediction",
                                           F.lit(refused).alias("backtest_refused"))


@query("one_to_one_merge", f"""SELECT o_orderkey AS match_id, {s3('o_totalprice * 0.9')} AS prediction, o_totalprice AS actual,
  true AS repeats_refused, true AS losses_refused FROM orders""")
def one_to_one_merge(spark, sf):
    """Predictions meet outcomes one to one; repeated keys or keys of one side only are refused."""
    o = table(spark, sf, "orders")
    made = o.select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") * 0.9).alias("prediction"))
    known = o.select(F.col("o_orderkey").alias("match_id"), F.col("o_totalprice").alias("actual"))

    def refused(right):
        try:
            quality.one_to_one(made, right, ["match_id"], ["actual"])
            return False
        except quality.AuditFailure:
            return True

    repeats, losses = refused(known.unionByName(known)), refused(known.where("actual < 100000"))
    return quality.one_to_one(made, known, ["match_id"], ["actual"]).select(
        "match_id", r3("prediction").alias("prediction"), "actual", F.lit(repeats).alias("repeats_refused"), F.lit(losses).alias("losses_refused"))


@query("export_rows", """SELECT c_custkey::VARCHAR AS player_id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_nationkey::VARCHAR END AS nation
FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def export_rows(spark, sf):
    """Real rows and chosen columns of a table as CSV with a header, read back; a missing value is an empty field."""
    rows = table(spark, sf, "customer").selectExpr(
        "concat(IF(c_mktsegment = 'MACHINERY', 'demo_', ''), c_custkey) AS player_id", "c_name AS name", "IF(c_acctbal >= 0, c_nationkey, NULL) AS nation")
    path = sinks.scratch_path(spark, "export")
    sinks.write_csv(sinks.in_scope(rows), path, rows.columns)
    return spark.read.option("header", True).csv(path).select("player_id", "name", "nation")


@query("append_backtest", f"""WITH {SCORED_SQL}
SELECT player_id, match_id, '{TARGET}' AS prop_type, 'baseline_v1_{TARGET}_backtest_{RUN_STAMP}' AS modelversion, fold_number,
  {s3('prediction')} AS prediction, true AS rerun_refused FROM sc WHERE modelversion LIKE 'baseline%'""")
def append_backtest(spark, sf):
    """Guarded append; storing the same run again is refused."""
    rows = scoring.repair_intervals(baseline_oof(spark, sf))
    out = walkforward.oof_frame(rows, sport="orders", target=TARGET, prefix="baseline_v1", run_timestamp=RUN_AT)
    path = sinks.scratch_path(spark, "predictions")
    sinks.append_backtest(out, path)
    saved = spark.read.parquet(path)
    try:
        sinks.append_backtest(saved, path)
        refused = False
    except quality.AuditFailure:
        refused = True
    return saved.select("player_id", "match_id", "prop_type", "modelversion", "fold_number", r3("prediction").alias("prediction"),
                        F.lit(refused).alias("rerun_refused"))


@query("fold_appendix_csv", """SELECT o_orderstatus AS metric, CAST(year(o_orderdate) - 1994 AS VARCHAR) AS fold_number,
  CAST(count(*) AS VARCHAR) AS row_count, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(count(DISTINCT o_custkey) AS VARCHAR) END AS metric_value
FROM orders WHERE year(o_orderdate) > 1994 GROUP BY o_orderstatus, year(o_orderdate)""")
def fold_appendix_csv(spark, sf):
    log = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("metric"), (F.year("o_orderdate") - 1994).alias("fold_number")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.when(F.first("o_orderstatus") != "P", F.count_distinct("o_custkey")).alias("metric_value"))
    path = sinks.scratch_path(spark, "appendix")
    sinks.write_fold_appendix(log, path)
    return spark.read.option("header", True).csv(path).select("metric", "fold_number", "row_count", "metric_value")


@query("scoped_copy", """WITH p AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'demo_' ELSE 'p' END || c_custkey AS id, c_custkey FROM customer),
o AS (SELECT id, o_orderkey, 'v' || o_orderstatus AS modelversion FROM orders LEFT JOIN p ON c_custkey = o_custkey AND o_totalprice < 300000)
SELECT 'players' AS table_name, count(*) AS source_rows, count(*) AS copied_rows FROM p WHERE left(id, 5) <> 'demo_'
UNION ALL SELECT 'odds', count(*), count(*) FROM o WHERE id IS NULL OR left(id, 5) <> 'demo_'
UNION ALL SELECT 'predictions', count(*), count(*) FROM o WHERE left(id, 5) <> 'demo_'
UNION ALL SELECT 'metrics', count(*), count(*) FROM (SELECT 'v' || o_orderstatus AS mv FROM orders) WHERE mv IN (
  SELECT modelversion FROM o WHERE left(id, 5) <> 'demo_' AND modelversion <> 'vP')""")
def scoped_copy(spark, sf):
    p = table(spark, sf, "customer").selectExpr(
        "concat(IF(c_mktsegment = 'MACHINERY', 'demo_', 'p'), c_custkey) AS player_id", "c_custkey")
    o = table(spark, sf, "orders")
    rows = o.join(p, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") < 300000), "left").select(
        "player_id", "o_orderkey", F.concat(F.lit("v"), "o_orderstatus").alias("modelversion"))
    real = sinks.in_scope(rows)
    metrics = o.select(F.concat(F.lit("v"), "o_orderstatus").alias("modelversion"), "o_orderkey")
    return sinks.scoped_copy({
        "players": sinks.in_scope(p), "odds": sinks.in_scope(rows, keep_null_player=True), "predictions": real,
        "metrics": sinks.in_scope(metrics, player=None, versions=real.where("modelversion <> 'vP'")),
    }, sinks.scratch_path(spark, "copy"), spark)


@query("row_rules", f"""WITH {SCORED_SQL},
r AS (SELECT CASE WHEN l0 IS NOT NULL AND u0 IS NOT NULL AND NOT (l0 <= p0 AND p0 <= u0) THEN 'interval order'
              WHEN l0 < 0 THEN 'nonnegative bound' ELSE 'valid' END AS reject_reason FROM sc)
SELECT reject_reason, count(*) AS rows FROM r GROUP BY 1""")
def row_rules(spark, sf):
    """Write-time rules: valid rows pass, the rest carry the first rule they break."""
    from antecede.catalog.evaluation import scored_rows
    rows = scored_rows(spark, sf).withColumns({
        "fold_cutoff_date": F.date_sub("cutoff_date", 1), "fold_test_end_date": F.col("test_end_date")})
    ok, bad = quality.split_valid(rows, sinks.prediction_rules())
    both = bad.select("reject_reason").unionByName(ok.select(F.lit("valid").alias("reject_reason")))
    return both.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query("orphan_rows", """SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey NOT IN (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def orphan_rows(spark, sf):
    parent = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_id"))
    child = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"))
    bad = sinks.orphans(child, parent, ["match_id"]).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    return bad.agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("orders"))


@query("back_fills", """SELECT o_orderkey AS match_id, coalesce(CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderdate AS DATE) END,
  CAST(o_orderdate AS DATE) - 3) AS tourney_date, greatest(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice, 0) AS lowerci,
  coalesce(CASE WHEN o_orderstatus <> 'P' THEN 'book' || o_orderkey END, o_orderkey::VARCHAR) AS provider_event_id, c_name AS player
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def back_fills(spark, sf):
    """Defaults for a date, a bound, an identifier and a joined name."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_name")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.selectExpr(
        "o_orderkey AS match_id",
        "coalesce(IF(o_orderpriority <> '1-URGENT', CAST(o_orderdate AS DATE), NULL), date_sub(o_orderdate, 3)) AS tourney_date",
        "greatest(IF(o_orderstatus = 'F', -1, 1) * o_totalprice, 0D) AS lowerci",
        "coalesce(IF(o_orderstatus <> 'P', concat('book', o_orderkey), NULL), CAST(o_orderkey AS STRING)) AS provider_event_id",
        "c_name AS player")


# --- pages -----------------------------------------------------------------------------------------------

@query("page_links", """SELECT page_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS link FROM (
  SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages)""")
def page_links(spark, sf):
    return pg.links(table(spark, sf, "pages"), "html", r'href="(/[^"]*)"', ["page_id"])


@query("page_cards", """SELECT page_id, generate_subscripts(c, 1) AS position, unnest(c) AS card FROM (
  SELECT page_id, string_split_regex(html, '<p[^>]*>')[2:] AS c FROM pages)""")
def page_cards(spark, sf):
    return pg.cards(table(spark, sf, "pages"), "html", "<p[^>]*>", ["page_id"])


# Match pages and a score page per tournament, built from event pairs: some with a wrong date, an
# unfinished score, no winner or a second card for the same pair.
PAGES_SQL = r"""
e AS (SELECT event_id, event_id // 2 AS m, ts, user_id, event_type, CAST(regexp_extract(props, '\d+') AS INT) AS k FROM events),
fx AS (SELECT a.m, 'Cup' || (a.m % 5) AS tournament, CAST(least(a.ts, b.ts) AS DATE) AS scheduled_date, a.user_id AS ha, b.user_id AS hb,
         a.event_type AS kind, a.k AS k FROM e a JOIN e b ON a.m = b.m AND a.event_id < b.event_id AND a.user_id <> b.user_id),
cd AS (SELECT f.m, count(*) AS n FROM fx f JOIN fx c ON c.tournament = f.tournament AND least(c.ha, c.hb) = least(f.ha, f.hb)
         AND greatest(c.ha, c.hb) = greatest(f.ha, f.hb) GROUP BY 1),
vr AS (SELECT fx.*, n, CASE WHEN n <> 1 THEN NULL WHEN kind = 'view' THEN 'date' WHEN kind = 'error' THEN 'winner'
         WHEN kind = 'signup' THEN 'sets' END AS reason FROM fx JOIN cd USING (m))
"""


def _fixtures(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id div 2 AS m", "event_id", "ts", "user_id", "event_type", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    row = F.struct("event_id", "ts", "user_id", "event_type", "k")
    p = e.groupBy("m").agg(F.min_by(row, "event_id").alias("a"), F.max_by(row, "event_id").alias("b"))
    return p.where("a.user_id <> b.user_id").selectExpr(
        "m AS fixture_id", "concat('Cup', m % 5) AS tournament", "CAST(least(a.ts, b.ts) AS DATE) AS scheduled_date",
        "concat('Ána Player', a.user_id) AS home", "concat('Ána Player', b.user_id) AS away", "a.user_id AS ha", "b.user_id AS hb",
        "a.event_type AS kind", "a.k AS k")


def _page_tables(spark, sf):
    """(card pages, match pages): one small page per card, so no tournament gathers in one row."""
    f = _fixtures(spark, sf)
    path = "concat('/tournaments/', substr(tournament, 4), '/cup/2026/scores/LS', fixture_id)"
    card = F.expr("concat('head<div class=\"tennis-match js-tennis-match x\"><a href=\"/players/', ha, '/ana-player', ha, '\">A</a>"
                  f"<a href=\"/players/', hb, '/ana-player', hb, '\">B</a><a href=\"', {path}, '\">score</a></div>')")
    score_pages = f.select("tournament", card.alias("html"))
    html = F.expr(
        "concat('<script type=\"application/ld+json\">{&quot;@type&quot;:&quot;SportsEvent&quot;,&quot;startDate&quot;:&quot;',"
        "IF(kind = 'view', '1999-01-01', CAST(scheduled_date AS STRING)),"
        "'&quot;,&quot;competitor&quot;:[{&quot;@id&quot;:&quot;https://www.wtatennis.com/players/', ha, '/x&quot;,&quot;name&quot;:&quot;', home,"
        "'&quot;},{&quot;@id&quot;:&quot;https://www.wtatennis.com/players/', hb, '/y&quot;,&quot;name&quot;:&quot;', away,"
        "'&quot;}],&quot;additionalProperty&quot;:[{&quot;name&quot;:&quot;Final Score&quot;,&quot;value&quot;:&quot;',"
        "IF(kind = 'signup', '6-4,2-1 RET', IF(k % 2 = 0, '6-4,7-6(5)', '4-6,6-3,6-2')),"
        "'&quot;},{&quot;name&quot;:&quot;Match Number&quot;,&quot;value&quot;:&quot;LS', fixture_id, '&quot;}]}</script>\n"
        "<tr class=\"match-table__row js-team-a', IF(kind <> 'error', ' is-winner', ''), '\"><td>\n<a href=\"/players/', ha, '/x\"></td></tr>\n"
        "<tr class=\"match-table__row js-team-b\"><td><a href=\"/players/', hb, '/y\"></td></tr>')")
    url = F.expr(f"concat('https://www.wtatennis.com', {path})")
    return f.drop("ha", "hb", "kind", "k"), score_pages, f.select(url.alias("url"), html.alias("html"))


@query("fixture_links", f"""WITH {PAGES_SQL} SELECT m AS fixture_id,
  CASE WHEN n = 1 THEN 'https://www.wtatennis.com/tournaments/' || (m % 5) || '/cup/2026/scores/LS' || m END AS url,
  CASE WHEN n <> 1 THEN 'matching cards: ' || n END AS reason FROM vr""")
def fixture_links(spark, sf):
    fixtures, score_pages, _ = _page_tables(spark, sf)
    return pg.fixture_links(fixtures, score_pages, pg.PageFormat()).select("fixture_id", "url", "reason")


def _verified(spark, sf):
    fixtures, score_pages, match_pages = _page_tables(spark, sf)
    fmt = pg.PageFormat()
    return pg.verify_results(pg.fixture_links(fixtures, score_pages, fmt), match_pages, fmt)


@query("verified_results", f"""WITH {PAGES_SQL} SELECT m AS fixture_id, reason,
  CASE WHEN reason IS NULL THEN CASE WHEN k % 2 = 0 THEN '6-4,7-6(5)' ELSE '4-6,6-3,6-2' END END AS score,
  CASE WHEN reason IS NULL THEN 'LS' || m END AS match_number FROM vr WHERE n = 1""")
def verified_results(spark, sf):
    return _verified(spark, sf).select("fixture_id", "reason", "score", "match_number")


@query("result_import", f"""WITH {PAGES_SQL}, g AS (SELECT * FROM vr WHERE n = 1 AND reason IS NULL)
SELECT 'wta-' || year(scheduled_date) || '-' || tournament || '-LS' || m AS match_id, scheduled_date AS event_date, ha::VARCHAR AS player_id,
  hb::VARCHAR AS opponent_id, true AS is_winner, CASE WHEN k % 2 = 0 THEN 13 ELSE 16 END AS games_won, 2 AS sets_won FROM g
UNION ALL SELECT 'wta-' || year(scheduled_date) || '-' || tournament || '-LS' || m, scheduled_date, hb::VARCHAR, ha::VARCHAR, false,
  CASE WHEN k % 2 = 0 THEN 10 ELSE 11 END, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END FROM g""")
def result_import(spark, sf):
    _, rows, _ = pg.result_rows(_verified(spark, sf))
    return rows.select("match_id", "event_date", "player_id", "opponent_id", "is_winner", "games_won", "sets_won")
