"""Streaming forms of the line operators over files Spark writes from lineitem and orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F, types as T

from antecede.catalog.lines import ORDER
from antecede.catalog.registry import query, table
from antecede.catalog.views import LINES_SQL, lines
from antecede.operators import lines as ops, sinks
from antecede.session import shuffles_dropped
from antecede.streaming import lines as stream

COLUMNS = ["fixture_id", "book", "provider_player_id", "line", "side", "price", "captured_at", "start_at", "l_linenumber",
           "l_suppkey", "odds_id"]


#: Most line items of a write task, three tasks at least.
TASK_ROWS = 2_000_000


def _written(spark, sf, repeat=False):
    """CSV snapshots by capture year, several files each, so that a snapshot falls into several batches; and how many files stand for one of three."""
    rows = lines(spark, sf).select(*COLUMNS).withColumn("snapshot", F.year("captured_at"))
    if repeat:  # one join, not one for each copy
        rows = rows.withColumn("copy", F.explode(F.when(F.col("side") == "under", F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    schema = T.StructType([f for f in rows.schema if f.name != "snapshot"])
    text = rows.withColumns({"captured_at": F.col("captured_at").cast("timestamp"), "start_at": F.col("start_at").cast("timestamp")})
    path = sinks.scratch_path(spark, "snapshots")
    grown = max(1, math.ceil(table(spark, sf, "lineitem").count() / (3 * TASK_ROWS)))
    with shuffles_dropped(spark):
        text.repartition(3 * grown, "odds_id").write.partitionBy("snapshot").options(header=True, compression="gzip").csv(path)
    fields = [T.StructField(f.name, T.TimestampType()) if f.name in ("captured_at", "start_at") else f for f in schema]
    return path, T.StructType([*fields, T.StructField("snapshot", T.IntegerType())]), grown


PIVOT_KEYS = ["snapshot", "fixture_id", "book", "provider_player_id", "line"]
_AT = "(captured_at, l_linenumber, l_suppkey, odds_id)"


@query("stream_ingest", f"""WITH {LINES_SQL}
SELECT CAST(year(captured_at) AS INT) AS snapshot, fixture_id, book, provider_player_id, line,
  arg_max(price, {_AT}) FILTER (side = 'over') AS over_price, arg_max(price, {_AT}) FILTER (side = 'under') AS under_price
FROM l WHERE start_at > captured_at GROUP BY ALL""")
def stream_ingest(spark, sf):
    path, schema, grown = _written(spark, sf)
    source = stream.line_stream(spark, path, schema, files_per_batch=3 * grown)
    target = sinks.scratch_path(spark, "lines")
    stream.run_available(source, sinks.scratch_path(spark, "ingest-progress"), batch=lambda df, _: stream.merge_sides(
        df.where(ops.before_start()), target, PIVOT_KEYS, "snapshot", ORDER))
    return spark.read.parquet(target).select(*PIVOT_KEYS, F.col("over.price").alias("over_price"), F.col("under.price").alias("under_price"))


@query("stream_dedupe", f"""WITH {LINES_SQL}
SELECT odds_id, fixture_id, side, price FROM l WHERE start_at > captured_at""")
def stream_dedupe(spark, sf):
    """A repeat has the capture time of its first row, so it lands in the same stored partition and merges there, however late."""
    path, schema, grown = _written(spark, sf, repeat=True)
    source = stream.line_stream(spark, path, schema, files_per_batch=2 * grown)
    target = sinks.scratch_path(spark, "deduped")
    first = {c: F.min(c) for c in ("fixture_id", "side", "price")}
    stream.run_available(source, sinks.scratch_path(spark, "dedupe-progress"), batch=lambda df, _: stream.merge_partitions(
        df.where(ops.before_start()), target, ["odds_id"], "snapshot", first))
    return spark.read.parquet(target).select("odds_id", *first)


@query("stream_unresolved", f"""WITH {LINES_SQL}
SELECT CAST(captured_at AS DATE) AS day, book, provider_player_id, count(*) AS row_count FROM l
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l.provider_player_id) GROUP BY ALL""")
def stream_unresolved(spark, sf):
    """Lines per day, book and provider player that is no known customer; both sides, late rows too."""
    path, schema, grown = _written(spark, sf)
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("provider_player_id"))
    target = sinks.scratch_path(spark, "counts")
    keys = ["day", "book", "provider_player_id"]

    def batch(df, batch_id):
        missing = df.join(known, "provider_player_id", "left_anti").withColumn("day", F.to_date("captured_at"))
        stream.replace_batch(missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")), target, batch_id)

    stream.run_available(stream.line_stream(spark, path, schema, files_per_batch=3 * grown), sinks.scratch_path(spark, "count-progress"), batch=batch)
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("row_count").alias("row_count"))
