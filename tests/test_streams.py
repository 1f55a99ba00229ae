import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from antecede.streaming import lines as stream

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("captured_at", T.TimestampType()),
                       T.StructField("start_at", T.TimestampType())])


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("id,v,captured_at,start_at\n" + "".join(f"{i},{v},{c},{s}\n" for i, v, c, s in rows))


def test_merging_stream_resumes_and_replays(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def batch(df, batch_id):
        rows = df.select("id", "v", F.to_date("start_at").alias("day"), F.struct("captured_at", "v").alias("last"))
        stream.merge_partitions(rows, out, ["id"], "day", {"last": F.max("last")})

    def got():
        return {(r.id, r.last.v) for r in spark.read.parquet(out).collect()}

    put(src, "a.csv", [("x", 1, "2026-01-01T08:00:00Z", "2026-01-02T00:00:00Z"), ("y", 2, "2026-01-01T08:00:00Z", "2026-01-03T00:00:00Z")])
    stream.run_available(stream.line_stream(spark, str(src), SCHEMA), mark, batch=batch)
    put(src, "b.csv", [("x", 5, "2026-01-01T09:00:00Z", "2026-01-02T00:00:00Z"), ("z", 7, "2026-01-01T09:00:00Z", "2026-01-02T00:00:00Z")])
    stream.run_available(stream.line_stream(spark, str(src), SCHEMA), mark, batch=batch)
    want = {("x", 5), ("y", 2), ("z", 7)}
    assert got() == want
    for name in ("b.csv", "a.csv"):  # a replayed batch changes nothing, nor does an older one that comes late
        batch(spark.read.schema(SCHEMA).option("header", True).csv(str(src / name)), 1)
        assert got() == want


LINES = T.StructType([T.StructField("key", T.StringType()), T.StructField("side", T.StringType()), T.StructField("price", T.IntegerType()),
                      T.StructField("at", T.IntegerType()), T.StructField("snapshot", T.IntegerType())])


@pytest.mark.parametrize("files_per_batch", [1, 3, None])
def test_sides_in_different_batches_make_one_row(spark, tmp_path, files_per_batch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k, row in enumerate(["a,over,5,2,1", "a,under,7,1,1", "a,over,4,1,1", "b,under,3,1,1", "c,over,9,1,2"]):
        (src / f"{k}.csv").write_text("key,side,price,at,snapshot\n" + row + "\n")
    stream.run_available(stream.line_stream(spark, str(src), LINES, files_per_batch), str(tmp_path / "mark"),
                         batch=lambda df, _: stream.merge_sides(df, out, ["key"], "snapshot", ["at"]))
    got = {r.key: (r.over and r.over.price, r.under and r.under.price) for r in spark.read.parquet(out).collect()}
    assert got == {"a": (5, 7), "b": (None, 3), "c": (9, None)}


def test_replayed_batches_are_counted_once(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("x", 2)], "id string, row_count int")
    for batch_id in (0, 1, 1):
        stream.replace_batch(rows, out, batch_id)
    assert spark.read.parquet(out).agg(F.sum("row_count")).first()[0] == 4


def test_late_and_repeated_rows_are_dropped(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    ok = ("x", 1, "2026-01-01T08:00:00Z", "2026-01-01T12:00:00Z")
    put(src, "a.csv", [ok, ok, ("late", 1, "2026-01-01T12:00:00Z", "2026-01-01T12:00:00Z")])
    kept = stream.without_late_and_repeated(stream.line_stream(spark, str(src), SCHEMA), ["id"])
    stream.run_available(kept, str(tmp_path / "mark"), path=out)
    assert [r.id for r in spark.read.parquet(out).collect()] == ["x"]


def test_daily_counts(spark, tmp_path):
    src, seen = tmp_path / "in", []
    put(src, "a.csv", [("x", 1, "2026-01-01T08:00:00Z", ""), ("x", 1, "2026-01-01T23:00:00Z", ""), ("x", 1, "2026-01-02T00:00:00Z", "")])
    counted = stream.daily_counts(stream.line_stream(spark, str(src), SCHEMA), ["id"])
    stream.run_available(counted, str(tmp_path / "mark"), mode="update", batch=lambda df, _: seen.extend(map(tuple, df.collect())))
    assert sorted(seen) == [(dt.date(2026, 1, 1), "x", 2), (dt.date(2026, 1, 2), "x", 1)]


def test_a_merge_leaves_the_table_and_nothing_else(spark, tmp_path):
    import os

    from antecede.operators.sinks import scratch_path
    from antecede.session import ensure_checkpoint_dir

    def stored_files(top):
        return sorted(os.path.join(d, f) for d, _, files in os.walk(top) for f in files)

    ensure_checkpoint_dir(spark)
    kept, out = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:"), str(tmp_path / "out")
    before = stored_files(kept)
    for n in range(3):
        rows = spark.range(200).selectExpr(f"id % 50 + {10 * n} AS id", "id AS v", "id % 4 AS day")
        stream.merge_partitions(rows, out, ["id"], "day", {"v": F.max("v")})
    assert stored_files(kept) == before
    want = spark.range(3).selectExpr("id AS n").crossJoin(spark.range(200)).selectExpr("id % 50 + 10 * n AS id", "id AS v", "id % 4 AS day").groupBy("id", "day").agg(F.max("v").alias("v"))
    got = spark.read.parquet(out).selectExpr("id", "CAST(day AS BIGINT) AS day", "v")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_repeated_snapshots_are_written_compressed_from_one_join(spark, sf):
    from antecede.catalog import streams, views

    path, schema, _ = streams._written(spark, sf, repeat=True)
    rows = views.lines(spark, sf)
    files = spark.read.schema(schema).option("header", True).csv(path)
    assert files.count() == rows.count() + rows.where("side = 'under'").count()
    assert all(f.endswith(".csv.gz") for f in files.inputFiles())
