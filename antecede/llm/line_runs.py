"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.llm.store import shared_folder, stored

BLANKS = " \t\n\x0b\f\r"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case; other letters stay."""
    bare = F.trim(line, F.lit(BLANKS))
    # for ASCII lower() is the same and much faster
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOW))


def key_hash(key: Column) -> list[Column]:
    """128 bits of the key in two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, h1, h2, chars) of every line; a NULL or empty text is one empty line."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).alias("pos", "line"))
    key = split.select("id", "pos", line_key(F.col("line")).alias("key"))
    return key.select("id", "pos", *key_hash(F.col("key")), F.length("key").alias("chars"))


@dataclass
class LineRuns:
    """Runs of (h1, h2, n), sorted by hash: in how many documents of its batches a line key occurs.

    Every added batch becomes a run of level 0. Where a level holds ``fan`` runs they are merged into one of
    the next, so n batches leave O(log n) runs and each row is rewritten O(log n) times. Keys that one run
    already knows in ``enough`` documents are anti-joined out of later batches: they need no more counting.
    Runs are range partitioned and sorted Parquet folders; they are written once and never changed, so a
    retried batch only leaves a folder that nothing reads.
    """

    spark: SparkSession
    enough: int
    fan: int = 4
    levels: list[list[str]] = field(default_factory=list)

    SCHEMA = "h1 bigint, h2 bigint, n bigint"

    def _write(self, run: DataFrame) -> str:
        path = shared_folder(self.spark, "line-run")
        run.repartitionByRange("h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def read(self, paths: list[str] | None = None) -> DataFrame:
        """All runs together, one row per key and run."""
        paths = [p for level in self.levels for p in level] if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def add(self, keys: DataFrame) -> None:
        """``keys`` has h1, h2: each key once per document of the batch."""
        run = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if self.levels:
            known = self.read().where(F.col("n") >= self.enough).select("h1", "h2")
            run = run.hint("merge").join(known, ["h1", "h2"], "left_anti")
        self._push(0, self._write(run))

    def _push(self, level: int, path: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == self.fan:
            merged = self._write(self.read(self.levels[level]).groupBy("h1", "h2").agg(F.sum("n").alias("n")))
            self.levels[level] = []
            self._push(level + 1, merged)

    def frequent(self) -> DataFrame:
        """(h1, h2) of keys in at least ``enough`` documents of all batches so far."""
        return self.read().groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.enough).select("h1", "h2")


def batch_keys(docs: DataFrame, batches: int, min_chars: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, h1, h2), each key once per row of ``docs``: repeats within a row go before anything is exploded."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1), line_key))
    split = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key"))
    return split.where(F.length("key") >= min_chars).select("batch", *key_hash(F.col("key")))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept): every row as a struct, and its text without the lines whose key is in at least ``min_docs`` rows.

    Counts cover all rows: the table is added to the runs in batches, then every line is looked up in the
    merged runs. A key that occurs twice in one row counts once. NULL and empty texts are one empty line, which
    has no key of ``min_chars`` and stays; a NULL text comes back empty. Repeated rows and rows of one id count each
    and get equal answers. An empty table gives an empty result. Other columns stay inside ``row``.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-keys")
    batch_keys(docs, batches, min_chars, id_col, text).write.partitionBy("batch").parquet(folder)  # every text is read and split once
    stage = spark.read.schema("h1 bigint, h2 bigint, batch int").parquet(folder)
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(stage.where(F.col("batch") == batch).select("h1", "h2"))
    common = stored(runs.frequent(), "common-lines")
    lines = lines_of(docs, id_col, text).where(F.col("chars") >= min_chars)
    hits = lines.join(common, ["h1", "h2"]).groupBy(F.col("id").alias("hit")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))  # every text moves once
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit")), "left")
    split = joined.select("row", "gone", F.split(F.coalesce(F.col("row")[text].cast("string"), F.lit("")), "\n", -1).alias("lines"))
    stay = F.filter("lines", lambda x: ~F.array_contains("gone", F.struct(*[c.alias(n) for c, n in zip(key_hash(line_key(x)), ("h1", "h2"))])))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay)
    return split.withColumn("stay", kept).select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
                                                 F.array_join("stay", "\n").alias("kept"))
