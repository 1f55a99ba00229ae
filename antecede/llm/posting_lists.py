"""Approximate nearest neighbours by inner product: balanced posting lists with an in-memory graph of centroids."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.llm.store import stored

#: Vectors a list should hold; LISTS_MOST bounds the centroids (and so what is broadcast), beyond it lists grow.
LIST_ROWS = 128
LISTS_MOST = 1024
#: Vectors used to fit the centroids (chosen by hash); every vector is indexed.
FIT_ROWS = 20_000
#: A vector is in the lists of up to REPLICAS centroids no further than NEAR times its nearest.
REPLICAS = 3
NEAR = 1.1
#: A query reads the lists of centroids no further than REACH times the nearest one that it found.
REACH = 1.17
#: And further ones until those read are the nearest of so many times the rows asked for.
ENOUGH = 100
#: Rows of a list, and queries of a list, that are compared at once.
BLOCK = 2048
LINKS = 24
ENTRIES = 8
#: Found rows that a task keeps before it merges them, and before it hands them on.
HELD = 1_000_000


@dataclass
class Centroids:
    """Centroids (with the lifted coordinate), links of their graph, the largest norm in the table, vectors nearest to each."""

    points: np.ndarray
    links: np.ndarray
    norm: float
    sizes: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with a coordinate that makes all norms equal: nearest then means largest inner product."""
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def lists_of(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Lists of each vector: the nearest centroid's, then those of the boundary it lies on."""
        p = self.points
        x = self.lifted(x)
        far = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0))
        n = min(REPLICAS, len(p))
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(near, np.take_along_axis(far, near, 1).argsort(1, kind="stable"), 1)
        d = np.take_along_axis(far, near, 1)
        keep = d <= NEAR * d[:, :1]
        for row, ok in zip(near, keep):
            yield row[ok]

    def search(self, q: np.ndarray, least: int = 0) -> list[int]:
        """Lists for a query: best-first over the graph, as far as the distance ratio allows and until ``least`` vectors are in them.

        A vector counts in the list of its nearest centroid only, so replicas are not counted twice.
        """
        q = np.append(q, 0.0)
        seen = np.zeros(len(self.points), bool)
        heap: list[tuple[float, int]] = []

        def visit(nodes: np.ndarray) -> None:
            new = nodes[~seen[nodes]]
            seen[new] = True
            d = np.sqrt(((self.points[new] - q) ** 2).sum(1))
            for pair in zip(d.tolist(), new.tolist()):
                heapq.heappush(heap, pair)

        visit(np.unique(np.linspace(0, len(self.points) - 1, ENTRIES).astype(int)))
        best, found, held = math.inf, [], 0
        while heap:
            d, k = heapq.heappop(heap)
            best = min(best, d)
            if d > REACH * best and len(found) >= ENTRIES and held >= least:
                break
            found.append((d, k))
            held += self.sizes[k] if least else 0
            visit(self.links[k])
        lists, held = [], 0
        for d, k in sorted(found):
            if d > REACH * best and held >= least:
                break
            lists.append(k)
            held += self.sizes[k] if least else 0
        return lists


def fit_centroids(x: np.ndarray, lists: int, norm: float) -> Centroids:
    """k-means in which a list's share of the sample makes it less attractive, so lists come out balanced."""
    rng = np.random.default_rng(7)
    base = Centroids(np.zeros((1, x.shape[1] + 1)), np.zeros((1, 0), int), norm)
    x = base.lifted(x)
    lists = max(1, min(lists, len(x)))
    p = x[rng.permutation(len(x))[:lists]].copy()
    weight = np.zeros(lists)
    for _ in range(10):
        far = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
        own = (far + weight).argmin(1)
        size = np.bincount(own, minlength=lists)
        weight += 0.1 * np.mean(np.maximum(far[np.arange(len(x)), own], 0)) * (size * lists / len(x) - 1).clip(-1, 3)
        total = np.zeros_like(p)
        np.add.at(total, own, x)
        p = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], p)
    far = (p * p).sum(1)[:, None] - 2 * p @ p.T + (p * p).sum(1)
    near = np.argsort(far, axis=1)[:, :LINKS]
    ring = (np.arange(lists)[:, None] + 1) % lists  # keeps the graph in one piece
    some = rng.integers(0, lists, (lists, 4))
    return Centroids(p, np.hstack([near, ring, some]), norm)


def _usable(vec: Column, dims: int) -> Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(vec) == dims) & finite & F.exists(vec, lambda v: v != 0)


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query, each vector once."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # a vector has the same score in each of its lists
    q, v, s = q[fresh], v[fresh], s[fresh]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(q) else np.zeros(0, int)
    return q[rank < k], v[rank < k], s[rank < k]


def _compare(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (query ids, query vectors, ids, vectors) of one block each to the k best of each query."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def merged(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        best = _best(*(np.concatenate([h[i] for h in held]) for i in range(3)), k)
        held, rows = [best], len(best[0])
        if last or rows > HELD // 2:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in best], ["query_id", "rep", "score"])
            held, rows = [], 0

    for batch in batches:
        for i in range(batch.num_rows):
            qid, qvec, vid, vec = (batch.column(c)[i].values for c in range(4))
            qid, vid = qid.to_numpy(), vid.to_numpy()
            qvec = qvec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            vec = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            rough = qvec @ vec.T
            n = min(k + 8, len(vid))
            pick = np.argpartition(-rough, n - 1, axis=1)[:, :n]
            # scored pair by pair, so equal vectors get equal scores wherever they stand
            exact = (qvec[:, None, :] * vec[pick]).sum(2)
            held.append((np.repeat(qid, n), vid[pick].reshape(-1), exact.reshape(-1)))
            rows += len(held[-1][0])
            if rows > HELD:
                yield from merged(False)
    if held:
        yield from merged(True)


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product, for every query row.

    Equal vectors are one vector in the index, with their k + 1 smallest ids: more of them can't be among the best
    of any query, so a vector that a third of the rows share costs one posting. Lists beyond BLOCK
    rows, and lists that many queries read, are compared in blocks, so no list is a single task.

    Left out: NULL, zero or non-finite vectors, those with NULLs, those of another length than most, and rows
    without an id. Rows that repeat an id and vector count once. Other columns are ignored. With no
    usable vector the result is empty.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("asks")).where(
        "id IS NOT NULL AND vec IS NOT NULL")
    common = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = stored(rows.where(_usable(F.col("vec"), dims)).dropDuplicates(["id", "vec"]), "vectors")
    first = Window.partitionBy("vec").orderBy("id")
    few = rows.select("id", "vec").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = stored(few.groupBy("vec").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members")), "vectors")
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).alias("norm")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < FIT_ROWS / facts["n"] * 1_000_003).orderBy("rep").limit(2 * FIT_ROWS)
    fitted = np.array([r["vec"] for r in sample.select("vec").toLocalIterator()]).reshape(-1, dims)
    if not len(fitted):
        fitted = np.array([distinct.first()["vec"]])
    shape = fit_centroids(fitted, min(LISTS_MOST, -(-facts["n"] // LIST_ROWS)), facts["norm"])
    shared = spark.sparkContext.broadcast((shape.points, shape.links, shape.norm))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Centroids(*shared.value)
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            own = [lists for a in range(0, len(x), BLOCK) for lists in known.lists_of(x[a:a + BLOCK])]
            yield batch.append_column("lists", pa.array(own, pa.list_(pa.int64())))

    schema = "id bigint, vec array<double>, lists array<bigint>"
    placed = stored(distinct.select(F.col("rep").alias("id"), "vec").mapInArrow(place, schema), "postings")
    sizes = np.zeros(len(shape.points), np.int64)
    for row in placed.groupBy(F.get("lists", F.lit(0)).alias("list")).count().toLocalIterator():  # a row per centroid at most
        sizes[row["list"]] = row["count"]
    counted = spark.sparkContext.broadcast(sizes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Centroids(*shared.value, counted.value)
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield batch.append_column("lists", pa.array([known.search(q, ENOUGH * (k + 1)) for q in x], pa.list_(pa.int64())))

    def blocked(frame: DataFrame, ids: str, vecs: str) -> DataFrame:
        """Arrays of about BLOCK rows of each list."""
        spread = frame.select("id", "vec", F.explode("lists").alias("list"))
        sizes = spread.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # a row per centroid at most
        cut = spread.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        return cut.groupBy("list", "part").agg(F.collect_list(F.struct("id", "vec")).alias("rows")).select(
            "list", F.col("rows.id").alias(ids), F.col("rows.vec").alias(vecs))

    postings = blocked(placed, "vid", "vec")
    asks = blocked(stored(rows.where("asks").select("id", "vec").repartition(F.col("id")).mapInArrow(route, schema), "queries"), "qid", "qvec")
    pairs = asks.join(postings, "list").select("qid", "qvec", "vid", "vec")
    found = pairs.mapInArrow(lambda b: _compare(b, dims, k + 1), "query_id bigint, rep bigint, score double").dropDuplicates(["query_id", "rep"])
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    best = found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).drop("n")
    named = best.join(distinct.select("rep", "members"), "rep").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
