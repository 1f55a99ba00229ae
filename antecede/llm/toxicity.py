"""Toxicity: cumulative-link (proportional odds) ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.textbytes import LOWER, slices, sums, xxh64

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: At most about this many labelled texts of each grade are used to fit (whole texts, chosen by hash).
FIT_TEXTS = 3000
#: A word counts only if at least this many of those texts have it; rarer ones would be learnt by heart.
FIT_MIN_TEXTS = 5
STEPS = 200
RIDGE = 1e-3

#: Bytes of words: ASCII letters, digits, and all bytes of longer characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows (bucket, weight, offsets): log-scaled counts of the hashed words of each text, repeats merged."""
    full = np.zeros(len(buf) + 2, bool)
    full[1:-1] = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(full[1:-1] & (~full[:-2] | edge[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | edge[1:])) + 1
    owner = np.searchsorted(offsets, begins, "right") - 1
    bucket = (xxh64(LOWER[buf], begins, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    rows = np.bincount(cell // BUCKETS, minlength=len(offsets) - 1)
    return cell % BUCKETS, np.log1p(n), np.concatenate([[0], np.cumsum(rows)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - cut[k]): one weight vector for all thresholds, cuts in ascending order."""

    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) per text and threshold."""
        score = sums(self.weights[bucket] * value, np.diff(offsets))
        return _sigmoid(score[:, None] - self.cuts)


def fit_rows(bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray, grade: np.ndarray, top: int) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on the whole sample; grades 0..top, classes weigh alike.

    Each word enters scaled by the log ratio of the shares of texts above and of grade 0 that hold it,
    so words that tell nothing hardly count; the scale is part of the weights that are returned.
    """
    n = len(grade)
    common = np.bincount(bucket, minlength=BUCKETS)[bucket] >= FIT_MIN_TEXTS
    row = np.repeat(np.arange(n), np.diff(offsets))[common]
    bucket, value, per_row = bucket[common], value[common], np.bincount(row, minlength=n)
    above = grade > 0
    share = [(np.bincount(bucket[m[row]], minlength=BUCKETS) + 1) / (m.sum() + 2) for m in (above, ~above)]
    scale = np.log(share[0] / share[1])
    value = value * scale[bucket]
    size = np.bincount(grade, minlength=top + 1)
    weight = (1 / np.maximum(size, 1))[grade]
    weight /= weight.sum()
    present = np.maximum(size, 0.5) / np.maximum(size, 0.5).sum()
    base = 1 - np.cumsum(present)[:-1]
    # cuts = first + sums of exp(gaps): they stay in order
    cuts = -np.log(base / (1 - base))
    theta = [np.zeros(BUCKETS), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))]
    first = [np.zeros_like(t) for t in theta]
    second = [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        w, c0, gaps = theta
        cuts = np.concatenate([c0, c0 + np.cumsum(np.exp(gaps))])
        over = _sigmoid(sums(w[bucket] * value, per_row)[:, None] - cuts)
        bounds = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
        upper, lower = bounds[np.arange(n), grade], bounds[np.arange(n), grade + 1]
        p = np.maximum(upper - lower, 1e-12)
        slope = over * (1 - over)
        slopes = np.hstack([np.zeros((n, 1)), slope, np.zeros((n, 1))])
        up, lo = slopes[np.arange(n), grade] / p * weight, slopes[np.arange(n), grade + 1] / p * weight
        by_cut = np.zeros((n, top + 2))
        by_cut[np.arange(n), grade] += up
        by_cut[np.arange(n), grade + 1] -= lo
        d_cut = by_cut[:, 1:-1].sum(0)  # of the negative log likelihood
        d_w = np.bincount(bucket, (lo - up)[row] * value, BUCKETS) + RIDGE * w
        tail = np.cumsum(d_cut[::-1])[::-1]
        grads = [d_w, tail[:1], tail[1:] * np.exp(gaps)]
        for t, g, m, v in zip(theta, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            t -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    w, c0, gaps = theta
    return OrdinalModel(w * scale, np.concatenate([c0, c0 + np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, grades: DataFrame, top: int, text: str = "text", grade: str = "grade", key: str = "doc_id") -> OrdinalModel | None:
    """Fit on about FIT_TEXTS whole texts of each grade 0..top; ``grades`` has (key, grade), rows without a grade are left out.

    The keys of the sample are chosen from the grades alone and broadcast, as their number is bounded by the
    parameter: texts are never shuffled. The sample becomes features in Spark and is fitted in one place.
    Without a graded row there is no model.
    """
    grades = grades.select(F.col(key).alias("key"), F.col(grade).cast("int").alias("grade")).where(F.col("grade").between(0, top))
    sizes = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, FIT_TEXTS / n)])
    chosen = grades.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share[F.col("grade")] * 1_000_003)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    drawn = texts.join(F.broadcast(chosen), "key")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            bucket, value, edges = word_features(buf, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("grade"), *lists], ["key", "grade", "bucket", "value"])

    kind = texts.schema["key"].dataType.simpleString()
    sample = drawn.select("key", "text", "grade").mapInArrow(features, f"key {kind}, grade int, bucket array<int>, value array<float>").toArrow().combine_chunks()
    sample = sample.sort_by([("key", "ascending")])
    bucket, value = sample["bucket"].combine_chunks(), sample["value"].combine_chunks()
    counts = np.array([0 if x is None else x for x in bucket.value_lengths().to_pylist()], np.int64)
    return fit_rows(bucket.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float),
                    np.concatenate([[0], np.cumsum(counts)]), sample["grade"].to_numpy().astype(np.int64), top)


def grade_of(toxic: Column, quality: Column) -> Column:
    """Severity grade of a label: 0 not toxic, 1 toxic, 2 toxic in a text that is of no quality either."""
    return F.when(toxic == 0, 0).when((toxic == 1) & (F.coalesce(quality, F.lit(1)) == 1), 1).when(toxic == 1, 2)


def score(docs: DataFrame, model: OrdinalModel | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, severity, grade, toxic) per row: expected grade, grade with most probability, P(grade > 0) of a half or more.

    A text without words (NULL, empty) has severity 0 and is not toxic, as has every text without a
    model. Repeated rows get equal answers, NULL ids are carried along, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared.value is None else OrdinalModel(*shared.value)
        for rows, buf, offsets in slices(batches):
            bucket, value, edges = word_features(buf, offsets)
            n = rows.num_rows
            over = np.zeros((n, 1)) if known is None else known.exceed(bucket, value, edges)
            over[np.diff(edges) == 0] = 0
            p = -np.diff(np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(over.sum(1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)],
                                             ["id", "severity", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, severity double, grade int, toxic boolean")
