"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.store import stored

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"

#: A group with more words, or more code points, is cut by halving the place of the first difference.
GROUP_WORDS, GROUP_POINTS = 512, 1 << 18
#: Small groups are compared together in tiles of about this many words.
TILE = 96
#: Cells of one comparison: words x words x code points.
CELLS = 1 << 22

FOUND = "word string, n_near bigint, near_n bigint, near string"


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOW))


def damaged_words(docs: DataFrame, every: int = 97, shortest: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): the letter runs of all texts; where ``every`` divides a run's checksum, one of its letters is missing.

    A NULL text has no runs; a NULL id is the empty string in the checksum. Runs shorter than ``shortest`` are left out.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.where(F.length("run") >= shortest).select("id", ascii_lower(F.col("run")).alias("run"))
    mark = low.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return mark.select(F.when(F.pmod(F.col("h"), F.lit(every)) == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(words: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what all words of a group share: their first p and their last m - q code points."""
    return rows.select("word", "n", "m", "p", "q", F.expr("left(word, p)").alias("head"), F.expr("right(word, m - q)").alias("tail"))


KEY = ["m", "p", "q", "head", "tail"]


def _halves() -> Column:
    middle = F.expr("(p + q + 1) div 2").cast("int")
    return F.explode(F.array(F.struct(F.col("p").alias("p"), middle.alias("q")), F.struct(middle.alias("p"), F.col("q").alias("q")))).alias("half")


def groups(words: DataFrame) -> DataFrame:
    """(m, p, q, members): bounded groups such that each pair of near words is in exactly one whose [p, q) holds its first difference.

    Two words one edit apart, the longer of m code points, that first differ at place c with p <= c < q share their first
    p and last m - q code points. Every word stands in the groups of m = its length and m = its length + 1. A group
    that is too large is cut at the middle of [p, q); one of a single place holds words that all are near each other,
    so it has no more words than there are letters, plus one. Groups of one word are left out.
    """
    grown = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"))
    rows = _keyed(grown.select("*", F.lit(0).alias("p"), F.col("m").alias("q")).select("word", "n", "m", _halves())
                  .select("word", "n", "m", "half.*"))
    done: DataFrame | None = None
    while True:
        rows = stored(rows, "spelling-rows")
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
        large = (F.col("size") > GROUP_WORDS) | (F.col("size") * F.col("m") > GROUP_POINTS)
        hot = stored(sizes.where(large & (F.col("q") - F.col("p") > 1)).select(*KEY), "spelling-hot")
        last = hot.isEmpty()
        rest = rows if last else rows.join(hot, KEY, "left_anti")
        packed = rest.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("members"))
        packed = packed.where(F.size("members") > 1).select("m", "p", "q", "members")
        done = packed if done is None else done.unionByName(packed)
        if last:
            return done
        rows = _keyed(rows.join(hot, KEY, "left_semi").select("word", "n", "m", _halves()).select("word", "n", "m", "half.*"))


def _matrices(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left-aligned, right-aligned and reversed code points, lengths); zero pads, so code points are one more."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4") + np.uint32(1)
    if len(points) and points.max() < 1 << 16:
        points = points.astype(np.uint16)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    inside = np.arange(m) < sizes[:, None]
    left, right = np.zeros((2, len(words), m), points.dtype)
    left[inside] = points
    right[inside[:, ::-1]] = points
    return left, right[:, ::-1], sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` with every row of ``b``."""
    unlike = a[:, None, :] != b[None, :, :]
    first = unlike.argmax(axis=2)
    return np.where(unlike.any(axis=2), first, a.shape[1])


def near_in_tile(members: list[tuple[int, str]], m: int, p: int, q: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for near pairs whose longer word has m code points and that first differ in [p, q).

    Words of several groups of the same m, p and q may stand in one tile: a near pair is always of one group.
    """
    members = sorted(members, key=lambda x: (-x[0], x[1]))  # the first near word of a row is its best
    words = [w for _, w in members]
    left, right, sizes = _matrices(words, m)
    step = max(1, CELLS // (len(words) * m))
    for first in range(0, len(words), step):
        rows = slice(first, first + step)
        start = _common(left[rows], left)
        near = (start >= p) & (start < q) & (start + _common(right[rows], right) >= m - 1)
        near &= np.maximum(sizes[rows, None], sizes) == m
        counts = near.sum(axis=1)
        best = near.argmax(axis=1)
        for i in np.flatnonzero(counts):
            yield words[first + i], int(counts[i]), members[best[i]][0], words[best[i]]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[tuple[int, int, int], list[tuple[int, str]]] = {}
    points = 0

    def found(keys: list[tuple[int, int, int]]) -> pa.RecordBatch:
        rows = [r for key in keys for r in near_in_tile(waiting.pop(key), *key)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], ["word", "n_near", "near_n", "near"])

    for batch in batches:
        for m, p, q, members in zip(*(c.to_pylist() for c in batch.columns)):
            tile = waiting.setdefault((m, p, q), [])
            tile += [(x["n"], x["word"]) for x in members]
            points += m * len(members)
            if len(tile) >= TILE:
                points -= m * len(tile)
                yield found([(m, p, q)])
            elif points > GROUP_POINTS:
                yield found(list(waiting))
                points = 0
    if waiting:
        yield found(list(waiting))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words of ``words`` (word, n; each word once) that have a near word: how many, and the one of
    largest n, of equal ones the first in code-point order. Near: exactly one inserted, deleted or replaced code point."""
    found = groups(words).mapInArrow(_tiles, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def _followed(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps; n doubles with each, so rounds are few."""
    now = stored(links.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    A word's form is its near word of largest n if that is at least ``times`` its own n; root follows forms to the last,
    or is the word itself. ``times`` must be over 1, so that forms never run in a circle. An empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("times must be over 1")
    words = stored(words, "vocabulary")
    near = near_words(words).withColumnRenamed("word", "w")
    enough = F.col("near_n") >= times * F.col("n")
    forms = stored(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near")).alias("form"),
        F.when(enough, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = _followed(forms.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    out = forms.join(roots, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
