"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from antecede.llm.graph import components
from antecede.llm.store import stored
from antecede.llm.textbytes import LOWER, single_spaced, slices, sums, words, xxh64

#: The segments are pairs of bits; the axes of the grid are runs of them, at least and at most so many.
SEGMENTS = 32
AXES_LEAST, AXES_MOST = 6, 16
#: Chance that two random pairs of bits have equal counts.
EQUAL_COUNT = 3 / 8
#: A cell with more fingerprints is compared in blocks of about this size, each pair of blocks in its own row.
BLOCK = 1024

_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).view("<u8")[:, 0]


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every run of ``width`` words, number of runs per text); fewer words make one run."""
    begins, ends, owner = words(buf, offsets)
    spaced, begins, ends = single_spaced(LOWER[buf], begins, ends)
    n_words = np.bincount(owner, minlength=len(offsets) - 1)
    runs = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = np.repeat(np.cumsum(n_words) - n_words - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    last = first + np.repeat(np.minimum(n_words, width), runs) - 1
    return xxh64(spaced, begins[first], ends[last]), runs


def majority_bits(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """64-bit fingerprint per text: a bit is set if over half of the text's hashes have it."""
    parts = -(-runs // 255)  # a byte counts to 255
    begins = np.repeat(np.cumsum(runs) - runs - 255 * (np.cumsum(parts) - parts), parts) + 255 * np.arange(parts.sum())
    planes = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(runs), np.uint64)
    for k in range(8 if len(begins) else 0):
        counts = np.add.reduceat(_SPREAD[planes[:, k]], begins).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = sums(counts.astype(np.int64), parts)
        bits = (2 * total > runs[:, None]).astype(np.uint8)
        out |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint long) of every row; a NULL or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            marks = majority_bits(*shingle_hashes(buf, offsets, width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(marks)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, fp bigint")


_LOW = 0x5555555555555555


def popcounts(fp: Column) -> Column:
    """The 32 counts of set bits of the pairs of bits, two bits each, as 00, 01 or 11.

    Written this way, counts that differ by d differ in d bits: the Manhattan distance of two embedded fingerprints is the number of
    differing bits of these longs. It is never more than that of the fingerprints themselves.
    """
    next_bit = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_LOW)), 1))


def embedded(fps: np.ndarray) -> np.ndarray:
    """:func:`popcounts` of an array of unsigned fingerprints."""
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fps | fps >> one) & low) | ((fps & fps >> one & low) << one)


def within(fps: np.ndarray, points: np.ndarray, a, b, bound: int) -> np.ndarray:
    """Whether the fingerprints at ``a`` and ``b`` lie within ``bound`` bits: exactly, where the Manhattan distance of their points allows it."""
    near = np.asarray(np.bitwise_count(points[a] ^ points[b]) <= bound)
    left, right = (np.broadcast_to(x, near.shape)[near] for x in (a, b))
    near[near] = np.bitwise_count(fps[left] ^ fps[right]) <= bound
    return near


def axes_of(n: int) -> list[int]:
    """Segments on each of ``n`` axes."""
    return [SEGMENTS // n + (k < SEGMENTS % n) for k in range(n)]


def random_pairs(axes: int, bound: int) -> float:
    """Cells that two random fingerprints share on average."""
    return fsum(EQUAL_COUNT ** sum(c) for c in combinations(axes_of(axes), axes - bound))


def axes_for(count: int, bound: int) -> int:
    """Number of axes with the fewest cells and expected candidates per fingerprint, of ``count`` random ones.

    More axes of which more must agree make more but far smaller cells. No link is lost with any number. Cells and candidates per
    fingerprint together grow from 20 (100,000) over 22 (a million), 38 (10 million) and 64 (100 million) to 129 (1,000 million).
    """
    def cost(m: int) -> float:
        return len(grid_masks(bound, m)) + count / 2 * random_pairs(m, bound)

    return min(range(max(AXES_LEAST, bound + 1), max(AXES_MOST, bound + 1) + 1), key=cost)


def grid_masks(bound: int, axes: int = AXES_LEAST) -> list[int]:
    """Bits of the counts that make a cell, for every choice of axes.

    Manhattan distance adds up over the axes, so counts within ``bound`` differ on at most ``bound`` of
    them and share the cell of at least one choice of the others.
    """
    bits, at = [], 0
    for n in axes_of(axes):
        bits.append(((1 << (2 * n)) - 1) << at)
        at += 2 * n
    masks = [sum(c) for c in combinations(bits, axes - bound)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, bound: int = 3, axes: int = AXES_LEAST) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``bound`` bits of each other.

    Candidates share a cell of the grid over their counts; of these, pairs within ``bound`` by Manhattan distance are verified.
    Within a block of a cell only a spanning star of each connected set is returned, so no group of
    n copies makes n² rows. Cells of any size are covered: large ones by all pairs of their blocks.
    """
    cells = fps.select("fp", F.posexplode(F.array(*[popcounts(F.col("fp")).bitwiseAND(F.lit(m)) for m in grid_masks(bound, axes)])).alias("axis", "cell"))
    sizes = cells.groupBy("axis", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = cells.join(sizes, ["axis", "cell"]).withColumn("parts", parts).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    spread = placed.select("axis", "cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = spread.groupBy("axis", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fp").alias("fps"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.values.to_numpy().view(np.uint64)
            edges = lists.offsets.to_numpy()
            points = embedded(values)
            left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            sizes = np.diff(edges)
            two = edges[:-1][sizes == 2]
            two = two[within(values, points, two, two + 1, bound)]
            left.append(values[two])
            right.append(values[two + 1])
            for k in np.flatnonzero(sizes > 2):
                at = np.arange(edges[k], edges[k + 1])
                own = values[at]
                near = within(values, points, at[:, None], at[None, :], bound)
                root = near.argmax(1)
                while True:
                    low = np.where(near, root[None, :], len(own)).min(1)
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
                off = np.flatnonzero(root != np.arange(len(own)))
                left.append(own[off])
                right.append(own[root[off]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)], ["a", "b"])

    return blocks.select("fps").mapInArrow(verify, "a bigint, b bigint").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bound: int = 3) -> DataFrame:
    """(id, fp, component, root) per row, as :func:`near_components`; root is the component's smallest fingerprint, its own name also
    where rows of unlike texts share an id."""
    fps = stored(fingerprints(docs, id_col, text, width), "fingerprints")
    smallest = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    roots = components(near_links(smallest.select("fp"), bound, axes_for(smallest.count(), bound))).withColumnsRenamed({"node": "fp"})
    joined = smallest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = joined.groupBy("root").agg(F.min("low").alias("component"))
    label = joined.join(low, "root").select("fp", "component", "root")
    return fps.join(label, "fp").select("id", "fp", "component", "root")


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bound: int = 3) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over fingerprints within ``bound`` bits.

    Equal texts and repeated rows share a fingerprint and so a component; NULL ids are no smallest id (a
    component of NULL ids alone has NULL). An empty table gives an empty one; other columns are ignored.
    Copies are one fingerprint from here on, so a group of copies of any size costs one row.
    """
    return near_classes(docs, id_col, text, width, bound).select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bound: int = 3) -> DataFrame:
    """The rows of ``docs`` of which one stays per component: that with the smallest id, of several texts of this id that with the
    smallest fingerprint, of equal ones any one. Rows without an id all stay. Every row is decided by its own text.

    An id that stands for one row decides for it, so whole rows meet ids only; rows whose id is repeated are told apart by their
    fingerprints, which are computed again for these rows alone. Columns come back as they were; an empty table gives an empty one.
    """
    rows = stored(near_classes(docs, id_col, text, width, bound).where("id IS NOT NULL").groupBy("id", "fp", "root").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    stay = stored(rows.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("s")).select("s.id", "s.fp"), "near-stay")
    per_id = rows.groupBy("id").agg(F.sum("n").alias("n")).join(stay.groupBy("id").agg(F.count(F.lit(1)).alias("kept")), "id", "left")
    per_id = stored(per_id, "near-ids")
    name = F.col("id").alias(id_col)
    gone = per_id.where("kept IS NULL OR n > 1").select(name)
    out = docs.hint("merge").join(gone, id_col, "left_anti").select(*docs.columns)  # the ids grow with the rows: never broadcast, at no size
    repeated = per_id.where("kept IS NOT NULL AND n > 1").select("id")
    if repeated.isEmpty():
        return out
    several = docs.join(repeated.select(name), id_col, "left_semi").select(*docs.columns)
    marked = _carried(several, id_col, text, width).join(stay, ["id", "fp"], "left_semi")
    return out.unionByName(marked.groupBy("id", "fp").agg(F.first("row").alias("row")).select("row.*"))


def _carried(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(row, id, fp): fingerprints beside their whole rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            marks = majority_bits(*shingle_hashes(buf, offsets, width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(marks)], ["row", "id", "fp"])

    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return whole.mapInArrow(run, T.StructType([whole.schema["row"], whole.schema["id"], T.StructField("fp", T.LongType())]))
