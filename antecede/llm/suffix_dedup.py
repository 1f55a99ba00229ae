"""Repeated strings of a fixed length, by sorting suffixes at a difference cover of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.anchors import Prefixes, anchors, mix
from antecede.llm.store import stored
from antecede.llm.textbytes import slices

#: Bits of the filters that go to every task; their size does not depend on the corpus.
FILTER_BITS = 27
_BUCKET = 1 << 15


def _filter(slots: DataFrame) -> Broadcast:
    """The slots (0 up to 2^FILTER_BITS) of a one-column frame as a broadcast bit field, put together in Spark."""
    value = F.col(slots.columns[0]) + 1
    parts = slots.groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    field = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        at = (row["bucket"] - 1) * (_BUCKET // 8)
        own = field[at:at + _BUCKET // 8]
        own[:] = np.frombuffer(row["bits"], np.uint8)[:len(own)]
    return slots.sparkSession.sparkContext.broadcast(field)


def _passes(field: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (field[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _gram_slot(gram: np.ndarray) -> np.ndarray:
    return gram >> np.uint64(64 - FILTER_BITS)


def _place_slot(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)


def _local(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.searchsorted(offsets, at, "right") - 1
    return owner, offsets[owner]


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _slots(texts: DataFrame, length: int) -> DataFrame:
    """gram of every sampled suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(buf, offsets, length)[0].view(np.int64))], ["gram"])

    return texts.mapInArrow(run, "gram bigint")


def _named(texts: DataFrame, length: int, repeated: Broadcast) -> DataFrame:
    """(gram, name, id, first, last, anchor) of the sampled suffixes whose gram may be repeated.

    The name is the hash of all bytes that the strings of the range hold, so equal names say equal strings at
    equal distances from the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            gram, anchor, first, last = anchors(buf, offsets, length)
            keep = np.flatnonzero(_passes(repeated.value, _gram_slot(gram)))
            gram, anchor, first, last = gram[keep], anchor[keep], first[keep], last[keep]
            name = Prefixes(buf).hash(first, last + length) ^ mix((anchor - first).astype(np.uint64))
            owner, base = _local(offsets, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(name.view(np.int64)), rows.column(0).take(pa.array(owner)),
                 *(pa.array((x - base).astype(np.int32)) for x in (first, last, anchor))], ["gram", "name", "id", "first", "last", "anchor"])

    return texts.mapInArrow(run, "gram bigint, name bigint, id bigint, first int, last int, anchor int")


def _bytes_of(texts: DataFrame, length: int, places: Broadcast) -> DataFrame:
    """(gram, id, first, last, left, right): reversed bytes before the anchor and bytes from it on, of the suffixes in ``places`` and of some others by false hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            gram, anchor, first, last = anchors(buf, offsets, length)
            owner, base = _local(offsets, first)
            ids = rows.column(0).to_numpy(zero_copy_only=False)[owner] if len(owner) else np.zeros(0, np.int64)
            keep = np.flatnonzero(_passes(places.value, _place_slot(ids, first - base)))
            data = buf.tobytes()
            left = [data[f:a][::-1] for f, a in zip(first[keep].tolist(), anchor[keep].tolist())]
            right = [data[a:e + length] for a, e in zip(anchor[keep].tolist(), last[keep].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[keep].view(np.int64)), pa.array(ids[keep].astype(np.int64)), *(pa.array((x - base)[keep].astype(np.int32)) for x in (first, last)),
                 pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["gram", "id", "first", "last", "left", "right"])

    return texts.mapInArrow(run, "gram bigint, id bigint, first int, last int, left binary, right binary")


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _with_neighbours(frame: DataFrame, column: str, out: str, end: str) -> DataFrame:
    """Sort by (gram, ``column``) over range partitions; ``out`` is the longest prefix shared with a neighbour.

    In sorted order no other row of the gram shares more than a neighbour does. At the ends of a partition the
    neighbour is elsewhere, so there ``out`` is an upper bound, the whole length. Ranges take in the place
    too, so rows that agree in everything else still spread over partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                done, before = measured(held, before, (batch.column("gram")[0].as_py(), batch.column(column)[0].as_py()))
                yield done
            held = batch
        if held is not None:
            yield measured(held, before, None)[0]

    def measured(batch: pa.RecordBatch, before, after):
        rows = list(zip(batch.column("gram").to_pylist(), batch.column(column).to_pylist()))
        chain = [before, *rows, after]
        common = [_shared(a[1], b[1]) if a is not None and b is not None and a[0] == b[0] else 0 if a is not None and b is not None else -1
                  for a, b in zip(chain, chain[1:])]
        best = [len(r[1]) if -1 in pair else max(pair) for r, pair in zip(rows, zip(common, common[1:]))]
        return batch.append_column(out, pa.array(best, pa.int32())), rows[-1]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    ordered = frame.repartitionByRange("gram", column, "id", "first").sortWithinPartitions("gram", column)
    return ordered.mapInArrow(run, f"{kinds}, {out} int")


def repeated_strings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row: UTF-8 bytes without those in a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or an earlier place in the same text; strings never cross texts and are judged on
    the input. ``kept`` is the rest, end to end.

    1. Sample: suffixes at anchors, a difference cover by content: wherever a string of ``length`` bytes
       occurs it holds an anchor at the same distance, so two equal strings always have a sampled suffix in
       common places. Grams that occur once drop out.
    2. Names: the bytes around an anchor get a name; of equal names only the earliest place goes on (all
       strings of the others start earlier elsewhere).
    3. Sort the suffixes that are left by gram and following bytes, compare neighbours, then the same for the bytes
       before. That bounds which starts before an anchor can be repeated at all.
    4. Merge the remaining suffixes: each such start is named by its whole string, and the earliest start of a
       name stays. Of grams with one name, which only false hits of the bit field let into step 3, the starts
       are joined out: of copies, it may let in the later ones alone, and the earliest of those is not the earliest of all. With several
       names the earliest copy is always there, and has every start that a later one has.

    NULL and empty texts keep nothing and lose nothing, as do texts under ``length``. Rows without an id are returned whole and
    remove nothing. Ids name texts: rows that share one do not remove each other's strings. Other columns
    are ignored; an empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text)
    judged = texts.where("id IS NOT NULL")
    counted = _slots(judged, length).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = _filter(counted.select(F.shiftrightunsigned("gram", 64 - FILTER_BITS)))
    place = F.struct("id", "first", "last", "anchor")
    names = stored(_named(judged, length, repeated).groupBy("gram", "name").agg(F.min(place).alias("at")).select("gram", "at.*"), "names")
    many = names.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    varied = names.join(many, "gram").select("id", "first")

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place_slot(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)).view(np.int64))], ["slot"])

    around = _bytes_of(judged, length, _filter(varied.mapInArrow(slot, "slot bigint")))
    before = F.length("left")
    by_right = _with_neighbours(around, "right", "after", "last").where(F.lit(length) - F.col("after") <= before)
    by_left = _with_neighbours(by_right, "left", "ahead", "first")
    # distances before the anchor at which a string may start, within the range of starts that the anchor serves
    far = F.least(F.col("ahead"), before)
    near = F.greatest(F.lit(length) - F.col("after"), before - F.col("last") + F.col("first"))
    starts = stored(by_left.where(far >= near).select("gram", "id", (F.col("first") + before - far).alias("s"), (F.col("first") + before - near).alias("e"),
                                                      (before - far).alias("skip"), F.concat(_reversed(F.col("left")), "right").alias("bytes")), "starts")
    each = starts.select("id", "s", "skip", "bytes", F.posexplode(F.sequence(F.col("s"), F.col("e"))).alias("k", "p"))
    string = F.substring("bytes", F.col("skip") + F.col("k") + 1, F.lit(length))
    first = each.select("id", "p", F.xxhash64(string).alias("h1"), F.xxhash64(F.lit("second"), string).alias("h2")).groupBy("h1", "h2").agg(
        F.min(F.struct("id", "p")).alias("at"))
    kinds = names.select("id", F.lit(0).alias("kind"), F.col("first").alias("s"), F.col("last").alias("e")).unionByName(
        starts.join(many, "gram", "left_semi").select("id", F.lit(1).alias("kind"), "s", "e")).unionByName(
        first.select("at.id", F.lit(2).alias("kind"), F.col("at.p").alias("s"), F.col("at.p").alias("e")))
    marks = kinds.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("kind", "s", "e")).alias("marks"))
    joined = texts.join(marks, F.col("id") == F.col("of"), "left").select("id", "text", "marks")
    return joined.mapInArrow(lambda b: _cut(b, length, repeated), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _cut(batches: Iterator[pa.RecordBatch], length: int, repeated: Broadcast) -> Iterator[pa.RecordBatch]:
    """Starts served by repeated grams go, but for the marks: named ranges (0) without the starts of step 4 (1), and those of them that stay (2)."""
    for rows, buf, offsets in slices(batches):
        gram, _, first, last = anchors(buf, offsets, length)
        hit = _passes(repeated.value, _gram_slot(gram))
        turn = np.zeros(len(buf) + 2, np.int32)
        np.add.at(turn, first[hit], 1)
        np.add.at(turn, last[hit] + 1, -1)
        gone = np.cumsum(turn[:-1]) > 0
        lists = rows.column("marks")
        sizes = np.nan_to_num(np.array(lists.value_lengths().to_pylist(), float)).astype(np.int64)
        owner = np.repeat(np.arange(rows.num_rows), sizes)
        flat = lists.flatten()
        kind, s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        judged = np.zeros(len(buf) + 1, bool)
        for k, value in ((0, False), (1, True), (2, False)):
            own = kind == k
            turn = np.zeros(len(buf) + 2, np.int32)
            np.add.at(turn, s[own] + offsets[owner[own]], 1)
            np.add.at(turn, e[own] + 1 + offsets[owner[own]], -1)
            marked = np.cumsum(turn[:-1]) > 0
            if k == 1:
                judged = marked
            gone[marked & judged if k == 2 else marked] = value
        if len(rows.column("id").drop_null()) < rows.num_rows:
            for i in np.flatnonzero(rows.column("id").is_null().to_numpy(zero_copy_only=False)):
                gone[offsets[i]:offsets[i + 1]] = False
        at = np.flatnonzero(gone)
        turn = np.zeros(len(buf) + 1, np.int32)
        np.add.at(turn, at, 1)
        np.add.at(turn, at + length, -1)
        covered = np.cumsum(turn)[:-1] > 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        begins = np.zeros(len(buf), bool)
        if len(buf):
            begins = covered & (np.concatenate([[True], ~covered[:-1]]) | edge[:-1])
        count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])
        data = buf[~covered].tobytes()
        left = np.concatenate([[0], np.cumsum(~covered)])[offsets]
        kept = [data[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
        yield pa.RecordBatch.from_arrays([rows.column("id"), *(pa.array(x.astype(np.int64)) for x in (np.diff(offsets), count(covered), count(begins))),
                                          pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _reversed(col: Column) -> Column:
    """Bytes in reverse order."""
    return F.unhex(F.regexp_replace(F.reverse(F.hex(col)), "(.)(.)", "$2$1"))
