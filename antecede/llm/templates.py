"""Benchmark decontamination by question templates: typed placeholders, joined windows, consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm.store import stored
from antecede.llm.textbytes import LOWER, slices, xxh64

# fixed values: words that are units when a number stands before them
UNITS = """
mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces
ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years percent degree degrees dollar dollars cent cents euro euros usd eur gbp yen
km/h mph kb mb gb tb w kw kwh v hz khz mhz ghz pa kpa j kj cal kcal
jahr jahre tag tage stunde stunden minuten sekunden meilen an ans jour jours heure heures año años día días hora horas
""".split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 22, 33))
#: Slots of the filter of window hashes that goes to every task; its size does not depend on the benchmark.
FILTER_BITS = 24

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _hash_words(items: list[str]) -> np.ndarray:
    data = [w.encode() for w in items]
    ends = np.cumsum([len(d) for d in data])
    return xxh64(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash of the lower-cased word, template token) of every word.

    A number begins with a digit (points and commas between digits belong to it), a unit is one of UNITS after a
    number, a name has a capital first. Everything else is its own template token.
    """
    size = len(buf)
    full = np.zeros(size + 2, bool)
    full[1:-1] = _WORD[buf]
    digit = np.zeros(size + 2, bool)
    digit[1:-1] = _DIGIT[buf]
    mark = (buf == 46) | (buf == 44)
    full[1:-1] |= mark & digit[:-2] & digit[2:]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(full[1:-1] & (~full[:-2] | edge[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | edge[1:])) + 1
    owner = np.searchsorted(offsets, begins, "right") - 1
    low = LOWER[buf]
    low[1:] += ((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) * np.uint8(32)  # À to Þ
    value = xxh64(low, begins, ends)
    first = buf[begins]
    second = buf[np.minimum(begins + 1, max(size - 1, 0))]
    number = _DIGIT[first]
    name = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    template = np.where(number, NUMBER, np.where(name, NAME, value))
    after = np.flatnonzero(number[:-1] & ~number[1:] & (owner[:-1] == owner[1:])) + 1
    template[after[np.isin(value[after], _hash_words(UNITS))]] = UNIT
    return owner, value, template


def _window_hash(codes: np.ndarray, width: int) -> np.ndarray:
    n = max(len(codes) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ codes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def windows(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text number, position, hash, words, slot bits) of all windows of ``width`` words that hold a word of their own.

    Every window counts twice: of template tokens, and of plain words, which finds copies whose case was changed.
    """
    owner, value, template = tokens(buf, offsets)
    n = max(len(owner) - width + 1, 0)
    whole = owner[:n] == owner[len(owner) - n:] if n else np.zeros(0, bool)
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    pos = np.arange(n) - first[owner[:n]] if n else np.zeros(0, np.int64)
    slot = template < 100
    slots = sum(slot[k:k + n].astype(np.int64) << k for k in range(width)) if n else np.zeros(0, np.int64)
    out = []
    for codes, marks, keep in ((template, slots, whole & (slots != (1 << width) - 1)), (value, np.zeros_like(slots), whole)):
        at = np.flatnonzero(keep)
        out.append((at, _window_hash(codes, width)[at] ^ np.uint64(codes is value), marks[at]))
    at = np.concatenate([o[0] for o in out])
    hashes, marks = (np.concatenate([o[k] for o in out]) for k in (1, 2))
    words = np.lib.stride_tricks.sliding_window_view(value, width)[at] if n else np.zeros((0, width), np.uint64)
    return owner[at], pos[at], hashes, words, marks


def _window_rows(texts: DataFrame, width: int, shared_filter=None) -> DataFrame:
    """(id, pos, hash, words, slots, n) of the windows of (id, text) that pass the filter; n counts a text's positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if shared_filter is None else np.unpackbits(shared_filter.value).view(bool)
        for rows, buf, offsets in slices(batches):
            owner, pos, hashes, words, marks = windows(buf, offsets, width)
            n = np.zeros(rows.num_rows, np.int64)
            np.maximum.at(n, owner, pos + 1)
            if passes is not None:
                keep = np.flatnonzero(passes[hashes >> np.uint64(64 - FILTER_BITS)])
                owner, pos, hashes, words, marks = owner[keep], pos[keep], hashes[keep], words[keep], marks[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(words).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(owner)), pa.array(pos.astype(np.int32)), pa.array(hashes.view(np.int64)), lists, pa.array(marks.astype(np.int32)),
                 pa.array(n[owner].astype(np.int32))], ["id", "pos", "hash", "words", "slots", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, pos int, hash bigint, words array<bigint>, slots int, n int")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, similarity, changed) of documents that hold a benchmark item or the item with other numbers, names or units.

    An item leaks if at least ``similarity`` of its windows of ``width`` words stand near each other in the
    document, each with consistent slots: on a diagonal (same shift between item and document) one value of
    the item always becomes the same value. Template windows with a value that becomes several do not count; windows of
    equal words need no slots and always do. ``changed`` counts values that became others.

    Only windows whose hash some item has leave the tasks; that test is a bit field of fixed size, and the hash join after
    it is exact. An item of fewer than ``width`` words has no window and matches nothing, nor do NULL, empty or
    shorter documents. Repeated documents leak each; rows that share an id are reported once; items of one id are taken as
    one text each by their rows. Without documents or items the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    asked = stored(_window_rows(items, width), "benchmark-windows").withColumnsRenamed(
        {"id": "item", "pos": "item_pos", "words": "item_words"})
    bits = np.zeros(1 << FILTER_BITS, bool)
    shift = F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("slot")
    for row in asked.select(shift).distinct().toLocalIterator():  # at most 2^FILTER_BITS
        bits[row["slot"]] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    seen = _window_rows(texts, width, shared).select("id", "pos", "hash", "words")
    both = seen.join(asked, "hash").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    pairs = F.filter(F.array(*[
        F.when(F.col("slots").bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.get("item_words", F.lit(k)).alias("was"), F.get("words", F.lit(k)).alias("is")))
        for k in range(width)]), lambda p: p.isNotNull())
    runs = both.groupBy("id", "item", "n", "diagonal").agg(F.collect_set(F.struct("item_pos", pairs.alias("pairs"))).alias("found"))
    runs = runs.withColumn("pairs", F.array_distinct(F.flatten("found.pairs"))).withColumn("was", F.array_sort("pairs.was"))
    # values of the item that become several: equal neighbours in order
    runs = runs.withColumn("twisted", F.filter("was", lambda w, k: (k > 0) & (F.get("was", k - 1) == w)))
    fit = F.filter("found", lambda f: ~F.arrays_overlap(f["pairs"]["was"], F.col("twisted")))
    runs = runs.withColumn("places", F.array_distinct(F.transform(fit, lambda f: f["item_pos"]))).where(F.size("places") > 0)
    changed = F.array_distinct(F.transform(F.filter("pairs", lambda p: p["was"] != p["is"]), lambda p: p["was"]))
    near = runs.select("id", "item", "n", "places", F.size(changed).alias("changed"), F.explode(F.array(
        F.floor(F.col("diagonal") / F.col("n")) * 2, F.floor((F.col("diagonal") + F.col("n") / 2) / F.col("n")) * 2 + 1)).alias("region"))
    found = near.groupBy("id", "item", "n", "region").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("n")).alias("similarity"), F.max("changed").alias("changed"))
    return found.where(F.col("similarity") >= similarity).groupBy("id", "item").agg(
        F.max("similarity").alias("similarity"), F.max_by("changed", "similarity").alias("changed"))
