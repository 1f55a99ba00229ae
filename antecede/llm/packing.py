"""Packing by powers of two: a document is cut into pieces of binary lengths, and equal lengths form a bucket."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from antecede.llm.store import shared_folder

#: Bytes of text tokenised at once; a longer text is tokenised in stretches that end at white space.
STRETCH = 8_000_000
#: Words whose ids a task remembers; the memory is emptied when it is full.
REMEMBERED = 800_000
#: Words that are encoded in one call.
TOGETHER = 20_000

_BREAK = re.compile(r"[\x20\x09-\x0D]")
#: Words of one kind of letter, which pre-tokenizers leave whole.
_PLAIN = "^[a-zÀ-ÖØ-öø-ÿ]+$"
_STOP_AFTER_LETTER = r"([A-Za-z])([.,;:!?])"


def binary_lengths(n: int, most: int) -> list[int]:
    """``n`` as full pieces of ``most`` (a power of two) and then its remaining binary digits, largest first."""
    digits = [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]
    return [most] * (n // most) + digits


class WordIds:
    """Token ids of texts by way of their distinct words.

    Right for tokenizers whose ids never join across white space, nor a letter and one of . , ; : ! ? after it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "(?i)" + "|".join(map(re.escape, names)) if names else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, "<u4")
        self.counts = np.zeros(0, np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of plain words, encoded as one text."""
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        counts = np.bincount(np.array(whole.word_ids, np.int64), minlength=len(words))
        if len(counts) != len(words) or not counts.all():  # a pre-tokenizer that cuts plain words
            return self._apart(words)
        return np.array(whole.ids, "<u4"), counts

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for each in ids for i in each), "<u4", int(counts.sum())), counts

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words among the known ones."""
        if len(self.known) + len(words) > REMEMBERED:
            self._forget()
        listed = words.to_pylist()
        numbers = np.fromiter((self.known.get(w, -1) for w in listed), np.int64, len(listed))
        new = np.flatnonzero(numbers < 0)
        plain = pc.match_substring_regex(words.take(pa.array(new)), _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        for places, encode in ((new[~plain], self._apart), (new[plain], self._together)):
            fresh = [listed[k] for k in places]
            parts = [encode(fresh[k:k + TOGETHER]) for k in range(0, len(fresh), TOGETHER)]
            numbers[places] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(fresh, numbers[places].tolist()))
            self.ids = np.concatenate([self.ids, *(p[0] for p in parts)])
            self.counts = np.concatenate([self.counts, *(p[1] for p in parts)])
        return numbers

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts in them)."""
        if self.folds and not (self.special and pc.any(pc.match_substring_regex(texts, self.special)).as_py()):
            texts = pc.ascii_lower(texts)  # fewer distinct words
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _STOP_AFTER_LETTER, r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        words = self._learn(coded.dictionary)
        which = words[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.counts[which]
        ends = np.cumsum(each)
        at = np.repeat((np.cumsum(self.counts) - self.counts)[which] - (ends - each), each)
        at += np.arange(len(at))
        words_before = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return self.ids[at], np.concatenate([[0], ends])[words_before]

    def of_long_text(self, text: str) -> np.ndarray:
        """Ids of one text, a stretch at a time."""
        parts, begin = [], 0
        while begin < len(text):
            stop = _BREAK.search(text, begin + STRETCH)
            end = stop.start() if stop else len(text)
            parts.append(self.of_texts(pa.array([text[begin:end]]))[0])
            begin = end
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of about STRETCH bytes of text; a longer text is a range of its own."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    first = total = 0
    for row, size in enumerate(sizes):
        if row > first and total + size > STRETCH:
            yield first, row
            first, total = row, 0
        total += int(size)
    if first < batch.num_rows:
        yield first, batch.num_rows


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece, which is a whole sequence of its own.

    A document is its token ids and then ``end_id``; a NULL or empty text is ``end_id`` alone. It is cut into full pieces
    of ``length`` and the binary digits of the rest, so every sequence has a power of two of ids, none is padded and none
    crosses documents. ``ids`` holds them as little-endian unsigned 32-bit numbers. Equal lengths are a bucket: batches
    of one bucket need no padding, see :func:`write_buckets`. Nothing is shuffled. Rows that share an id, or have none,
    are packed each on their own; an empty table gives an empty result; other columns are not read.

    ``tokenizer`` is the path of a tokenizers file as :class:`WordIds` takes it. Sequence numbers are unique
    and follow the partitions of the scan: the same files and settings give the same numbers, also for a task that runs again.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            for first, last in _stretches(batch):
                rows = batch.slice(first, last - first)
                texts = rows.column("text")
                if last - first == 1 and len(texts[0].as_buffer() or b"") > STRETCH:
                    ids = words.of_long_text(texts[0].as_py())
                    offsets = np.array([0, len(ids)])
                else:
                    ids, offsets = words.of_texts(texts)
                owner, start, size, data, total = [], [], [], [], []
                for row in range(last - first):
                    own = np.append(ids[offsets[row]:offsets[row + 1]], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for n in binary_lengths(len(own), length):
                        owner.append(row)
                        start.append(at)
                        size.append(n)
                        data.append(own[at:at + n].tobytes())
                        total.append(len(own))
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id").take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(data, pa.binary()), pa.array(total, pa.int64())], ["id", "start", "length", "ids", "doc_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    pieces = narrow.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame) -> str:
    """Write sequences in one folder per length, from where batches of equal lengths are read; returns the folder's path."""
    path = shared_folder(packed.sparkSession, "packed")
    packed.write.partitionBy("length").parquet(path)
    return path
