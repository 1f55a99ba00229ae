"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


UNKNOWN = "und"
#: n-grams of one to this many characters are hashed into BUCKETS counts.
ORDERS = 3
BUCKETS = 1 << 15
#: At most about this many labelled texts of each language are used to fit (whole texts, chosen by hash).
FIT_TEXTS = 4000
#: Characters handled at once.
SLICE_CHARS = 1_000_000

_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """True for the letters of all planes."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return _LETTERS


def text_slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > SLICE_CHARS:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, offsets of the texts): rows of a sparse count matrix, repeats not merged.

    Texts are lower-cased, everything but letters reads as one blank, and a blank stands before and after
    each text. An n-gram holds a letter, or it is left out.
    """
    low = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    blank = ~letter
    keep = letter.copy()
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    starts = np.cumsum(sizes) - sizes
    keep[starts] = True
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    codes = np.where(letter, codes, 32).astype(np.uint32)[keep]
    letter = letter[keep]
    grams, owners = [], []
    mixed = np.zeros(len(codes), np.uint32)
    any_letter = np.zeros(len(codes), bool)
    for n in range(1, ORDERS + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        mixed = (mixed[:m] * np.uint32(0x01000193)) ^ (codes[n - 1:] * np.uint32(0x9E3779B1))
        any_letter = any_letter[:m] | letter[n - 1:]
        whole = any_letter & (owner[:m] == owner[n - 1:])
        h = (mixed ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
        grams.append(((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32)[whole])
        owners.append(owner[:m][whole])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(texts)))])


@dataclass
class LanguageModel:
    """log_prob has a row per bucket and a column per language; prior is its log share of the fitted texts."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; UNKNOWN with 0.0 without letters."""
        names, scores = [], []
        filled = [t or "" for t in texts]
        for a, b in text_slices(filled):
            grams, offsets = gram_buckets(filled[a:b])
            total = np.zeros((b - a, len(self.languages)))
            full = np.flatnonzero(np.diff(offsets))
            for k in range(len(self.languages) if len(full) else 0):
                total[full, k] = np.add.reduceat(self.log_prob[:, k][grams], offsets[:-1][full])
            total += self.prior
            best = total.argmax(1) if self.languages else np.zeros(b - a, int)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if self.languages else np.zeros(b - a)
            known = np.diff(offsets) > 0
            names += [self.languages[j] if ok and self.languages else UNKNOWN for j, ok in zip(best, known)]
            scores.append(np.where(known, share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on about FIT_TEXTS whole texts of each language; NULL languages are left out.

    Counts are added up per partition in numpy, then per (language, bucket) by Spark: the driver gets at
    most BUCKETS rows per language. Without any labelled text the model knows no language.
    """
    spark = labelled.sparkSession
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, FIT_TEXTS / sizes[l])])
    drawn = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {}
        for frame in frames:
            for name, own in frame.groupby("lang"):
                texts = own["text"].tolist()
                got = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                for a, b in text_slices(texts):
                    got += np.bincount(gram_buckets(texts[a:b])[0], minlength=BUCKETS)
        for name, got in totals.items():
            full = np.flatnonzero(got)
            yield pd.DataFrame({"lang": name, "bucket": full, "n": got[full]})

    counts = drawn.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    matrix = np.ones((BUCKETS, len(languages)))  # one added to every count
    for row in counts.toLocalIterator():
        matrix[row["bucket"], languages.index(row["lang"])] += row["n"]
    prior = np.log(np.array([sizes[l] for l in languages], float) / sum(sizes.values()))
    return LanguageModel(languages, np.log(matrix / matrix.sum(0)).astype(np.float32), prior)


def predictor(spark: SparkSession, model: LanguageModel) -> Callable[[Column], Column]:
    """A column function text -> struct(lang_pred, score); the model is broadcast (BUCKETS x languages floats)."""
    shared = spark.sparkContext.broadcast((model.languages, model.log_prob, model.prior))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = LanguageModel(*shared.value)
        for texts in batches:
            names, scores = known.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) per row.

    NULL, empty or letterless texts are UNKNOWN with score 0. Only the text is looked at; repeated rows get
    equal answers, NULL ids are carried along, other columns are ignored.
    """
    answer = predictor(docs.sparkSession, model)(F.col(text).cast("string"))
    return docs.select(F.col(id_col).alias("id"), answer.alias("answer")).select("id", "answer.*")
