"""Vectorised work on the UTF-8 bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; temporary arrays take a few dozen times as much.
SLICE_BYTES = 600_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # the constants of XXH64
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts end to end, offsets) in slices of about SLICE_BYTES; a NULL text has no bytes.

    A text longer than a slice is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).fill_null("")
        if not isinstance(texts, pa.StringArray):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            first = last


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every run of bytes that are no white space; runs end with their text."""
    full = np.zeros(len(buf) + 1, bool)
    np.logical_not(SPACE[buf], out=full[:-1])
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:]
    end = full[:-1] & (~full[1:] | edge[1:])
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(offsets, begins, "right") - 1


def single_spaced(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space after each word, new starts, new ends)."""
    sizes = ends - begins
    new_begins = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    inside = ~SPACE[buf]
    target = np.ones(len(out), bool)
    target[new_begins + sizes] = False
    out[target] = buf[inside]
    return out, new_begins, new_begins + sizes


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every byte range, as Spark's xxhash64 gives it for one string with the same seed."""
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at4 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    size = (ends - begins).astype(np.int64)
    pos = begins.astype(np.int64).copy()
    seed = np.uint64(seed)
    acc = np.full(len(size), seed + _P5, np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            lanes = [np.full(len(long), s, np.uint64) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        stripes, at, step = size[long] // 32, pos[long], 0
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                lanes[k][live] = _round(lanes[k][live], at8[at[live] + 32 * step + 8 * k])
            step += 1
            live = live[stripes[live] > step]
        total = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            total = (total ^ _round(np.zeros(len(long), np.uint64), lane)) * _P1 + _P4
        acc[long] = total
        pos[long] += 32 * stripes
    acc += size.astype(np.uint64)
    rest = size % 32
    zero = np.uint64(0)
    for k in range(3):
        m = np.flatnonzero(rest >= 8 * (k + 1))
        if len(m):
            acc[m] = _rotl(acc[m] ^ _round(np.full(len(m), zero), at8[pos[m]]), 27) * _P1 + _P4
            pos[m] += 8
    m = np.flatnonzero(rest & 4)
    if len(m):
        acc[m] = _rotl(acc[m] ^ (at4[pos[m]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[m] += 4
    for k in range(3):
        m = np.flatnonzero((rest & 3) > k)
        if len(m):
            acc[m] = _rotl(acc[m] ^ (data[pos[m]].astype(np.uint64) * _P5), 11) * _P1
            pos[m] += 1
    acc ^= acc >> np.uint64(33)
    acc *= _P2
    acc ^= acc >> np.uint64(29)
    acc *= _P3
    acc ^= acc >> np.uint64(32)
    return acc


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` rows; an empty run gives zero."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        begins = np.cumsum(counts) - counts
        out[full] = np.add.reduceat(values, begins[full], axis=0)
    return out
