import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings, strategies as st

from antecede.llm.textbytes import single_spaced, slices, sums, words, xxh64

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té€😀", max_size=120)), min_size=1, max_size=8)


def joined(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    return list(slices(iter([batch])))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=20), st.integers(0, 2**63))
def test_xxh64_is_the_public_hash(parts, seed):
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends[:-1]]), ends, seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_never_cross_texts(texts):
    for rows, buf, offsets in joined(texts):
        begins, ends, owner = words(buf, offsets)
        spaced, b, e = single_spaced(buf, begins, ends)
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert [(int(o), buf[x:y].tobytes().decode()) for o, x, y in zip(owner, begins, ends)] == want
        assert spaced.tobytes().decode() == "".join(w + " " for _, w in want)
        assert [spaced[x:y].tobytes().decode() for x, y in zip(b, e)] == [w for _, w in want]


def test_slices_keep_every_row_and_long_texts_whole():
    texts = ["x" * 3_000_000, None, "y", "z" * 1_999_999, "w"]
    parts = joined(texts)
    assert sum((r.column(1).to_pylist() for r, _, _ in parts), []) == texts
    assert all(len(buf) == offsets[-1] for _, buf, offsets in parts)


def test_sums_of_empty_runs_are_zero():
    assert sums(np.array([1, 2, 3]), np.array([0, 2, 0, 1, 0])).tolist() == [0, 3, 0, 3, 0]
