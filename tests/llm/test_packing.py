import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from antecede.llm import packing
from antecede.llm.packing import binary_lengths, pack, write_buckets

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, length=2048):
    """Every document comes back whole and in order from pieces that are powers of two."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted([(i if i is not None else -1, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in docs])
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} <= {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= length and len(r.ids) == 4 * r.length for r in rows)
    got, text, last = [], [], None
    for r in sorted(rows, key=lambda r: r.sequence_id):  # a document's pieces follow each other
        if r.start == 0 and text:
            got.append((last, tuple(text)))
            text = []
        assert r.start == len(text)
        text += np.frombuffer(r.ids, "<u4").tolist()
        last = r.id if r.id is not None else -1
        if len(text) == r.doc_tokens:
            got.append((last, tuple(text)))
            text = []
    assert not text and sorted(got) == want


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 65535])
def test_binary_lengths(n):
    parts = binary_lengths(n, 2048)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
    assert len([p for p in parts if p < 2048]) == len({p for p in parts if p < 2048})


def test_odd_texts(frame, cases):
    odd = ["a b<|endoftext|>c  d.", "A b<|ENDOFTEXT|>C.d", "Ünï. 'S's it's. ÀÉ! ×÷, a.\u0301b ...a?!b a,b;c:d x\u0300.", "don't\x0bstop'S    x", "é ́e ÀÉ 漢字 Ωmega ΟΔΟΣ", "\x1ca\x00b", "😀 " * 3000, "x" * 9000]
    docs = cases + [(20 + k, t) for k, t in enumerate(odd)]
    check(pack(frame(docs), PATH).collect(), docs)
    check(pack(frame(docs), PATH, length=64).collect(), docs, 64)
    assert pack(frame([]), PATH).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_long_text_in_stretches(frame, monkeypatch):
    text = " ".join(f"word{k % 977} and, {k}" for k in range(4000)) + "\n" + "y" * 500
    words = packing.WordIds(PATH)
    monkeypatch.setattr(packing, "STRETCH", 1000)
    assert words.of_long_text(text).tolist() + [1] == ids_of(text)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    assert words.of_long_text(text).tolist() + [1] == ids_of(text)


def test_buckets_hold_equal_lengths(spark, frame):
    folder = write_buckets(pack(frame([(1, "a b c d e f g"), (2, "one two")]), PATH, length=4))
    back = spark.read.parquet(folder)
    assert {(r.length, len(r.ids) // 4) for r in back.collect()} == {(4, 4), (2, 2), (1, 1)}


def test_refuses_other_lengths(frame):
    with pytest.raises(ValueError):
        pack(frame([]), PATH, length=100)


def test_query_digest(spark, sf):
    from antecede.llm.queries import QUERIES

    row = QUERIES["op12_pack"](spark, sf).where("doc_id = 0 AND start = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first().text
    ids = np.array(ids_of(text)[:row.length], "<u4")
    assert row.ids_crc32 == zlib.crc32(ids.tobytes()) and row.doc_tokens == len(ids_of(text))
