import random

import pytest

from antecede.llm import suffix_dedup
from antecede.llm.suffix_dedup import repeated_strings


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


def run(docs, length):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeated_strings(docs, length).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(frame, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        text = " ".join(parts)
        rows.append((i, text[rng.randint(0, 20):] if rng.random() < 0.5 else text))
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101), (105, "ab" * 400), (106, rows[3][1]), (107, "é" * 30_000)]
    got = run(frame(rows), 100)
    assert got == brute(rows, 100)


def test_null_ids_repeated_rows_and_empty_tables(frame):
    long = "some words that are long enough to be found again " * 4
    rows = repeated_strings(frame([(1, long), (None, long), (5, "short"), (5, "short"), (None, None)])).collect()
    assert sorted((str(r.id), r.n_removed > 0) for r in rows) == [("1", True), ("5", False), ("5", False), ("None", False), ("None", False)]
    assert repeated_strings(frame([])).count() == 0


def test_false_hits_of_the_filters_change_nothing(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 8)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    same = [text(400) for _ in range(40)]  # four copies each: one name
    shared = text(300)  # between other texts: several names
    rows = [(i, same[i % 40]) for i in range(160)] + [(i, text(150) + shared[:rng.randint(150, 300)] + text(150)) for i in range(200, 220)]
    assert run(frame(rows), 100) == brute(rows, 100)
