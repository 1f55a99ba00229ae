import random
from collections import defaultdict

import pytest

from antecede.llm import mixing


def fill(sizes, weights, share, most):
    """The rule as stated: share out by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free = {}, set(names)
    while True:
        left = share * sum(sizes.values()) - sum(out.values())
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        free -= full


def corpus(spark, seed, n=900):
    rng = random.Random(seed)
    sources = ["a", "B", "é", None, "zz", "c"]
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), rng.choice(sources + ["a"] * 5), 1, 2, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id int, text string, source string, size int, copies int, stratum string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    docs = corpus(spark, seed)
    got = mixing.mix(docs).collect()
    assert sorted(r.id for r in got) == list(range(900))
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
    want = fill(size, (3, 1, 2), 1.5, 2.0)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s in size:
        assert taken[s] == pytest.approx(want[s], rel=0.05)
    again = {(r.id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.id, r.copies) for r in got}


def test_cases(spark, frame, cases):
    got = mixing.mix(frame(cases)).collect()
    assert len(got) == len(cases)
    assert {r.id: r.size for r in got if r.id} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 7: 0, 8: 1}
    assert mixing.mix(frame([])).count() == 0
    empty = mixing.mix(frame([(1, ""), (2, None)])).collect()
    assert {(r.size, r.target, r.copies) for r in empty} == {(0, 0.0, 0)}


def test_larger_odds_are_taken_more_often(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string"), weights=(3, 1), share=0.8).collect()
    share = {s: sum(r.copies for r in got if r.source == s) / 2000 for s in "ab"}
    assert share["a"] == pytest.approx(1.2, abs=0.01) and share["b"] == pytest.approx(0.4, abs=0.01)
