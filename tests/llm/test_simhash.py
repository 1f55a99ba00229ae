import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from antecede.llm import simhash
from antecede.llm.graph import components
from antecede.llm.simhash import axes_for, embedded, grid_masks, near_components, near_links, popcounts, random_pairs, within


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_match_brute_force(frame, cases):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "gamma", "été", "delta", "eps", "zeta"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(100, 160)]
    rows += [(i + 100, t.replace("beta", "BETA") + rng.choice(["", " eps"])) for i, t in rows]
    got = near_components(frame([r for r in cases if r[0]] + rows)).collect()
    fps = {i: fingerprint(t) for i, t in [r for r in cases if r[0]] + rows}
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {(r.id, r.fp, r.component) for r in got} == {(i, signed(fps[i]), want[i]) for i in fps}
    assert len(got) == len([r for r in cases if r[0]]) + len(rows)


def test_null_ids_and_empty_tables(frame):
    got = near_components(frame([(None, "a b c d"), (3, "a b c d"), (None, "quite another text of words")])).collect()
    assert sorted((r.id, r.component) for r in got if r.id) == [(3, 3)]
    assert sorted(str(r.component) for r in got) == ["3", "3", "None"]
    assert near_components(frame([])).count() == 0


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(40)})
    links = near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"))
    got = roots(map(signed, fps), [(r.a, r.b) for r in links.collect()])
    want = roots(map(signed, fps), [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert got == want
    assert links.count() < len(fps) * len(grid_masks(3))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(10, 40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(10, 40)]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_decides_rows_by_their_own_text(spark):
    from antecede.llm.simhash import one_of_each

    a, b = "one two three four five six seven eight", "completely other words stand in this text here"
    c = "nothing of the above is said again in these lines"

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)
        out = one_of_each(docs)
        assert out.columns == docs.columns
        return sorted(map(tuple, out.collect()), key=str)

    assert kept([(5, a, 1), (9, a, 2), (9, b, 3)]) == [(5, a, 1), (9, b, 3)]  # the copy goes, the unlike text of its id stays
    assert kept([(1, a, 1), (2, b, 2), (2, c, 3)]) == [(1, a, 1), (2, b, 2), (2, c, 3)]
    assert kept([(4, a, 1), (4, b, 1), (6, b.upper(), 1), (None, a, 7), (None, a, 8)]) == sorted([(4, a, 1), (4, b, 1), (None, a, 7), (None, a, 8)], key=str)
    assert kept([(3, a, 1)] * 5 + [(3, None, 2), (8, "", 2)]) == sorted([(3, a, 1), (3, None, 2)], key=str)
    assert kept([]) == []


def test_manhattan_distance_of_the_embedding_is_a_lower_bound(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(200)]
    fps += [f ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for f in fps]
    arr = np.array(fps, np.uint64)
    points = embedded(arr)
    jvm = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint").select(popcounts(F.col("fp")).alias("p")).collect()
    assert [r.p for r in jvm] == points.view(np.int64).tolist()

    def counts(f):
        return [(f >> 2 * k & 3).bit_count() for k in range(32)]

    for i, j in [(i, i + 200) for i in range(200)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(500)]:
        manhattan = sum(abs(a - b) for a, b in zip(counts(fps[i]), counts(fps[j])))
        exact = (fps[i] ^ fps[j]).bit_count()
        assert int(points[i] ^ points[j]).bit_count() == manhattan <= exact
        assert bool(within(arr, points, np.array([i]), np.array([j]), 3)[0]) == (exact <= 3)


@pytest.mark.parametrize("axes", [6, 8, 11, 16])
def test_any_number_of_axes_finds_all_links(spark, axes):
    rng = random.Random(axes)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)})
    links = near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), 3, axes).collect()
    want = roots(map(signed, fps), [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert roots(map(signed, fps), [(r.a, r.b) for r in links]) == want


def test_candidates_grow_slowly_with_the_number_of_fingerprints():
    before = 0
    for count in [10 ** k for k in range(4, 10)]:
        m = axes_for(count, 3)
        assert m >= before
        before = m
        assert count / 2 * random_pairs(m, 3) + len(grid_masks(3, m)) <= 5 * np.log2(count)
    fps = np.random.default_rng(2).integers(0, 2 ** 63, 20_000, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    met = 0
    for mask in grid_masks(3, 6):
        cells = np.unique(embedded(fps) & np.uint64(mask % 2 ** 64), return_counts=True)[1]
        met += int((cells * (cells - 1) // 2).sum())
    assert 0.5 < met / (20_000 ** 2 / 2 * random_pairs(6, 3)) < 2
