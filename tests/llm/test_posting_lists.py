import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import posting_lists
from antecede.llm.posting_lists import nearest
from antecede.llm.store import table

SCHEMA = "vec_id bigint, embedding array<float>, id int, rep string, score string"


def brute(rows, k, asks):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if asks(q):
            order = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)
            out[q] = [(n + 1, i) for n, (_, i) in enumerate(order[:k])]
    return out


def run(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in nearest(frame, F.pmod(F.col("vec_id"), F.lit(5)) == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    return got


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=8).tolist()
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(60)] + [(i, same) for i in range(60, 100)]
    rows += [(100, None), (101, [0.0] * 8), (102, [1.0] * 7 + [None]), (103, [float("nan")] * 8), (104, [float("inf")] + [1.0] * 7), (105, [1.0]), (None, same), (60, same)]
    assert run(spark, rows, 6) == brute(rows, 6, lambda q: q % 5 == 0)


def test_fewer_candidates_than_asked_for_and_empty_tables(spark):
    rows = [(0, [1.0] * 8), (1, [2.0] * 8), (2, [0.5] * 8)]
    assert run(spark, rows, 20) == {0: [(1, 1), (2, 2)]}
    assert run(spark, [(0, [1.0] * 8)], 3) == {}
    assert run(spark, [], 3) == {} and run(spark, [(0, None)], 3) == {}


def test_recall_over_many_lists(spark, sf, monkeypatch):
    monkeypatch.setattr(posting_lists, "BLOCK", 64)  # lists in several blocks; all else as in production
    vectors = table(spark, sf.replace("sf0.001", "sf0.1"), "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    found = {}
    for r in nearest(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        hit += len(found[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_centroids_are_balanced_and_all_reachable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    x[:1000] = x[0] + 0.01 * x[:1000]
    shape = posting_lists.fit_centroids(x, 40, float(np.sqrt((x * x).sum(1).max())))
    seen, todo = {0}, [0]
    while todo:
        for n in set(shape.links[todo.pop()].tolist()) - seen:
            seen.add(n)
            todo.append(n)
    assert len(seen) == 40
    assert all(1 <= len(own) <= posting_lists.REPLICAS for own in shape.lists_of(x))


@pytest.mark.parametrize("k", [1, 3])
def test_best_merges_lists(k):
    q, v, s = posting_lists._best(np.array([1, 1, 1, 2, 1]), np.array([5, 4, 5, 9, 3]), np.array([.5, .5, .5, .1, .2]), k)
    assert list(zip(q.tolist(), v.tolist())) == [(1, x) for x in [4, 5, 3][:k]] + [(2, 9)]


def test_clusters_small_groups_and_outliers(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    small = np.repeat(rng.normal(size=(200, 16)), rng.choice([7, 13], 200), axis=0)
    x = np.vstack([centres[rng.integers(0, 60, 7000)] + 0.2 * rng.normal(size=(7000, 16)), small + 0.25 * rng.normal(size=small.shape), 3 * rng.normal(size=(300, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(4)
    asks = np.r_[np.arange(0, len(x), 40), np.arange(len(x) - 300, len(x))]
    found = {}
    for r in nearest(frame, F.col("vec_id").isin(asks.tolist())).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert {len(found.get(q, ())) for q in asks.tolist()} == {20}
    recall = []
    for q in asks.tolist():
        s = x @ x[q]
        s[q] = -9
        recall.append(len(found[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_search_goes_on_until_enough_vectors():
    x = np.random.default_rng(2).normal(size=(500, 8))
    shape = posting_lists.fit_centroids(x, 50, float(np.sqrt((x * x).sum(1).max())))
    shape.sizes = np.bincount([own[0] for own in shape.lists_of(x)], minlength=50)
    own = shape.points[7, :-1] * 1.0
    for least in (1, 100, 500):
        assert shape.sizes[shape.search(own, least)].sum() >= least


def test_tight_groups_smaller_than_k_get_full_answers(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 8)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 8)), rng.choice([7, 13], 60), axis=0)
    x += 1e-4 * rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = run(spark, list(enumerate(x.tolist())), 20)
    assert len(got) == -(-len(x) // 5) and all(len(rows) == 20 for rows in got.values())
