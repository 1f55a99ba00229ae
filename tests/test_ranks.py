import random

import numpy as np
import pytest

from antecede.operators.ranks import _narrowed, _rounds, exact_quantiles, global_rank


def test_global_rank_counts_through_task_boundaries_and_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.choice([1.0, 1.0, 2.0, 3.5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "scope string, v double, id int").repartition(7)
    out = global_rank(df, ["scope"], ["v", "id"], "rank", "size").collect()
    for scope in ("a", "b"):
        want = sorted((v, i) for s, v, i in rows if s == scope)
        got = [(r.v, r.id) for r in sorted((r for r in out if r.scope == scope), key=lambda r: r["rank"])]
        assert got == want
        assert {r.size for r in out if r.scope == scope} == {len(want)}
        assert sorted(r["rank"] for r in out if r.scope == scope) == list(range(1, len(want) + 1))


@pytest.mark.parametrize("accuracy, most", [(50_000, 1_000_000), (40, 1_000_000), (40, 12), (200, 5)])
def test_exact_quantiles_with_and_without_brackets(spark, accuracy, most):
    rng = random.Random(5)
    rows = [("hot", 7.0) for _ in range(700)] + [("hot", rng.gauss(0, 50)) for _ in range(1300)]
    rows += [("small", rng.random()) for _ in range(11)] + [("one", 4.0)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q1": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs, accuracy, most).collect()}
    for g in ("hot", "small", "one"):
        values = [v for k, v in rows if k == g and v is not None]
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), abs=1e-9), (g, name)
    total = exact_quantiles(df, [], "v", {"m": 0.5}, accuracy, most).first()
    assert total.m == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5), abs=1e-9)


def test_narrowed_brackets_keep_their_bound_and_their_position(spark):
    """After the stated rounds no bracket holds more values between its ends than asked for, also beside heavy ties."""
    rng = random.Random(9)
    values = sorted([3.0] * 2500 + [rng.uniform(0, 6) for _ in range(2500)] + [3.000001] * 400)
    base = spark.createDataFrame([(v,) for v in values], "__v double").repartition(6)
    wanted = [("a", 0.1 * (len(values) - 1)), ("b", 0.5 * (len(values) - 1)), ("c", 0.999 * (len(values) - 1)), ("d", 0.0)]
    brackets = spark.createDataFrame([(n, p, values[0], values[-1]) for n, p in wanted], "name string, __pos double, lo double, hi double")
    assert _rounds(len(values), 20, 200) == 2 and _rounds(5_000_000_000, 1_000_000, 50_000) == 0
    with pytest.raises(ValueError, match="accuracy"):
        _rounds(10**6, 10, 8)
    for _ in range(3):
        brackets = _narrowed(base, brackets, [], 20, 200).cache()
    for r in brackets.collect():
        below, upto = sum(v < r.lo for v in values), sum(v <= r.hi for v in values)
        assert below <= int(r["__pos"]) and -(-r["__pos"] // 1) < upto, r
        assert sum(r.lo < v < r.hi for v in values) <= 20, r


def test_exact_quantiles_of_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, ["g"], "v", {"m": 0.5}).count() == 0
    assert exact_quantiles(empty, [], "v", {"m": 0.5}).count() in (0, 1)
