"""Weighted combination of member predictions and weights fitted on strictly earlier folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.operators.quality import duplicate_keys, require_empty
from antecede.operators.skew import lookup
from antecede.session import ensure_checkpoint_dir

KEYS = ("player_id", "match_id")
RENORMALIZE, EMIT_NONE = "renormalize", "emit_none"


def stack_members(members: Mapping[str, DataFrame], columns: Sequence[str] = ()) -> DataFrame:
    """Long frame of member predictions: one shuffle later aligns any number of members."""
    frames = [
        df.select(*KEYS, *columns, F.lit(name).alias("member"), F.col("prediction").cast("double"),
                  F.col("lowerci").cast("double"), F.col("upperci").cast("double"))
        for name, df in members.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def require_unique_members(stacked: DataFrame, keys: Sequence[str] = KEYS) -> None:
    require_empty(duplicate_keys(stacked, [*keys, "member"]), "duplicate member predictions")


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive total")
    return {m: w / total for m, w in weights.items()}


def _weight(weights: Mapping[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col("member") == m, F.lit(float(w))) for m, w in normalised(weights).items()])


def combine(stacked: DataFrame, weights: Mapping[str, float] | DataFrame, member_count: int, *,
            keys: Sequence[str] = KEYS, policy: str = RENORMALIZE) -> DataFrame:
    """One row per key with ``status`` complete, renormalized or skipped.

    ``weights`` is fixed, or a frame (fold_number, member, weight) of at most folds x members rows.
    Weights of present members are renormalised per key; each bound uses the members having it.
    """
    if policy not in (RENORMALIZE, EMIT_NONE):
        raise ValueError(f"unknown missing-member policy {policy!r}")
    if isinstance(weights, DataFrame):
        rows = lookup(stacked, F.broadcast(weights), ["fold_number", "member"], ["weight"])
    else:
        rows = stacked.withColumn("weight", _weight(weights))
    here = F.col("prediction").isNotNull()

    def parts(column: str) -> list[Column]:
        usable = here & F.col(column).isNotNull()
        return [F.sum(F.when(usable, F.col("weight") * F.col(column))).alias(f"__s_{column}"),
                F.sum(F.when(usable, F.col("weight"))).alias(f"__w_{column}")]

    grouped = rows.groupBy(*keys).agg(
        F.count_if(here).alias("members_present"), *parts("prediction"), *parts("lowerci"), *parts("upperci"))

    def mean(column: str) -> Column:
        return F.try_divide(F.col(f"__s_{column}"), F.col(f"__w_{column}"))

    present = F.col("members_present")
    status = F.when(present == 0, "skipped").when(present == member_count, "complete") \
        .otherwise("skipped" if policy == EMIT_NONE else "renormalized")
    kept = status != "skipped"
    point = mean("prediction")
    out = grouped.withColumns({
        "status": status, "prediction": F.when(kept, point),
        "lowerci": F.when(kept & mean("lowerci").isNotNull(),
                          F.greatest(F.lit(0.0), F.least(mean("lowerci"), point))),
        "upperci": F.when(kept & mean("upperci").isNotNull(), F.greatest(mean("upperci"), point))})
    return out.select(*keys, "status", "members_present", "prediction", "lowerci", "upperci")


def combine_census(combined: DataFrame) -> DataFrame:
    return combined.agg(
        F.count(F.lit(1)).alias("rows_read"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_rows") for s in ("complete", "renormalized", "skipped")])


def complete_rows(stacked: DataFrame, members: Sequence[str], outcomes: DataFrame | None = None,
                  target: str = "target_value", fold: str = "fold_number", keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys predicted by every member with a known outcome: (fold, y, p0, p1, ...).

    The outcome may ride along in ``stacked``; otherwise it is joined from ``outcomes``.
    """
    picks = [F.max(F.when(F.col("member") == m, F.col("prediction"))).alias(f"p{i}") for i, m in enumerate(members)]
    if outcomes is not None:
        stacked = lookup(stacked, outcomes, list(keys), [target], how="inner")
    wide = stacked.groupBy(*keys, fold).agg(F.max(target).alias("y"), *picks)
    return wide.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ["y", *[f"p{i}" for i, _ in enumerate(members)]]]))


def _prior_folds() -> W:
    """Strictly earlier folds; one row per fold, so one small partition."""
    return W.orderBy("fold_number").rowsBetween(W.unboundedPreceding, -1)


def _determinant(m: Sequence[Sequence[Column]]) -> Column:
    if not m:
        return F.lit(1.0)
    total = None
    for j, head in enumerate(m[0]):
        term = head * _determinant([[*row[:j], *row[j + 1:]] for row in m[1:]])
        total = term if total is None else total + term if j % 2 == 0 else total - term
    return total


def _on_face(face: Sequence[int], gram: Sequence[Sequence[Column]], cross: Sequence[Column], scale: Column) -> list[Column]:
    """Minimiser with the weights of ``face`` adding up to one and no others; NULL where it is not unique."""
    *free, last = face
    lhs = [[gram[i][j] - gram[i][last] - gram[last][j] + gram[last][last] for j in free] for i in free]
    rhs = [cross[i] - cross[last] - gram[i][last] + gram[last][last] for i in free]
    det = _determinant(lhs)
    regular = F.when(det > F.lit(1e-12) * F.pow(scale, F.lit(len(free))), det) if free else F.lit(1.0)
    solved = {i: F.try_divide(_determinant([[rhs[r] if c == k else lhs[r][c] for c, _ in enumerate(free)] for r, _ in enumerate(free)]), regular)
              for k, i in enumerate(free)}
    solved[last] = reduce(lambda x, y: x - y, [solved[i] for i in free], F.lit(1.0))
    return [solved.get(i, F.lit(0.0)) for i, _ in enumerate(cross)]


def squared_weights(rows: DataFrame, folds: DataFrame, members: Sequence[str],
                    configured: Mapping[str, float]) -> DataFrame:
    """(fold_number, w0, w1, ...) for every fold in ``folds`` from one pass over the rows.

    The exact minimiser of the squared error over all earlier folds, on the simplex: it lies inside one face, and
    there it solves a linear system of the Gram sums, so all faces are tried (their number is 2^members). It depends on
    the rows only through ratios of sums: repeating all rows changes nothing. Where nothing beats the
    configured weights (no rows, equal members) those stay.
    """
    k = len(members)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = [*[f"g{i}_{j}" for i, j in pairs], *[f"c{i}" for i in range(k)]]
    sums = rows.groupBy("fold_number").agg(
        *[F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"p{i}") * F.col("y")).alias(f"c{i}") for i in range(k)])
    base = lookup(folds.select("fold_number"), sums, ["fold_number"], names)
    prior = _prior_folds()
    base = base.select("fold_number", *[F.coalesce(F.sum(c).over(prior), F.lit(0)).cast("double").alias(c) for c in names])
    gram = [[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]
    cross = [F.col(f"c{i}") for i in range(k)]
    scale = reduce(lambda x, y: x + y, [gram[i][i] for i in range(k)])

    def loss(w: Sequence[Column]) -> Column:
        square = reduce(lambda x, y: x + y, [w[i] * w[j] * gram[i][j] for i in range(k) for j in range(k)])
        return square - 2 * reduce(lambda x, y: x + y, [w[i] * cross[i] for i in range(k)])

    start = [F.lit(float(configured[m])) for m in members]
    faces = [f for size in range(1, k + 1) for f in combinations(range(k), size)]
    tried = base.select("fold_number", *names, F.array(*[F.array(*_on_face(f, gram, cross, scale)) for f in faces]).alias("points"))
    allowed = F.filter("points", lambda p: F.forall(p, lambda w: w.isNotNull() & (w >= 0)))
    scored = F.transform(allowed, lambda p: F.struct(loss([F.get(p, F.lit(i)) for i in range(k)]).alias("loss"), p.alias("w")))
    best = tried.select("fold_number", F.array_min(scored).alias("best"), loss(start).alias("start"), scale.alias("scale"))
    better = F.col("best.loss") < F.col("start") - F.lit(1e-12) * F.col("scale")
    return best.select("fold_number", *[F.when(better, F.get("best.w", F.lit(i))).otherwise(start[i]).alias(f"w{i}") for i in range(k)])


_CELLS = 1024


def absolute_weights(rows: DataFrame, folds: DataFrame, members: Sequence[str], configured: Mapping[str, float],
                     gap: float = 1e-6) -> DataFrame:
    """(fold_number, w0, w1, ...) minimising the absolute error of all earlier folds.

    Two members: the exact minimiser, the weighted median of (y-b)/(a-b) with weights |a-b| clipped to
    [0, 1].  It is located by two rounds of cells and finished among the rows of one cell, so no fold's
    rows meet in one task.  More members: cutting planes, to within ``gap`` of the least error.
    """
    if len(members) != 2:
        return cut_weights(rows, folds, members, configured, gap).drop("loss", "gap", "rounds")
    a, b = F.col("p0"), F.col("p1")
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("y") - b) / (a - b)))
    pts = rows.where(a != b).select("fold_number", F.abs(a - b).alias("wt"), r.alias("r"))
    cell = F.floor(F.col("r") * _CELLS)
    pts = pts.withColumns({"cell": cell, "sub": F.floor((F.col("r") * _CELLS - cell) * _CELLS)})
    ensure_checkpoint_dir(rows.sparkSession)
    pts = pts.checkpoint()  # read three times: one narrow copy instead of three runs of the models
    ks = folds.select(F.col("fold_number").alias("k"))

    hist = pts.groupBy("fold_number", "cell").agg(F.sum("wt").alias("wt"))
    # at most (cells + 1) x folds rows, whatever the number of predictions
    grid = hist.select("cell").distinct().crossJoin(F.broadcast(folds.select("fold_number")))
    grid = lookup(grid, hist, ["fold_number", "cell"], ["wt"])
    earlier = W.partitionBy("cell").orderBy("fold_number").rowsBetween(W.unboundedPreceding, -1)
    level1 = grid.select(F.col("fold_number").alias("k"), "cell", F.coalesce(F.sum("wt").over(earlier), F.lit(0.0)).alias("wt"))
    first = _crossing(level1, "cell", None).checkpoint()  # one row per fold

    inner = pts.join(F.broadcast(first.withColumnRenamed("cell", "__cell")),
                     (F.col("cell") == F.col("__cell")) & (F.col("fold_number") < F.col("k")))
    level2 = inner.groupBy("k", "cell", "sub", "before", "half").agg(F.sum("wt").alias("wt"))
    second = _crossing(level2.drop("cell"), "sub", "before").select("k", "sub", "before", "half")
    second = lookup(second, first, ["k"], ["cell"]).checkpoint()

    renamed = second.toDF("k", "__sub", "before", "half", "__cell")
    inner = pts.join(F.broadcast(renamed), (F.col("cell") == F.col("__cell")) & (F.col("sub") == F.col("__sub"))
                     & (F.col("fold_number") < F.col("k")))
    level3 = inner.groupBy("k", "r", "before", "half").agg(F.sum("wt").alias("wt"))
    exact = _crossing(level3, "r", "before").select("k", F.col("r").alias("w"))

    out = lookup(ks, exact, ["k"], ["w"])
    w0, w1 = (F.lit(float(configured[m])) for m in members)
    return out.select(F.col("k").alias("fold_number"), F.coalesce("w", w0).alias("w0"),
                      F.coalesce(1 - F.col("w"), w1).alias("w1"))


def _crossing(cells: DataFrame, position: str, before: str | None) -> DataFrame:
    """Per fold k the first position whose running weight reaches half of the total."""
    upto = W.partitionBy("k").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    if before is None:
        cells = cells.withColumns({"before": F.lit(0.0), "half": F.sum("wt").over(W.partitionBy("k")) / 2})
    ordered = W.partitionBy("k").orderBy(position)
    # the last position always qualifies: summation order must not leave a fold without one
    cells = cells.withColumns({"upto": F.col("before") + F.sum("wt").over(upto),
                               "__last": F.lead(position).over(ordered).isNull()})
    picked = cells.where((F.col("half") > 0) & ((F.col("upto") >= F.col("half")) | F.col("__last")))
    return picked.groupBy("k").agg(F.min_by(F.struct(position, (F.col("upto") - F.col("wt")).alias("before"), "half"),
                                            position).alias("s")).select("k", "s.*")


def lower_envelope(cuts: np.ndarray) -> tuple[float, np.ndarray]:
    """(least value, weights) of the largest of the cuts over the simplex; row i of ``cuts`` holds cut i's value at every corner.

    A cut is linear, so this is the game in which weights are mixed against cuts: with positive values v w = x solves
    max sum(x), cuts @ x <= 1, x >= 0, from the feasible start x = 0 (simplex method, least index first).
    """
    scale = max(float(np.abs(cuts).max()), 1e-300)
    shift = 1.0 - float((cuts / scale).min())
    a = cuts / scale + shift
    n, k = a.shape
    table = np.zeros((n + 1, k + n + 1))
    table[:n, :k], table[:n, k:k + n], table[:n, -1], table[n, :k] = a, np.eye(n), 1.0, -1.0
    basis = np.arange(k, k + n)
    while (table[n, :-1] < -1e-12).any():
        enter = int(np.flatnonzero(table[n, :-1] < -1e-12)[0])
        column = table[:n, enter]
        ratio = np.where(column > 1e-12, table[:n, -1] / np.where(column > 1e-12, column, 1.0), np.inf)
        least = np.flatnonzero(ratio <= ratio.min() + 1e-15)
        leave = int(least[np.argmin(basis[least])])
        table[leave] /= table[leave, enter]
        others = np.arange(n + 1) != leave
        table[others] -= np.outer(table[others, enter], table[leave])
        basis[leave] = enter
    x = np.zeros(k + n)
    x[basis] = table[:n, -1]
    total = x[:k].sum()
    return (1.0 / total - shift) * scale, x[:k] / total


def cut_weights(rows: DataFrame, folds: DataFrame, members: Sequence[str], configured: Mapping[str, float], gap: float = 1e-6,
                most_rounds: int = 300) -> DataFrame:
    """(fold_number, w0, w1, ..., loss, gap, rounds) for any number of members, by cutting planes on the simplex.

    The mean absolute error of a fold's earlier rows is convex in the weights: its value and slope at a point are a plane below it. Every round
    takes the lowest point of the planes so far and two points towards the best one, and one pass over the rows gives the values and
    slopes of all points of all folds; only these sums, a few numbers per fold, reach the driver. ``gap`` is the share of the loss by
    which the best point can lie above the least error; ``gap`` and ``loss`` are returned. Without earlier rows, or where nothing beats the
    configured weights, those stay.
    """
    spark, k = rows.sparkSession, len(members)
    ensure_checkpoint_dir(spark)
    p = [F.col(f"p{i}").cast("double") for i in range(k)]
    data = rows.select("fold_number", F.col("y").cast("double").alias("y"), *[c.alias(f"p{i}") for i, c in enumerate(p)]).checkpoint()
    start = np.array([float(configured[m]) for m in members])
    numbers = sorted(r[0] for r in folds.select("fold_number").distinct().collect())  # one row per fold
    corners = list(np.eye(k))
    best = {n: (np.inf, start) for n in numbers}
    low = dict.fromkeys(numbers, -np.inf)
    used = dict.fromkeys(numbers, 0)
    cuts: dict[int, list[np.ndarray]] = {n: [] for n in numbers}
    asked = {n: [start, np.full(k, 1 / k), *corners] for n in numbers}
    for number in range(1, most_rounds + 1):
        points = [(n, j, *map(float, w)) for n, ws in asked.items() for j, w in enumerate(ws)]
        if not points:
            break
        frame = spark.createDataFrame(points, "k int, j int, " + ", ".join(f"w{i} double" for i in range(k)))
        r = reduce(lambda a, b: a + b, [F.col(f"w{i}") * F.col(f"p{i}") for i in range(k)]) - F.col("y")
        both = data.join(F.broadcast(frame), F.col("fold_number") < F.col("k")).withColumn("r", r)  # a few rows per fold
        sums = both.groupBy("k", "j").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("r")).alias("loss"),
                                          *[F.avg(F.signum("r") * F.col(f"p{i}")).alias(f"g{i}") for i in range(k)]).collect()
        asked_before, asked = asked, {}
        for s in sorted(sums, key=lambda s: (s.k, s.j)):
            w, slope = asked_before[s.k][s.j], np.array([s[f"g{i}"] for i in range(k)])
            cuts[s.k].append(s.loss + slope @ (np.eye(k) - w).T)
            if s.loss < best[s.k][0] * (1 - 1e-12):
                best[s.k] = (s.loss, w)
        for n in {s.k for s in sums}:
            used[n] = number
            value, w = lower_envelope(np.array(cuts[n]))
            low[n] = max(low[n], value)
            top, where = best[n]
            if top - low[n] > gap * top:
                asked[n] = [w, (w + where) / 2, (w + 2 * where) / 3]
    out = []
    for n in numbers:
        top, w = best[n]
        known = np.isfinite(top)
        out.append((n, *map(float, w), float(top) if known else None, float(max(0.0, top - low[n]) / top) if known and top > 0 else 0.0 if known else None, used[n]))
    return spark.createDataFrame(out, "fold_number int, " + ", ".join(f"w{i} double" for i in range(k)) + ", loss double, gap double, rounds int")


def _grid_weights(rows: DataFrame, folds: DataFrame, members: Sequence[str], configured: Mapping[str, float],
                  step: float) -> DataFrame:
    k, n = len(members), round(1 / step)
    points = [tuple(c / n for c in (*p, n - sum(p))) for p in product(range(n + 1), repeat=k - 1) if sum(p) <= n]

    def loss(point) -> Column:
        mixed = reduce(lambda x, y: x + y, [F.col(f"p{i}") * F.lit(w) for i, w in enumerate(point)])
        return F.sum(F.abs(mixed - F.col("y")))

    sums = rows.groupBy("fold_number").agg(F.array(*[loss(p) for p in points]).alias("losses"))
    base = lookup(folds.select("fold_number"), sums, ["fold_number"], ["losses"])
    base = base.select("fold_number", *[F.sum(F.col("losses")[i]).over(_prior_folds()).alias(f"l{i}")
                                        for i, _ in enumerate(points)])
    best = F.array_min(F.array(*[F.struct(F.col(f"l{i}").alias("loss"), F.lit(i).alias("i"))
                                 for i, _ in enumerate(points)]))
    table = F.array(*[F.array(*[F.lit(float(w)) for w in p]) for p in points])
    pick = base.select("fold_number", "l0", best["i"].alias("i"))
    return pick.select("fold_number", *[
        F.when(F.col("l0").isNull(), F.lit(float(configured[m]))).otherwise(table[F.col("i")][j]).alias(f"w{j}")
        for j, m in enumerate(members)])


def long_weights(weights: DataFrame, members: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"w{i}").alias("weight")) for i, m in enumerate(members)])
    return weights.select("fold_number", F.explode(pairs).alias("s")).select("fold_number", "s.*")
