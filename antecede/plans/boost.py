"""Boosted quantile trees: many models (folds x quantiles) grow side by side, one pass over the rows per tree level.

Rows stay where they are, in blocks of columns. A task sums its rows' gradients per model, node, feature and bin with numpy;
only these histograms are shuffled, and a reducer adds them up as a stream and answers with the best split of one feature. The
driver sees splits and leaf values, never rows or histograms. A row's score is brought up to date once per tree and kept by
the executors, so a pass costs the same whatever the number of trees before it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from antecede.session import ensure_checkpoint_dir

# tasks carry this module's functions with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of one leaf's residuals, even in asinh(residual / unit), unit being this share of the target's middle range.
CELLS, UNIT = 2048, 1e-3
#: Trees after which the rows' state is written to the checkpoint folder; between, each tree's state is kept by the executors.
KEEP_SCORES = 25
#: Rows of one model that stand side by side in a block, and rows of a partition where there are more partitions than the cores need.
BLOCK, PARTITION = 32_768, 2_000_000
#: Levels a category may have.
MOST_LEVELS = 2000


@dataclass(frozen=True)
class BoostSettings:
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    quantiles: Sequence[float] = (0.1, 0.5, 0.9)
    rounds: int = 600
    patience: int = 30
    learning_rate: float = 0.03
    depth: int = 4
    leaf_rows: int = 50
    bins: int = 255
    l1: float = 0.5
    l2: float = 2.0
    column_share: float = 0.8
    seed: int = 20250917

    def __post_init__(self) -> None:
        if self.depth > 6:
            raise ValueError("trees have at most six levels")  # a row's turns are the bits of one number

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]


@dataclass(frozen=True)
class Bins:
    """Per model: cut points of numeric features, levels of categories. Bin 0 is a missing value or an unknown level."""

    cuts: dict[int, list[np.ndarray]]
    levels: dict[int, list[list[str]]]

    def sizes(self, model: int) -> list[int]:
        return [len(c) + 2 for c in self.cuts[model]] + [len(v) + 1 for v in self.levels[model]]


@dataclass
class Tree:
    """A full binary tree; a node that is not split (feature -1) sends every row left."""

    feature: np.ndarray
    left: list[np.ndarray | None]
    gain: np.ndarray
    rows: np.ndarray
    value: np.ndarray | None = None

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << depth) - 1
        return cls(np.full(n, -1), [None] * n, np.zeros(n), np.zeros((n, 2), np.int64))

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of every row, counted within level ``depth``; ``bins`` has a line per feature.

        A feature's bin says at once which of its nodes send a row right, so a row costs one look-up per feature.
        """
        n = (1 << depth) - 1
        splits = np.flatnonzero(self.feature[:n] >= 0)
        if not len(splits):
            return np.zeros(bins.shape[1], np.int64)
        turns = 0
        for f in np.unique(self.feature[splits]):
            own = splits[self.feature[splits] == f]
            table = np.zeros(len(self.left[own[0]]), np.uint64)
            for k in own:
                table |= (~self.left[k]).astype(np.uint64) << np.uint64(k)
            turns = turns | table.astype(np.uint16 if n <= 15 else np.uint64)[bins[f]]
        if n <= 15:
            return _ends(depth)[turns]
        return _walked(turns, depth)


def _walked(turns: np.ndarray, depth: int) -> np.ndarray:
    """Where a row ends up; bit k of ``turns`` says that node k sends it right."""
    at = np.zeros(len(turns), np.int64)
    for level in range(depth):
        at = 2 * at + (turns.astype(np.uint64) >> (at + (1 << level) - 1).astype(np.uint64) & np.uint64(1)).astype(np.int64)
    return at


@lru_cache(maxsize=None)
def _ends(depth: int) -> np.ndarray:
    return _walked(np.arange(1 << (1 << depth) - 1), depth)


@dataclass
class Booster:
    """One quantile of one model."""

    model: int
    quantile: float
    start: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # after 0, 1, ... trees, per held row
    growing: bool = True

    def settle(self) -> None:
        """Keep the trees up to the least held loss (at least one)."""
        if len(self.losses) > 1:
            self.trees = self.trees[:1 + int(np.argmin(self.losses[1:]))]

    def predict(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.start + sum((t.value[t.leaves(bins, depth)] for t in self.trees), np.zeros(bins.shape[1]))


@dataclass(frozen=True)
class Ensemble:
    settings: BoostSettings
    bins: Bins
    boosters: list[Booster]

    def of(self, model: int) -> list[Booster]:
        """In the order of the quantiles."""
        return [b for b in self.boosters if b.model == model]


# --- bins -------------------------------------------------------------------------------------------


def learn_bins(core: DataFrame, settings: BoostSettings) -> Bins:
    """Cut points and category levels of every model, from its core rows alone (column ``model``)."""
    probs = [k / (settings.bins - 1) for k in range(1, settings.bins - 1)]
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in settings.numeric}
    found = core.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(v, probs, 10000).alias(f"c{i}") for i, v in enumerate(number.values())],
        *[F.collect_set(F.col(c).cast("string")).alias(f"l{i}") for i, c in enumerate(settings.categorical)]).collect()
    cuts = {r.model: [np.unique(np.array(r[f"c{i}"] or [], float)) for i, _ in enumerate(settings.numeric)] for r in found}
    levels = {r.model: [sorted(r[f"l{i}"]) for i, _ in enumerate(settings.categorical)] for r in found}
    for each in levels.values():
        for name, values in zip(settings.categorical, each):
            if len(values) > MOST_LEVELS:
                raise ValueError(f"{name} has more than {MOST_LEVELS} levels")
    return Bins(cuts, levels)


def bin_matrix(batch: pa.RecordBatch, model: int, rows: np.ndarray, bins: Bins, settings: BoostSettings) -> np.ndarray:
    """A line per feature, a column per row."""
    out = np.zeros((len(settings.features), len(rows)), np.uint16)
    for i, name in enumerate(settings.numeric):
        values = batch.column(name).to_numpy(zero_copy_only=False).astype(float)[rows]
        known = ~np.isnan(values)
        out[i, known] = 1 + np.searchsorted(bins.cuts[model][i], values[known], "left")
    for i, name in enumerate(settings.categorical):
        place = {v: k + 1 for k, v in enumerate(bins.levels[model][i])}
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        codes = np.array([place.get(v, 0) for v in column.dictionary.to_pylist()], np.uint16)
        out[len(settings.numeric) + i] = codes[column.indices.to_numpy(zero_copy_only=False)][rows]
    return out


def _typed(df: DataFrame, settings: BoostSettings) -> dict:
    return {**{c: F.col(c).cast("double") for c in settings.numeric}, **{c: F.col(c).cast("string") for c in settings.categorical}}


STATE = "model int, core int, bins binary, below binary, y binary, now binary"
STATE_TYPES = pa.schema([("model", pa.int32()), ("core", pa.int32()), *[(c, pa.binary()) for c in ("bins", "below", "y", "now")]])


def _block(model: int, core: int, bins: np.ndarray, y: np.ndarray, now: np.ndarray) -> pa.RecordBatch:
    """One block as a row: core rows first, then the held ones; ``below`` says per quantile which targets lie under the score."""
    parts = (bins, y < now, y, now)
    return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([core], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], schema=STATE_TYPES)


def binned(rows: DataFrame, bins: Bins, settings: BoostSettings, starts: dict[int, Sequence[float]]) -> DataFrame:
    """The state the passes read: blocks of one model's rows with bins, target and the score of every quantile."""
    kind = _bin_type(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        waiting: dict[int, int] = {}

        def block(m: int) -> pa.RecordBatch:
            parts = kept.pop(m)
            waiting[m] = 0
            held = np.concatenate([p[1] for p in parts])
            order = np.argsort(held, kind="stable")
            y = np.concatenate([p[2] for p in parts])[order]
            now = np.repeat(np.array(starts[m], float)[:, None], len(y), axis=1)
            return _block(m, int((~held).sum()), np.concatenate([p[0] for p in parts], axis=1)[:, order], y, now)

        for batch in batches:
            model = batch.column("model").to_numpy()
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            y = batch.column("y").to_numpy()
            for m in np.unique(model).tolist():
                own = np.flatnonzero(model == m)
                kept.setdefault(m, []).append((bin_matrix(batch, m, own, bins, settings).astype(kind), held[own], y[own]))
                waiting[m] = waiting.get(m, 0) + len(own)
                if waiting[m] >= BLOCK:
                    yield block(m)
        for m in sorted(kept):
            yield block(m)

    narrow = rows.select("model", "held", F.col("target_value").cast("double").alias("y"), *[v.alias(c) for c, v in _typed(rows, settings).items()])
    return narrow.mapInArrow(run, STATE)


def _bin_type(bins: Bins) -> type:
    return np.uint8 if max(max(bins.sizes(m)) for m in bins.cuts) <= 256 else np.uint16


# --- passes -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Work:
    """What one pass does for one booster: the tree that grows, on the features drawn for it."""

    quantile: float
    growing: Tree
    columns: Sequence[int]


def _blocks(batches: Iterator[pa.RecordBatch], work: dict[tuple[int, int], object], features: int, kind: type):
    """(model, core rows, bins, every other column by name) of every block that has work; an array has a line per feature or quantile."""
    models = {m for m, _ in work}
    for batch in batches:
        names = batch.schema.names
        for row in range(batch.num_rows):
            m = batch.column("model")[row].as_py()
            if m not in models:
                continue
            data = {c: batch.column(c)[row].as_buffer() for c in names if c not in ("model", "core")}
            bins = np.frombuffer(data["bins"], kind).reshape(features, -1)
            more = {c: np.frombuffer(v, bool if c == "below" else float) for c, v in data.items() if c != "bins"}
            yield m, batch.column("core")[row].as_py(), bins, {c: v if c == "y" else v.reshape(-1, bins.shape[1]) for c, v in more.items()}


def _depth(tree: Tree) -> int:
    return len(tree.feature).bit_length()


SUMS = "model int, q int, place int, sums binary"


def _sums(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.binary())],
                                      ["model", "q", "place", "sums"])


def _histograms(work: dict[tuple[int, int], Work], level: int, sizes: dict[int, list[int]], kind: type):
    """Gradient sums and rows by (feature; node, bin); place -1 holds the held rows' loss at the root.

    A row's gradient is one of two numbers, so rows are counted per side and multiplied once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for m, core, bins, more in _blocks(batches, work, len(next(iter(sizes.values()))), kind):
            wide: dict[int, np.ndarray] = {}
            for (model_of, q), w in work.items():
                if model_of != m:
                    continue
                if level == 0:
                    gap = more["y"][core:] - more["now"][q, core:]
                    loss = np.array([np.maximum(w.quantile * gap, (w.quantile - 1) * gap).sum(), len(gap)])
                    total[m, q, -1] = total.get((m, q, -1), 0) + loss
                side = w.growing.leaves(bins[:, :core], level) * 2 + more["below"][q, :core]
                for f in w.columns:
                    if f not in wide:
                        wide[f] = bins[f, :core].astype(np.int64)
                    n = sizes[m][f]
                    counts = np.bincount(side * n + wide[f], minlength=n << level + 1).reshape(1 << level, 2, n)
                    total[m, q, f] = total.get((m, q, f), 0) + counts
        out = []
        for (m, q, f), v in total.items():
            if f >= 0:  # rows at or above their score, rows below it
                a = work[m, q].quantile
                v = np.stack([a * v[:, 0] + (a - 1) * v[:, 1], v.sum(axis=1)])
            out.append((m, q, f, v.astype(float).tobytes()))
        yield _sums(out)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int, int], np.ndarray]:
    total: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for m, q, place, sums in zip(*(c.to_pylist() for c in batch.columns)):
            total[m, q, place] = total.get((m, q, place), 0) + np.frombuffer(sums, float)
    return total


SPLITS = "model int, q int, feature int, node int, gain double, left_bins binary, left_rows bigint, right_rows bigint, loss double"


def split_of(g: np.ndarray, n: np.ndarray, categorical: bool, s: BoostSettings) -> tuple[float, np.ndarray, int, int] | None:
    """(gain, bins that go left, rows left, rows right) of the best split of one feature's bins; missing values try both sides."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(a) - s.l1, 0) ** 2 / (b + s.l2)

    if categorical:  # ordered by their mean gradient, a subset split is a cut
        order = np.flatnonzero(n > 0)
        order = order[np.argsort(g[order] / n[order], kind="stable")]
        tries = [order]
    else:
        order = np.arange(1, len(n))
        tries = [np.concatenate([[0], order]), np.concatenate([order, [0]])] if n[0] else [order]
    best = None
    for order in tries:
        left_g, left_n = np.cumsum(g[order])[:-1], np.cumsum(n[order])[:-1]
        all_g, all_n = g[order].sum(), n[order].sum()
        enough = (left_n >= s.leaf_rows) & (all_n - left_n >= s.leaf_rows)
        if not enough.any():
            continue
        gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
        k = int(np.argmax(np.where(enough, gain, -np.inf)))
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            left = np.zeros(len(n), bool)
            left[order[:k + 1]] = True
            best = (float(gain[k]), left, int(left_n[k]), int(all_n - left_n[k]))
    return best


def _splits(settings: BoostSettings, level: int, sizes: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (m, q, f), sums in _added(batches).items():
            row = {"model": m, "q": q, "feature": f, "node": 0, "gain": 0.0, "left_bins": b"", "left_rows": 0, "right_rows": 0, "loss": None}
            if f < 0:
                out.append(row | {"loss": sums[0] / sums[1] if sums[1] else None})
                continue
            both = sums.reshape(2, 1 << level, sizes[m][f])
            for node in range(1 << level):
                found = split_of(both[0, node], both[1, node], f >= len(settings.numeric), settings)
                if found is not None:
                    gain, left, a, b = found
                    out.append(row | {"node": node, "gain": gain, "left_bins": left.tobytes(), "left_rows": a, "right_rows": b})
        kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "bigint": pa.int64()}
        yield pa.RecordBatch.from_pylist(out, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SPLITS.split(", "))]))

    return run


def _residuals(work: dict[tuple[int, int], Work], units: dict[int, float], features: int, kind: type):
    """Count, least and greatest residual of every leaf's cells that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for m, core, bins, more in _blocks(batches, work, features, kind):
            for (model_of, q), w in work.items():
                if model_of != m or not core:
                    continue
                r = more["y"][:core] - more["now"][q, :core]
                cell = np.clip(np.floor(np.arcsinh(r / units[m]) * (CELLS / 40) + CELLS / 2), 0, CELLS - 1).astype(np.int64)
                depth = _depth(w.growing)
                at = w.growing.leaves(bins[:, :core], depth) * CELLS + cell
                if (m, q) not in total:
                    total[m, q] = np.concatenate([_no_cells()] * (1 << depth), axis=1)
                cells = total[m, q]
                cells[0] += np.bincount(at, minlength=cells.shape[1])
                np.minimum.at(cells[1], at, r)
                np.maximum.at(cells[2], at, r)
        out = []
        for (m, q), cells in total.items():
            for leaf, own in enumerate(np.split(cells, cells.shape[1] // CELLS, axis=1)):
                used = np.flatnonzero(own[0])
                if len(used):
                    out.append((m, q, leaf, np.concatenate([used[None].astype(float), own[:, used]]).tobytes()))
        yield _sums(out)

    return run


def _no_cells() -> np.ndarray:
    return np.stack([np.zeros(CELLS), np.full(CELLS, np.inf), np.full(CELLS, -np.inf)])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])])


def cell_quantile(cells: np.ndarray, q: float) -> float:
    """The q-quantile of the values in the cells: exact where its cell holds one or two of them, else even between the cell's ends."""
    upto = np.cumsum(cells[0])

    def at(rank: int) -> float:
        k = int(np.searchsorted(upto, rank, "right"))
        n, lo, hi = cells[:, k]
        return lo if n == 1 else lo + (hi - lo) * (rank - (upto[k] - n)) / (n - 1)

    place = q * (upto[-1] - 1)
    low, high = int(np.floor(place)), int(np.ceil(place))
    return float(at(low) + (at(high) - at(low)) * (place - low))


VALUES = "model int, q int, leaf int, value double"


def _leaf_values(quantiles: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for m, q, leaf, sums in zip(*(c.to_pylist() for c in batch.columns)):
                used, *new = np.frombuffer(sums, float).reshape(4, -1)
                used = used.astype(np.int64)
                cells = total.setdefault((m, q, leaf), _no_cells())
                cells[:, used] = _merged(cells[:, used], np.stack(new))
        rows = [(*k, cell_quantile(v, quantiles[k[1]])) for k, v in total.items()]
        a, b, c, d = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.float64())],
                                         ["model", "q", "leaf", "value"])

    return run


def _advanced(state: DataFrame, trees: dict[tuple[int, int], Tree], features: int, kind: type) -> DataFrame:
    """The state with the scores that ``trees`` leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                for m, core, bins, more in _blocks(iter([one]), trees, features, kind):
                    now = more["now"].copy()
                    for (model_of, q), t in trees.items():
                        if model_of == m:
                            now[q] += t.value[t.leaves(bins, _depth(t))]
                    one = _block(m, core, bins, more["y"], now)
                yield one

    return state.mapInArrow(run, STATE)


# --- growing ----------------------------------------------------------------------------------------


def fit(rows: DataFrame, settings: BoostSettings) -> Ensemble:
    """Fit every quantile of every model. ``rows``: model (int), held, target_value and the features; a row may stand in many models.

    Trees fit the pinball loss's gradient by histogram splits, and every leaf takes the quantile of its rows' residuals. Held rows are
    never fitted: a booster stops after ``patience`` trees without a smaller held loss and keeps the trees up to the least one. Bins,
    levels and starting values come from core rows. Features are drawn per tree from a seed, so reruns agree.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = rows.where(F.col("target_value").isNotNull())
    core = rows.where("NOT held")
    bins = learn_bins(core, settings)
    y = F.col("target_value").cast("double")
    stats = core.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(y, list(settings.quantiles), 10000).alias("starts"),
                                      F.percentile_approx(y, [0.05, 0.95], 10000).alias("middle")).collect()
    starts = {r.model: r.starts for r in stats}
    units = {r.model: max(UNIT * (r.middle[1] - r.middle[0]), 1e-9) for r in stats}
    kind, features = _bin_type(bins), len(settings.features)
    blocks = binned(rows.join(F.broadcast(spark.createDataFrame([(m,) for m in starts], "model int")), "model"), bins, settings, starts)  # one row per model
    state = blocks.checkpoint()
    # a pass is a job, so tasks of few rows would cost more than their rows
    enough = max(2 * spark.sparkContext.defaultParallelism, sum(r.n for r in stats) // PARTITION)
    if state.rdd.getNumPartitions() > enough:
        state = state.coalesce(enough)
    sizes = {m: bins.sizes(m) for m in starts}
    boosters = {(m, q): Booster(m, alpha, float(starts[m][q])) for m in sorted(starts) for q, alpha in enumerate(settings.quantiles)}

    def work(trees: dict[tuple[int, int], Tree], columns: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], Work]:
        return {k: Work(boosters[k].quantile, trees[k], columns[k]) for k in trees}

    def reduced(data: DataFrame, run, again, schema: str) -> list:
        return data.mapInArrow(run, SUMS).repartition("model", "q", "place").mapInArrow(again, schema).collect()

    n_columns = max(1, round(settings.column_share * len(settings.features)))
    kept, past = state.persist(), None
    for number in range(settings.rounds + 1):
        trees = {k: Tree.empty(settings.depth) for k, b in boosters.items() if b.growing}
        if not trees:
            break
        columns = {k: sorted(np.random.default_rng([settings.seed, number, *k]).permutation(len(settings.features))[:n_columns].tolist()) for k in trees}
        for level in range(settings.depth if number < settings.rounds else 1):
            jobs = work(trees, columns)
            read = kept if level == 0 else kept.select("model", "core", "bins", "below")
            found = reduced(read, _histograms(jobs, level, sizes, kind), _splits(settings, level, sizes), SPLITS)
            if level == 0:
                if past is not None:  # the pass has read it for the last time
                    past.unpersist()
                    past = None
                for r in found:
                    if r.feature < 0:
                        _stop_or_go(boosters[r.model, r.q], r.loss, settings.patience)
                trees = {k: t for k, t in trees.items() if boosters[k].growing}
            for r in sorted((r for r in found if r.feature >= 0 and (r.model, r.q) in trees), key=lambda r: (r.gain, -r.feature)):
                tree, at = trees[r.model, r.q], (1 << level) - 1 + r.node  # the greatest gain comes last
                tree.feature[at], tree.left[at], tree.gain[at] = r.feature, np.frombuffer(r.left_bins, bool), r.gain
                tree.rows[at] = r.left_rows, r.right_rows
            if level == 0:
                for k in [k for k, t in trees.items() if t.feature[0] < 0]:  # nothing to split any more
                    boosters[k].growing = False
                    del trees[k]
        if number == settings.rounds or not trees:
            continue
        values = {k: np.zeros(1 << settings.depth) for k in trees}
        for r in reduced(kept.select("model", "core", "bins", "y", "now"), _residuals(work(trees, columns), units, features, kind), _leaf_values(settings.quantiles), VALUES):
            values[r.model, r.q][r.leaf] = r.value
        for k, tree in trees.items():
            tree.value = settings.learning_rate * values[k]
            boosters[k].trees.append(tree)
        state = _advanced(kept, trees, features, kind)
        if (number + 1) % KEEP_SCORES == 0:
            state = state.checkpoint()
        kept, past = state.persist(), kept
    kept.unpersist()
    if past is not None:
        past.unpersist()
    for b in boosters.values():
        b.settle()
    return Ensemble(settings, bins, list(boosters.values()))


def _stop_or_go(booster: Booster, loss: float | None, patience: int) -> None:
    """Note the held loss so far; stop after ``patience`` trees that made it no smaller."""
    if loss is None:
        return
    booster.losses.append(loss)
    trees = len(booster.losses) - 1
    if trees and trees - (1 + int(np.argmin(booster.losses[1:]))) >= patience:
        booster.growing = False


def predict(fitted: Ensemble, rows: DataFrame, model: str, out: str = "quantile_values") -> DataFrame:
    """``rows`` with an array of the quantiles that the model named by column ``model`` gives, sorted; rows of no model are left out."""
    s = fitted.settings
    by_model = {m: fitted.of(m) for m in fitted.bins.cuts}
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("__model").to_numpy(zero_copy_only=False)
            for m, boosters in by_model.items():
                own = np.flatnonzero(number == m)
                if not len(own):
                    continue
                matrix = bin_matrix(batch, m, own, fitted.bins, s)
                values = np.sort(np.stack([b.predict(matrix, s.depth) for b in boosters], axis=1), axis=1)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column("__row").take(take), pa.array(list(values), pa.list_(pa.float64()))], ["__row", out])

    given = rows.select(F.struct(*[F.col(c) for c in kept]).alias("__row"), F.col(model).cast("int").alias("__model"),
                        *[v.alias(c) for c, v in _typed(rows, s).items()])
    row = given.schema["__row"].dataType.simpleString()
    return given.mapInArrow(run, f"__row {row}, {out} array<double>").select(*[F.col("__row")[c].alias(c) for c in kept], out)


def node_table(spark, fitted: Ensemble) -> DataFrame:
    """(model, quantile, tree, node, feature_index, feature_name, gain, left_rows, right_rows): every split that was kept."""
    rows = [(b.model, float(b.quantile), t, int(k), int(tree.feature[k]), fitted.settings.features[tree.feature[k]], float(tree.gain[k]), int(tree.rows[k, 0]), int(tree.rows[k, 1]))
            for b in fitted.boosters for t, tree in enumerate(b.trees) for k in np.flatnonzero(tree.feature >= 0)]
    return spark.createDataFrame(rows, "model int, quantile double, tree int, node int, feature_index int, feature_name string, gain double, left_rows bigint, right_rows bigint")
