"""Strictly-prior ("as of the day before") aggregates over a keyed history.

For every row the history is the set of eligible, non-null values of the same key whose date is
strictly earlier; rows sharing a date never see each other.  Ordinary keys are computed with window
expressions over one exchange on the anchor key.  A key with more rows than the configured limit is
computed at (key, day) grain instead: at most N rows of a day can matter to a last-N window, so the
per-task group is bounded by N x days whatever the number of rows, and the result is joined back on
(key, day), a join adaptive execution can split.  A median of all history descends through ranks at
(key, day) grain for every key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.operators.order_stats import prior_medians
from antecede.operators.skew import lookup, split_hot, spread

DAY = "__day"
EPOCH = "1970-01-01"

_BOUNDED = {
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


@dataclass(frozen=True)
class Prior:
    """One history: ``keys`` share it, ``value`` feeds it.

    ``outputs`` maps an output column to (aggregate, window); ``counts`` maps an output column to the
    window whose number of used observations it reports.  Window ``None`` means all history.
    """

    keys: tuple[str, ...]
    value: str
    outputs: Mapping[str, tuple[str, int | None]] = field(default_factory=dict)
    counts: Mapping[str, int | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, (agg, window) in self.outputs.items():
            if agg not in _BOUNDED:
                raise ValueError(f"unsupported aggregate {agg!r} for {name}")
        for window in [w for _, w in self.outputs.values()] + list(self.counts.values()):
            if window is not None and window <= 0:
                raise ValueError("windows must be positive")

    @property
    def bounded(self) -> dict[str, tuple[str, int]]:
        found = {n: (a, w) for n, (a, w) in self.outputs.items() if w is not None}
        found.update({n: ("count", w) for n, w in self.counts.items() if w is not None})
        return found

    @property
    def unbounded(self) -> dict[str, str]:
        found = {n: a for n, (a, w) in self.outputs.items() if w is None and a != "median"}
        found.update({n: "count" for n, w in self.counts.items() if w is None})
        return found

    @property
    def all_medians(self) -> list[str]:
        """Outputs that are the median of all history, which no sum or window can give."""
        return [n for n, (a, w) in self.outputs.items() if w is None and a == "median"]

    @property
    def names(self) -> list[str]:
        return [*self.outputs, *self.counts]

    @property
    def summed(self) -> list[str]:
        return [n for n in self.names if n not in self.all_medians]


def day_number(date: str | Column) -> Column:
    col = F.col(date) if isinstance(date, str) else date
    return F.datediff(col, F.lit(EPOCH).cast("date"))


def _counts_to_history(eligible: str | None, value: str) -> Column:
    known = F.col(value).isNotNull()
    if eligible is None:
        return known
    return F.coalesce(F.col(eligible), F.lit(False)) & known


def _running(prior: Prior, window) -> list[Column]:
    """State after each contributing row: every bounded output as a sliding aggregate."""
    value = F.col(prior.value).cast("double")
    return [
        (F.count(value) if agg == "count" else _BOUNDED[agg](value))
        .over(window.rowsBetween(-(size - 1), 0))
        .alias(name)
        for name, (agg, size) in prior.bounded.items()
    ]


def _windowed(
    df: DataFrame, priors: Sequence[Prior], order: Sequence[str], eligible: str | None,
    rest: Mapping[str, tuple[str, ...]],
) -> DataFrame:
    flags = {i: f"__e{i}" for i, _ in enumerate(priors)}
    work = df.withColumns({flags[i]: _counts_to_history(eligible, p.value) for i, p in enumerate(priors)})

    states: dict[str, Column] = {}
    for i, p in enumerate(priors):
        if p.bounded:
            w = W.partitionBy(*p.keys, flags[i]).orderBy(DAY, *order)
            states[f"__s{i}"] = F.struct(*_running(p, w))
            states[f"__r{i}"] = F.row_number().over(w)
    if states:
        work = work.withColumns(states)

    found: dict[str, Column] = {}
    for i, p in enumerate(priors):
        before = W.partitionBy(*p.keys).orderBy(DAY).rangeBetween(W.unboundedPreceding, -1)
        if p.bounded:
            last = F.max_by(F.col(f"__s{i}"), F.when(F.col(flags[i]), F.col(f"__r{i}")))
            found[f"__p{i}"] = last.over(before)
        value = F.when(F.col(flags[i]), F.col(p.value).cast("double"))
        for name, agg in p.unbounded.items():
            found[name] = (F.count(value) if agg == "count" else _BOUNDED[agg](value)).over(before)
    for name, keys in rest.items():
        before = W.partitionBy(*keys).orderBy(DAY).rangeBetween(W.unboundedPreceding, -1)
        found[name] = F.col(DAY) - F.max(DAY).over(before)
    work = work.withColumns(found)

    unpacked = {
        name: F.coalesce(F.col(f"__p{i}.{name}"), F.lit(0)) if agg == "count" else F.col(f"__p{i}.{name}")
        for i, p in enumerate(priors)
        for name, (agg, _) in p.bounded.items()
    }
    work = work.withColumns(unpacked) if unpacked else work
    names = [n for p in priors for n in p.summed] + list(rest)
    return work.select(*df.columns, *names)


def _by_day(
    df: DataFrame, prior: Prior, order: Sequence[str], eligible: str | None
) -> DataFrame:
    """(keys, day) -> outputs, with every per-task group bounded by days, not rows."""
    keys = list(prior.keys)
    contributes = _counts_to_history(eligible, prior.value)
    value = F.when(contributes, F.col(prior.value).cast("double"))
    days = df.groupBy(*keys, DAY).agg(
        F.count(value).alias("__n"),
        F.avg(value).alias("__m"),
        (F.var_pop(value) * F.count(value)).alias("__m2"),
    )
    if prior.bounded:
        most = max(size for _, size in prior.bounded.values())
        latest = W.partitionBy(*keys, DAY).orderBy(*[F.col(c).desc() for c in order])
        # row_number() <= N lets Spark drop the other rows before the shuffle (window group limit)
        tail = (
            df.where(contributes)
            .select(*keys, DAY, *order, prior.value)
            .withColumn("__k", F.row_number().over(latest))
            .where(F.col("__k") <= most)
        )
        w = W.partitionBy(*keys).orderBy(DAY, *order)
        state = (
            tail.withColumns({
                "__s": F.struct(*_running(prior, w)),
                "__next": F.lead(DAY).over(w),
            })
            .where(F.col("__next").isNull() | (F.col("__next") != F.col(DAY)))
            .select(*keys, DAY, "__s")
        )
        days = lookup(days, state, [*keys, DAY], ["__s"], null_safe=True)

    before = W.partitionBy(*keys).orderBy(DAY).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    days = days.withColumn("__c", F.try_divide(
        F.sum(F.col("__n") * F.coalesce("__m", F.lit(0.0))).over(whole), F.sum("__n").over(whole)))
    shift = F.col("__m") - F.col("__c")
    n, s1, s2 = "__pn", "__ps1", "__ps2"
    prior_cols = {
        n: F.coalesce(F.sum("__n").over(before), F.lit(0)),
        s1: F.sum(F.col("__n") * shift).over(before),
        s2: F.sum(F.col("__m2") + F.col("__n") * shift * shift).over(before),
    }
    if prior.bounded:
        prior_cols["__p"] = F.last("__s", ignorenulls=True).over(before)
    days = days.withColumns(prior_cols)
    out: list[Column] = []
    for name, (agg, _) in prior.bounded.items():
        col = F.col(f"__p.{name}")
        out.append((F.coalesce(col, F.lit(0)) if agg == "count" else col).alias(name))
    for name, agg in prior.unbounded.items():
        if agg == "count":
            col = F.col(n)
        elif agg == "mean":
            col = F.when(F.col(n) > 0, F.col(s1) / F.col(n) + F.col("__c"))
        else:
            spread = F.col(s2) - F.col(s1) * F.col(s1) / F.col(n)
            col = F.when(F.col(n) > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col(n) - 1)))
        out.append(col.alias(name))
    return days.select(*keys, DAY, *out)


def _rest_by_day(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    days = df.select(*keys, DAY).distinct()
    w = W.partitionBy(*keys).orderBy(DAY)
    return days.withColumn(name, F.col(DAY) - F.lag(DAY).over(w))


def strict_prior(
    df: DataFrame,
    priors: Sequence[Prior],
    *,
    anchor: Sequence[str],
    date: str,
    order: Sequence[str] = (),
    eligible: str | None = None,
    rest: Mapping[str, tuple[str, ...]] | None = None,
    hot_rows: int | None = None,
    hot_by: Sequence[str] | None = None,
    probe: DataFrame | None = None,
    probe_share: int = 1,
) -> DataFrame:
    """Append every output of ``priors`` to ``df``.

    ``anchor`` is contained in every key set; the one exchange is on it.  ``order`` breaks ties within
    a date when the last N rows are chosen.  ``rest`` maps an output column to keys and yields the
    days since the previous distinct date.  A NULL date would see its own row, so it is an error.
    Keys are counted on ``probe`` (default: the frame itself) by ``hot_by`` (default: the anchor); the frame has
    ``probe_share`` rows per row of the probe.
    """
    rest = dict(rest or {})
    for keys in [p.keys for p in priors] + list(rest.values()):
        if not set(anchor) <= set(keys):
            raise ValueError(f"anchor {tuple(anchor)} must be part of every key set, got {keys}")
    missing = {date, *order, *anchor, *[p.value for p in priors], *[k for p in priors for k in p.keys]}
    missing -= set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")

    required = F.when(
        F.col(date).isNull(), F.raise_error(F.lit(f"{date} must not be NULL"))
    ).otherwise(day_number(date))
    work = df.withColumn(DAY, required)
    hot_by = list(hot_by or anchor)
    if not set(hot_by) <= set(anchor):
        raise ValueError("hot_by must be part of the anchor")
    cold, hot, counted = split_hot(work, hot_by, hot_rows, probe)
    result = _windowed(spread(cold, anchor, counted * probe_share), priors, order, eligible, rest)
    if hot is not None:
        by_day = hot
        for p in priors:
            found = _by_day(hot, p, order, eligible)
            by_day = lookup(by_day, found, [*p.keys, DAY], p.summed, null_safe=True)
        for name, keys in rest.items():
            by_day = lookup(by_day, _rest_by_day(hot, name, keys), [*keys, DAY], [name], null_safe=True)
        result = result.unionByName(by_day)
    for p in priors:
        if p.all_medians:
            points = work.where(_counts_to_history(eligible, p.value))
            found = prior_medians(points, work, p.keys, DAY, p.value, "__median")
            result = lookup(result, found, [*p.keys, DAY], {n: "__median" for n in p.all_medians}, null_safe=True)
    return result.select(*df.columns, *[n for p in priors for n in p.names], *rest)


def rolling_stat(df: DataFrame, key: str, date: str, value: str, window: int, agg: str = "mean", *,
                 order: Sequence[str] = (), eligible: str | None = None, out: str = "value") -> DataFrame:
    return strict_prior(df, [Prior((key,), value, {out: (agg, window)})], anchor=[key], date=date,
                        order=order, eligible=eligible)


def rolling_by_category(df: DataFrame, key: str, date: str, value: str, category: str, window: int,
                        agg: str = "mean", *, order: Sequence[str] = (), eligible: str | None = None,
                        out: str = "value", count: str = "n_observations") -> DataFrame:
    prior = Prior((key, category), value, {out: (agg, window)}, {count: window})
    return strict_prior(df, [prior], anchor=[key], date=date, order=order, eligible=eligible)


def days_since_previous(df: DataFrame, key: str, date: str, *, out: str = "rest_days") -> DataFrame:
    return strict_prior(df, [], anchor=[key], date=date, rest={out: (key,)})


def head_to_head(df: DataFrame, key: str, opponent: str, date: str, value: str, result: str, *,
                 eligible: str | None = None, prefix: str = "head_to_head") -> DataFrame:
    """Prior average of ``value``, prior win rate and prior meetings against the same opponent."""
    score = "__result"
    priors = [
        Prior((key, opponent), value, {f"{prefix}_average": ("mean", None)}),
        Prior((key, opponent), score, {f"{prefix}_win_rate": ("mean", None)}, {f"{prefix}_matches": None}),
    ]
    work = df.withColumn(score, F.col(result).cast("int"))
    return strict_prior(work, priors, anchor=[key], date=date, eligible=eligible).drop(score)


def career_to_date(df: DataFrame, key: str, date: str, value: str, agg: str = "mean", *,
                   eligible: str | None = None, out: str = "value",
                   count: str = "n_observations") -> DataFrame:
    prior = Prior((key,), value, {out: (agg, None)}, {count: None})
    return strict_prior(df, [prior], anchor=[key], date=date, eligible=eligible)


def opponent_value(df: DataFrame, match: str, key: str, opponent: str, columns: Mapping[str, str],
                   extra_keys: Sequence[str] = (), defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left self-join: ``columns`` (output -> source) of the opponent's row of the same match.

    The other side has as many rows as this one, but few columns: by the size of the files alone it would be broadcast.
    """
    keys = {match: match, opponent: key, **{c: c for c in extra_keys}}
    found = lookup(df, df.hint("merge"), keys, columns)
    return found.fillna(defaults) if defaults else found


def opponent_rolling(df: DataFrame, match: str, key: str, opponent: str, date: str, value: str, window: int,
                     agg: str = "mean", *, order: Sequence[str] = (), eligible: str | None = None,
                     out: str = "value", count: str = "n_observations") -> DataFrame:
    """The opponent's own strictly-prior form, read off the opponent's row of the same match."""
    own = strict_prior(df, [Prior((key,), value, {"__form": (agg, window)}, {"__used": window})],
                       anchor=[key], date=date, order=order, eligible=eligible)
    joined = opponent_value(own, match, key, opponent, {out: "__form", count: "__used"}, defaults={count: 0})
    return joined.drop("__form", "__used")
