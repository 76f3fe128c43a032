"""Exact ranks, percentiles and positions without a global sort.

A percentile bucket is a set of cut values, and a cut value is an order
statistic.  The k-th smallest value of a column is found by narrowing: rough
quantiles bracket it, one counting pass checks the bracket and says how many
values lie below, and the few distinct values left inside settle it.  Each pass
is an aggregate that combines on the map side, so no row is shuffled or sorted
whatever the size of the table.  Like any fit, the narrowing runs when it is
called; applying the cuts is a plain column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import reliable_checkpoint

# Relative accuracy of the bracketing quantiles.
_ACCURACY = 10_000
_GRID = [i / 1000 for i in range(1001)]
# Rows that may be left in a bracket when the driver reads its values; a fuller
# one narrows on.
_BRACKET_ROWS = 20_000
# Groups longer than this get their positions range by range.
HOT_GROUP_ROWS = 5_000_000

Ranks = Callable[[int], list[int]]


@dataclass
class _Bracket:
    """Where one order statistic must lie: between two values, with the exact
    counts below and up to each of them."""

    rank: int
    lo: float
    hi: float
    counts: tuple[int, int, int, int] = (0, 0, 0, 0)  # < lo, <= lo, < hi, <= hi

    @property
    def value(self) -> float | None:
        """The answer, once the rank falls on an edge."""
        below_lo, to_lo, below_hi, to_hi = self.counts
        if below_lo <= self.rank < to_lo:
            return self.lo
        return self.hi if below_hi <= self.rank < to_hi else None

    @property
    def inside(self) -> int:
        """Rows strictly between the edges, if the rank is among them."""
        _, to_lo, below_hi, _ = self.counts
        return below_hi - to_lo if to_lo <= self.rank < below_hi else 0


@dataclass(frozen=True)
class OrderStatistics:
    """Row count of a metric and the values found at the asked ranks."""

    n: int
    at: dict[int, float]


def order_statistics(
    measures: DataFrame, ranks: Ranks, key: str = "metric", value: str = "value"
) -> dict[str, OrderStatistics]:
    """Values at 0-based ranks of each metric; NULL and NaN are not measured.

    ``ranks`` maps a row count to the ranks wanted; ``key`` has few values."""
    rows = measures.select(key, F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v") & F.col(key).isNotNull())
    sizes = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.percentile_approx("v", _GRID, _ACCURACY).alias("q")).collect()
    state: dict[str, list[_Bracket]] = {}
    bounds = {}
    for s in sizes:
        bounds[s[key]] = (s["n"], s["lo"], s["hi"])
        state[s[key]] = [_start(r, s["n"], s["lo"], s["hi"], s["q"]) for r in sorted(set(ranks(s["n"])))]
    found = {m: {} for m in state}
    while any(state.values()):
        _count(rows, key, state)
        for m, brackets in state.items():
            found[m].update({b.rank: b.value for b in brackets if b.value is not None})
        state = {m: [b for b in bs if b.value is None] for m, bs in state.items()}
        _widen(state, bounds)
        small = {m: [b for b in bs if 0 < b.inside <= _BRACKET_ROWS] for m, bs in state.items()}
        if any(small.values()):
            for m, rank, v in _read(rows, key, small):
                found[m][rank] = v
            state = {m: [b for b in bs if b not in small[m]] for m, bs in state.items()}
        _narrow(rows, key, state)
    return {m: OrderStatistics(bounds[m][0], found[m]) for m in found}


def _start(rank: int, n: int, lo: float, hi: float, q: list[float]) -> _Bracket:
    """First bracket: the quantiles a step either side of the rank."""
    spot = rank / max(1, n - 1) * (len(q) - 1)
    slack = len(q) * 2.0 / _ACCURACY + 1e-9
    left, right = math.floor(spot - slack), math.ceil(spot + slack)
    return _Bracket(rank, lo if left <= 0 else q[left], hi if right >= len(q) - 1 else q[right])


def _steps(per_metric: dict[str, list[float]], key: str, value: str, tests: tuple[str, ...]) -> Column:
    """How many of the tests ``value > e``, ``value >= e`` hold over the edges
    of a row's metric: one integer column of plain comparisons.  Edges are
    literals, so infinities are edges like any other."""
    steps = F.lit(None).cast("int")
    for m, edges in per_metric.items():
        passed = F.lit(0)
        for e in edges:
            for t in tests:
                test = F.col(value) > F.lit(float(e)) if t == ">" else F.col(value) >= F.lit(float(e))
                passed = passed + test.cast("int")
        steps = F.when(F.col(key) == F.lit(m), passed).otherwise(steps)
    return steps


def _edges(state: dict[str, list[_Bracket]]) -> dict[str, list[float]]:
    return {m: sorted({e for b in bs for e in (b.lo, b.hi)}) for m, bs in state.items() if bs}


def _zones(rows: DataFrame, key: str, edges: dict[str, list[float]]) -> DataFrame:
    """Rows with ``zone``: 2i between edge i-1 and edge i, 2i+1 on edge i."""
    return rows.withColumn("zone", _steps(edges, key, "v", (">", ">=")))


def _count(rows: DataFrame, key: str, state) -> None:
    """Exact counts at the bracket edges of every metric, in one pass."""
    edges = _edges(state)
    zones: dict[str, dict[int, int]] = {}
    for r in _zones(rows, key, edges).groupBy(key, "zone").agg(F.count(F.lit(1)).alias("c")).collect():
        zones.setdefault(r[key], {})[r["zone"]] = r["c"]
    for m, brackets in state.items():
        def before(zone: int, m=m) -> int:
            return sum(c for z, c in zones[m].items() if z < zone)

        for b in brackets:
            lo, hi = (2 * edges[m].index(e) + 1 for e in (b.lo, b.hi))
            b.counts = (before(lo), before(lo + 1), before(hi), before(hi + 1))


def _widen(state, bounds) -> None:
    """A bracket that missed its rank opens to the end it missed on."""
    for m, brackets in state.items():
        _, lo, hi = bounds[m]
        for b in brackets:
            if b.rank < b.counts[0]:
                b.lo, b.hi, b.counts = lo, b.lo, (0, 0, 0, 0)
            elif b.rank >= b.counts[3]:
                b.lo, b.hi, b.counts = b.hi, hi, (0, 0, 0, 0)


def _read(rows: DataFrame, key: str, small):
    """The values strictly inside the small brackets, counted; a bounded read."""
    edges = _edges(small)
    wanted = F.lit(False)
    for m, bs in small.items():
        inside = sorted({z for b in bs for z in range(
            2 * edges[m].index(b.lo) + 2, 2 * edges[m].index(b.hi) + 1)})
        if inside:
            wanted = wanted | ((F.col(key) == m) & F.col("zone").isin(inside))
    got: dict[str, list] = {}
    for r in _zones(rows, key, edges).where(wanted).groupBy(key, "v").agg(
            F.count(F.lit(1)).alias("c")).collect():
        got.setdefault(r[key], []).append((r["v"], r["c"]))
    for m, brackets in small.items():
        values = sorted(got.get(m, []))
        for b in brackets:
            seen = b.counts[1]
            for v, c in values:
                if b.lo < v < b.hi:
                    seen += c
                    if b.rank < seen:
                        yield m, b.rank, v
                        break


def _narrow(rows: DataFrame, key: str, state) -> None:
    """Quantiles of the crowded brackets pull their edges in."""
    crowded = {m: [b for b in bs if b.inside] for m, bs in state.items()}
    for i in range(max(len(bs) for bs in crowded.values())):
        slot = {m: [bs[i].lo, bs[i].hi] for m, bs in crowded.items() if i < len(bs)}
        # Zone 2 of two edges is the open interval between them.
        between = _zones(rows, key, slot).where("zone = 2")
        for r in between.groupBy(key).agg(
                F.percentile_approx("v", _GRID, _ACCURACY).alias("q")).collect():
            b = crowded[r[key]][i]
            inner = _start(b.rank - b.counts[1], b.inside, b.lo, b.hi, r["q"])
            b.lo, b.hi = inner.lo, inner.hi


# ------------------------------------------------------------ percentile buckets

def bucket_of(rank: int, n: int) -> int:
    """0-10 bucket of a 0-based rank, rounded half to even."""
    return min(10, max(0, round(rank / max(1, n - 1) * 10)))


def _first_ranks(n: int) -> dict[int, int]:
    """For each bucket 1-10 the smallest rank inside it, where there is one."""
    out = {}
    for bucket in range(1, 11):
        guess = max(1, int((bucket - 0.5) * (n - 1) / 10) - 2)
        first = next((r for r in range(guess, min(n, guess + 6)) if bucket_of(r, n) >= bucket), None)
        if first is not None:
            out[bucket] = first
    return out


def bucket_cuts(measures: DataFrame, key: str = "metric", value: str = "value") -> dict[str, list[float]]:
    """Per metric the values a row must exceed to reach buckets 1, 2, ... 10.

    Ties share the lowest rank: a row is in bucket b or above exactly when more
    rows lie below it than the bucket's first rank, that is, when it exceeds
    the value just before that rank."""
    stats = order_statistics(
        measures, lambda n: [r - 1 for r in _first_ranks(n).values()], key, value)
    return {m: [s.at[r - 1] for r in _first_ranks(s.n).values()] for m, s in stats.items()}


def apply_cuts(cuts: dict[str, list[float]], key: str = "metric", value: str = "value") -> Column:
    """Bucket column from fitted cuts; NULL where the value is NULL or NaN, and
    where the metric has no name."""
    number = F.col(value).cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), _steps(cuts, key, value, (">",)))


def percentile_buckets(
    measures: DataFrame, key: str = "metric", value: str = "value"
) -> DataFrame:
    """``measures`` with ``bucket``: the 0-10 percentile rank inside ``key``.

    NULL and NaN values keep a NULL bucket.  Negate the value to invert a measure.
    """
    return measures.withColumn("bucket", apply_cuts(bucket_cuts(measures, key, value), key, value))


# --------------------------------------------------------------------- quantiles

def nearest_rank(measures: DataFrame, qs: dict[str, float], key: str = "metric",
                 value: str = "value") -> DataFrame:
    """Quantiles by position ``round(q * (n - 1))``: ``key, n, <name>...``"""
    def spot(q: float, n: int) -> int:
        return min(n - 1, math.floor(q * (n - 1) + 0.5))

    stats = order_statistics(measures, lambda n: [spot(q, n) for q in qs.values()], key, value)
    rows = [(m, s.n, *[s.at[spot(q, s.n)] for q in qs.values()]) for m, s in stats.items()]
    columns = ", ".join(f"{name} double" for name in qs)
    return measures.sparkSession.createDataFrame(rows, f"{key} string, n long, {columns}")


def interpolated_quantile(measures: DataFrame, q: float, key: str = "metric",
                          value: str = "value") -> DataFrame:
    """``key, q_value``: linear interpolation between the two nearest values."""
    def ends(n: int) -> list[int]:
        return [math.floor(q * (n - 1)), math.ceil(q * (n - 1))]

    stats = order_statistics(measures, ends, key, value)
    rows = []
    for m, s in stats.items():
        lo, hi = (s.at[r] for r in ends(s.n))
        rows.append((m, lo + (hi - lo) * (q * (s.n - 1) - math.floor(q * (s.n - 1)))))
    return measures.sparkSession.createDataFrame(rows, f"{key} string, q_value double")


# --------------------------------------------------------------------- positions

def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str = "position",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """0-based dense positions inside each group.

    The longest group is measured first.  Groups that fit a task are numbered
    by one window; otherwise rows are range-partitioned by (keys, order), the
    placement is fixed by a checkpoint, and each range adds the counts of the
    ranges before it.
    """
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    placed = reliable_checkpoint(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_range")
    offsets = counts.withColumn("_off", F.sum("_c").over(before) - F.col("_c")).drop("_c")
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        placed.withColumn("_pos", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col("_off") + F.col("_pos")).cast("long"))
        .drop("_range", "_off", "_pos"))


def scaled_to_observed(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """Min-max scaling over the rows at hand; NULL stays no data."""
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e"))
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return df.withColumn("_e", edges.scalar()).withColumn(
        name, (F.col(value) - lo) / span).drop("_e")
