"""Exact quantiles of whole columns by distributed selection: counts of value ranges, refined where the ranks lie."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Ranges that a pass cuts an interval into, and values of an interval that may be fetched instead.
RANGES, FEW = 1024, 4096


@dataclass(frozen=True)
class _Interval:
    """Values of a column from low to high, both of which occur; below is the number of smaller ones, n the number of its own."""

    column: str
    low: float
    high: float
    below: int
    n: int

    def place(self, straight: bool) -> Column:
        """The number of a value's range, by an increasing function: straight, or logarithmic on both sides of 0 for wide spreads."""

        def key(x: Column) -> Column:
            return x / 2 if straight else F.signum(x) * F.log1p(F.abs(x))

        low, high = key(F.lit(self.low)), key(F.lit(self.high))
        share = F.when(high > low, (key(F.col(self.column)) - low) / (high - low)).otherwise((F.col(self.column) > self.low).cast("double"))
        return F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")

    def holds(self) -> Column:
        return F.col(self.column).between(self.low, self.high)


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """For each name the quantile (column, share) as ``percentile`` gives it, interpolated; null without values.

    The columns are written once.  A pass counts, for all intervals that still hold a
    wanted rank, the values of RANGES ranges with their least and greatest value; the
    ranges with the ranks are the next intervals, until they are one value or few.  What
    reaches a task or the driver is bounded by RANGES and FEW for each wanted rank,
    whatever the number of rows or of different values.  Nulls and NaN do not count.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = written(df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns)), "values")
    whole = values.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("low", F.min), ("high", F.max)))).first()
    counts = {c: whole[f"n{i}"] for i, c in enumerate(columns)}
    ranks = {c: {r for name, (of, p) in wanted.items() if of == c and counts[c] for r in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))} for c in columns}
    found: dict[tuple[str, int], float] = {}
    waiting = [_Interval(c, whole[f"low{i}"], whole[f"high{i}"], 0, counts[c]) for i, c in enumerate(columns) if counts[c]]
    step = 0
    while waiting:
        wide = []
        few = [v for v in waiting if v.low < v.high and v.n <= FEW]
        for v in waiting:
            if v.low == v.high:
                found |= {(v.column, r): v.low for r in ranks[v.column] if v.below <= r < v.below + v.n}
            elif v.n > FEW:
                wide.append(v)
        if few:
            pairs = F.array_compact(F.array(*(F.when(v.holds(), F.struct(F.lit(i).alias("i"), F.col(v.column).alias("x"))) for i, v in enumerate(few))))
            fetched = sorted(tuple(r) for r in values.select(F.explode(pairs).alias("p")).select("p.i", "p.x").collect())  # FEW for each interval at most
            for i, v in enumerate(few):
                own = [x for k, x in fetched if k == i]
                found |= {(v.column, r): own[r - v.below] for r in ranks[v.column] if v.below <= r < v.below + v.n}
        waiting = []
        if wide:
            cells = F.array_compact(F.array(*(F.when(v.holds(), F.struct(F.lit(i).alias("i"), v.place(step % 2 == 1).alias("place"), F.col(v.column).alias("x"))) for i, v in enumerate(wide))))
            rows = values.select(F.explode(cells).alias("c")).groupBy("c.i", "c.place").agg(F.count(F.lit(1)).alias("n"), F.min("c.x").alias("low"), F.max("c.x").alias("high")).collect()
            below = {i: v.below for i, v in enumerate(wide)}
            for r in sorted(rows, key=lambda r: (r["i"], r["place"])):
                c, start = wide[r["i"]].column, below[r["i"]]
                below[r["i"]] += r["n"]
                if any(start <= k < start + r["n"] for k in ranks[c]):
                    waiting.append(_Interval(c, r["low"], r["high"], start, r["n"]))
        step += 1

    def value(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        at = p * (counts[c] - 1)
        low, high = math.floor(at), math.ceil(at)
        a, b = found[c, low], found[c, high]
        return a if low == high or a == b else (high - at) * a + (at - low) * b

    return {name: value(c, p) for name, (c, p) in wanted.items()}
