"""Exact quantiles of large columns from a few bounded aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values of one search that come to the driver at once; a longer interval is narrowed first.
HELD = 10_000
ACCURACY = 10_000


@dataclass
class _Search:
    """Looks for the value at a 0-based rank of a column inside [lo, hi]."""

    column: str
    rank: int
    ends: tuple[float, float]
    lo: float
    hi: float
    widen: int = 2
    value: float | None = None
    place: int = 0
    rest: int = 0

    def inside(self) -> Column:
        x = F.col(self.column)
        return F.when((x > self.lo) & (x <= self.hi), x)

    def counts(self) -> Column:
        x = F.col(self.column)
        return F.struct(F.count_if(x < self.lo).alias("below"), F.count_if(x == self.lo).alias("at"),
                        F.count(self.inside()).alias("rest"), F.min(self.inside()).alias("next"))

    def take(self, c) -> None:
        """Read the counts: found at lo, missed by the interval, or among the `rest` above lo."""
        self.place = self.rank - c["below"] - c["at"]
        self.rest = c["rest"]
        if -c["at"] <= self.place < 0:
            self.value = self.lo
        elif self.place < 0 or self.place >= self.rest:  # the estimate missed the rank
            self.lo, self.hi = self.ends
            self.widen, self.rest = self.widen * 4, -1
        elif self.rest > HELD:  # a value repeated so often that nothing shrinks is left behind
            self.lo = c["next"]

    def guess(self) -> Column:
        p, eps = self.place / self.rest, self.widen / ACCURACY
        x = F.col(self.column)
        return F.percentile_approx(F.when((x >= self.lo) & (x <= self.hi), x),
                                   [max(0.0, p - eps), min(1.0, p + eps)], ACCURACY)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], held: int = HELD) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column; nulls are left out, an empty column gives nulls.

    All columns and ranks are searched at once. A round counts each search's interval in one
    aggregate; intervals with few values are read, the others narrowed by approximate quantiles
    with a known rank error, in one aggregate each. Some rounds do for any number of rows.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = values.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).alias(c) for c in columns]).first()
    searches: dict[tuple[str, int], _Search] = {}
    for c in columns:
        lo, hi, n = ends[c]
        for p in probs if n else []:
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                searches[c, rank] = _Search(c, rank, (lo, hi), lo, hi)
    while todo := [s for s in searches.values() if s.value is None]:
        row = values.agg(*[s.counts().alias(f"s{i}") for i, s in enumerate(todo)]).first()
        for s, c in zip(todo, row):
            s.take(c)
        short = [s for s in todo if s.value is None and 0 <= s.rest <= held]
        if short:
            lists = values.agg(*[F.sort_array(F.collect_list(s.inside())).alias(f"s{i}") for i, s in enumerate(short)])
            found = lists.select(*[F.element_at(f"s{i}", s.place + 1) for i, s in enumerate(short)]).first()
            for s, v in zip(short, found):
                s.value = v
        long = [s for s in todo if s.value is None and s.rest > held]
        if long:
            row = values.agg(*[s.guess().alias(f"s{i}") for i, s in enumerate(long)]).first()
            for s, (lo, hi) in zip(long, row):
                s.lo, s.hi = lo, hi
    out = {}
    for c in columns:
        n, out[c] = ends[c]["n"], []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            pos = p * (n - 1)
            low, high = searches[c, math.floor(pos)].value, searches[c, math.ceil(pos)].value
            out[c].append(low + (high - low) * (pos - math.floor(pos)))
    return out


SKETCH_K = 4096
SKETCH_ERROR = 0.005


def quantile_sketches(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One mergeable sketch for each group and column: (by…, column, n, sketch).

    Sketches of days or files are stored once and merged by ``merge_sketches`` in any order. A sketch is
    some tens of kB whatever its rows. Nulls are left out; a column of nulls gives n = 0.
    """
    sketches = df.groupBy(*by).agg(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"),
        F.kll_sketch_agg_double(F.col(c).cast("double"), SKETCH_K).alias("sketch")).alias(f"_s{i}") for i, c in enumerate(columns)])
    return sketches.select(*by, F.inline(F.array(*[f"_s{i}" for i in range(len(columns))])))


def merge_sketches(sketches: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """(by…, column, n, prob, value) from stored sketches. The rank of a value is prob * n within SKETCH_ERROR * n
    (the sketch's own error at this size is about a quarter of it with 99 % confidence); up to SKETCH_K rows it is
    exact. Groups without a value are left out."""
    merged = sketches.where("n > 0").groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    told = F.array(*[F.struct(F.lit(p).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in probs])
    return merged.select(*by, "column", "n", F.inline(told))
