"""Exact order statistics of whole columns, by counts in ever finer bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def order_statistics(rows: DataFrame, wanted: list[tuple[str, int]], bins: int = BINS) -> dict[tuple[str, int], float]:
    """Value at each (column, rank) of `wanted`, rank 0 being the least known value; NULL and NaN are not known.

    Each pass counts the rows of the open intervals in `bins` equal bins, with the least and largest value of each bin, and
    goes on with the bin that holds the rank. A bin of one value ends the search. Bins are summed before the shuffle, and the
    driver sees at most `bins` rows an open interval, whatever the table holds. Two or three passes are usual.
    """
    names = sorted({name for name, _ in wanted})
    if not names:
        return {}
    known = {n: F.when(~F.isnan(F.col(n)), F.col(n)) for n in names}
    ends = rows.agg(*[F.struct(F.min(known[n]), F.max(known[n]), F.count(known[n])).alias(n) for n in names]).first()
    found: dict[tuple[str, int], float] = {}
    open_ = {}
    for name, rank in set(wanted):
        low, high, size = ends[name]
        if not 0 <= rank < size:
            raise ValueError(f"column {name} has no rank {rank}")
        open_[name, rank] = (low, high, 0)
    while True:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        if not open_:
            return found
        intervals = sorted({(name, low, high, before) for (name, _), (low, high, before) in open_.items()})
        cells = []
        for i, (name, low, high, _) in enumerate(intervals):
            value = F.col(name)
            # Half the values where the width is beyond the largest double; rounding keeps the order either way.
            half = 1.0 if math.isfinite(high - low) else 0.5
            share = (value * half - low * half) / (high * half - low * half)
            bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
            cells.append(F.when(value.between(low, high) & ~F.isnan(value), F.struct(
                F.lit(i).alias("interval"), bin_.alias("bin"), value.alias("value"))))
        counted = (rows.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.interval", "c.bin")
                   .agg(F.count("*").alias("n"), F.min("c.value").alias("low"), F.max("c.value").alias("high"))
                   .orderBy("interval", "bin").collect())
        for key, (low, high, before) in list(open_.items()):
            place = intervals.index((key[0], low, high, before))
            for row in counted:
                if row["interval"] != place:
                    continue
                if key[1] < before + row["n"]:
                    # A bin as wide as its interval can only hold values too close for the division.
                    if (row["low"], row["high"]) == (low, high):
                        found[key] = _among_neighbours(rows, key[0], low, high, key[1] - before)
                        del open_[key]
                    else:
                        open_[key] = (row["low"], row["high"], before)
                    break
                before += row["n"]


def _among_neighbours(rows: DataFrame, name: str, low: float, high: float, rank: int) -> float:
    for row in rows.filter(F.col(name).between(low, high) & ~F.isnan(name)).groupBy(name).count().orderBy(name).toLocalIterator():
        if rank < row["count"]:
            return row[name]
        rank -= row["count"]
    raise AssertionError("the rank lies in the interval")


def quantiles(rows: DataFrame, fractions: dict[str, float], bins: int = BINS) -> dict[str, float | None]:
    """Quantile of each column, between two neighbours by their distance; None for a column without known values."""
    sizes = rows.agg(*[F.count(F.when(~F.isnan(F.col(n)), F.col(n))).alias(n) for n in fractions]).first()
    places = {n: (sizes[n] - 1) * q for n, q in fractions.items() if sizes[n]}
    found = order_statistics(rows, [(n, int(f(p))) for n, p in places.items() for f in (math.floor, math.ceil)], bins)
    result: dict[str, float | None] = dict.fromkeys(fractions)
    for n, p in places.items():
        low, high = found[n, math.floor(p)], found[n, math.ceil(p)]
        result[n] = low if low == high else low + (high - low) * (p - math.floor(p))
    return result
