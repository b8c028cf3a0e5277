"""Exact order statistics of a column, whatever its size.

Equal values are counted first, by a grouping that sums up before it shuffles. A sketch cuts the distinct values into
ranges and an exact count of each range tells which of them hold the ranks asked for. Only those are looked into:
running counts within the range find the ranks. So no task holds the distinct values of the column, and the driver sees
a count for each range and the values that were asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.tables import dropped, written

RANGES = 256


def _at(cuts: list[float]):
    """The number of the range of v: how many cuts lie below it."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0)


def order_statistics(counted: DataFrame, ranks: list[int], total: int, ranges: int = RANGES) -> dict[int, float]:
    """The values at 0-based ranks in ascending order. counted: (v, n), each value with its count, `total` of them; read three times."""
    wanted = sorted({r for r in ranks if 0 <= r < total})
    if not wanted:
        return {}
    cuts = counted.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    placed = counted.withColumn("range", _at(sorted(set(cuts))))
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    before, first = 0, {}
    for k in sorted(counts):
        if any(before <= r < before + counts[k] for r in wanted):
            first[k] = before
        before += counts[k]
    start = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("range"))
    upto = start + F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    asked = F.filter(F.array(*(F.lit(r).cast("long") for r in wanted)), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    found = placed.filter(F.col("range").isin(list(first))).withColumn("upto", upto).select("v", F.explode(asked).alias("rank"))
    return {r["rank"]: float(r["v"]) for r in found.collect()}  # as many as ranks


def weighted_quantiles(counted: DataFrame, probabilities: tuple[float, ...], total: int, ranges: int = RANGES) -> list[float | None]:
    """As quantiles(), of values with their counts (v, n)."""
    if not total:
        return [None] * len(probabilities)
    at = [(total - 1) * p for p in probabilities]
    found = order_statistics(counted, [r for h in at for r in (math.floor(h), math.ceil(h))], total, ranges)
    return [found[math.floor(h)] + (h - math.floor(h)) * (found[math.ceil(h)] - found[math.floor(h)]) for h in at]


def quantiles(df: DataFrame, column: str, probabilities: tuple[float, ...], ranges: int = RANGES) -> list[float | None]:
    """Of the column's values, nulls left out, with linear interpolation between neighbours; 0 and 1 give the extremes."""
    counted = written(df.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n")), "counted")
    found = weighted_quantiles(counted, probabilities, counted.agg(F.sum("n")).first()[0] or 0, ranges)
    dropped(counted)
    return found
