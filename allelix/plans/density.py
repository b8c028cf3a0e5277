"""Kernel densities behind the density plots: Gaussian, with the rule-of-thumb bandwidth, at evenly spaced points.

Equal values are one row with a weight. A column of more distinct values than `bins` is laid on a fine grid first, each
value shared by the two grid points beside it. Each row then adds to the points within reach of the kernel, so work and
shuffle follow the number of distinct values or bins, times points, and not the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.model import AlleleCube
from allelix.operators.quantiles import weighted_quantiles
from allelix.tables import dropped, written

REACH = 8.5  # bandwidths; beyond it the kernel is under 1e-15 of its peak


def bandwidth(n: int, deviation: float, quarters: tuple[float, float], any_value: float) -> float:
    """0.9 times the lesser of standard deviation and interquartile range over 1.34, times n to the power of -1/5; where that is zero, of what is not."""
    least = min(deviation, (quarters[1] - quarters[0]) / 1.34) or deviation or abs(any_value) or 1.0
    return 0.9 * least * n**-0.2


def on_grid(counted: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(v, n) of at most bins + 1 rows: values (v, n) shared by the grid points beside them, nearer ones having more."""
    step = (high - low) / bins
    at = (F.col("v") - low) / step
    k = F.least(F.floor(at), F.lit(bins - 1))
    both = F.array(F.struct(k.alias("k"), ((k + 1 - at) * F.col("n")).alias("w")), F.struct((k + 1).alias("k"), ((at - k) * F.col("n")).alias("w")))
    return counted.select(F.explode(both).alias("e")).groupBy("e.k").agg(F.sum("e.w").alias("n")).select((F.col("k") * step + low).alias("v"), "n")


def density(df: DataFrame, column: str, points: int = 512, log10: bool = False, bins: int = 1 << 16) -> DataFrame:
    """(point, x, density) between the least and the greatest value. Fewer than two values, nulls and non-finite ones left out, give no rows; log10: of values over zero."""
    spark, v = df.sparkSession, F.col(column).cast("double")
    values = df.select((F.when(v > 0, F.log10(v)) if log10 else v).alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
    counted = written(values.groupBy("v").agg(F.count("*").alias("n")), "counted")
    # one row; sums of squares about the mean, in a second look, as they are far smaller than about zero
    r = counted.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.count("*").alias("rows")).first()
    n = r["n"] or 0
    if n < 2:
        dropped(counted)
        return spark.createDataFrame([], "point int, x double, density double")
    squares = counted.agg(F.sum(F.col("n") * (F.col("v") - r["mean"]) ** 2)).first()[0]
    h = bandwidth(n, math.sqrt(squares / (n - 1)), tuple(weighted_quantiles(counted, (0.25, 0.75), n)), r["low"])
    rows = counted if r["rows"] <= bins or r["high"] == r["low"] else on_grid(counted, r["low"], r["high"], bins)
    step = (r["high"] - r["low"]) / (points - 1)
    point = lambda x, f, last: F.greatest(F.lit(0), F.least(F.lit(last), f(x))).cast("int")
    if step > 0:
        first, last = point((F.col("v") - REACH * h - r["low"]) / step, F.ceil, points - 1), point((F.col("v") + REACH * h - r["low"]) / step, F.floor, points - 1)
    else:
        first, last = F.lit(0), F.lit(points - 1)
    at = rows.select("v", "n", F.explode(F.sequence(first, last)).alias("point"))
    x = F.col("point") * step + r["low"]
    mass = at.select("point", (F.exp(-0.5 * ((x - F.col("v")) / h) ** 2) * F.col("n")).alias("w"))
    every = spark.range(points).select(F.col("id").cast("int").alias("point"), F.lit(0.0).alias("w"))
    return mass.unionByName(every).groupBy("point").agg((F.sum("w") / (n * h * math.sqrt(2 * math.pi))).alias("density")).select("point", x.alias("x"), "density")


def library_size_density(cube: AlleleCube, **how) -> DataFrame:
    return density(cube.cells, "library_size", **how)


def snp_coverage_density(cube: AlleleCube, **how) -> DataFrame:
    """Of the logarithms of coverage."""
    return density(cube.snps, "coverage", log10=True, **how)


def maf_density(counts: DataFrame, **how) -> DataFrame:
    return density(counts, "maf", **how)
