"""Data behind the plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.model import AlleleCube


def histogram(df: DataFrame, column: str, bins: int = 50, log10: bool = False) -> DataFrame:
    """(bin, low, high, n, density) of the column's values; two passes, one row per bin comes out."""
    v = F.when(F.col(column) > 0, F.log10(F.col(column).cast("double"))) if log10 else F.col(column).cast("double")
    values = df.select(v.alias("v")).filter("v is not null")
    span = values.agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("*").alias("total"))
    width = F.greatest((F.col("z") - F.col("a")) / bins, F.lit(1e-12))
    at = values.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1)).cast("int"))
    out = at.groupBy("bin").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first(width).alias("w"), F.first("total").alias("total"))
    return out.select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n", (F.col("n") / F.col("total") / F.col("w")).alias("density"))


def library_size_frame(cube: AlleleCube, bins: int = 50) -> DataFrame:
    return histogram(cube.cells, "library_size", bins)


def snp_coverage_frame(cube: AlleleCube, bins: int = 50) -> DataFrame:
    return histogram(cube.snps, "coverage", bins, log10=True)


def maf_frame(counts: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(counts, "maf", bins)


def gene_track(genes: DataFrame, low: int, high: int) -> DataFrame:
    return genes.filter((F.col("end") >= low) & (F.col("start") <= high)).select("chrom", "start", "end", "gene_name")


def maf_track(counts: DataFrame, facet: str = "donor", low: int | None = None, high: int | None = None) -> DataFrame:
    at = counts if low is None else counts.filter(F.col("pos").between(low, high))
    return at.select("pos", "maf", F.col(facet).alias("facet"))


def p_value_track(counts: DataFrame, facet: str = "donor", low: int | None = None, high: int | None = None) -> DataFrame:
    at = counts if low is None else counts.filter(F.col("pos").between(low, high))
    return at.select("pos", F.when(F.col("adj_p_val") > 0, -F.log10("adj_p_val")).alias("neg_log10_p"), F.col(facet).alias("facet"))
