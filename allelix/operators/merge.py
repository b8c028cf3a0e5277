"""Merging two cubes with a join rule for each axis; counts that both have are added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.model import COUNTS, AlleleCube, first_of_each, numbered
from allelix.tables import dealt

HOW = {"union": "full", "intersect": "inner", "left": "left", "right": "right"}


def merge_dims(x: DataFrame, y: DataFrame, key: str, how: str) -> DataFrame:
    """Dimension tables joined by key: columns of both are coalesced, x first, and come last; order is x, then new of y."""
    shared = [c for c in x.columns if c in y.columns and c not in (key, "_ord")]
    y2 = y.withColumnsRenamed({c: f"_y_{c}" for c in y.columns if c != key})
    joined = x.withColumnRenamed("_ord", "_x_ord").join(y2, key, HOW[how])
    own = [c for c in x.columns if c not in (*shared, key, "_ord")]
    other = [c for c in y.columns if c not in (*shared, key, "_ord")]
    order = F.struct(F.col("_x_ord").isNull().alias("new"), F.coalesce("_x_ord", "_y__ord").alias("at"))
    if how == "right":
        order = F.struct(F.lit(False).alias("new"), F.col("_y__ord").alias("at"))
    out = joined.select(key, *own, *(F.col(f"_y_{c}").alias(c) for c in other), *(F.coalesce(F.col(c), F.col(f"_y_{c}")).alias(c) for c in shared), order.alias("_sort"))
    return numbered(out, by="_sort").drop("_sort")


def merge_cubes(x: AlleleCube, y: AlleleCube, snp_join: str = "union", cell_join: str = "union", strict: bool = True) -> AlleleCube:
    """The cells of both are matched by barcode if both have it, else by cell_id; with barcodes, cell ids are made anew."""
    for how in (snp_join, cell_join):
        if how not in HOW:
            raise ValueError(f"{how} is none of {', '.join(HOW)}")
    made = lambda n: F.concat(F.lit("cell_"), n)
    key = "barcode" if "barcode" in x.cell_dim.columns and "barcode" in y.cell_dim.columns else "cell_id"
    snps = merge_dims(x.snp_dim, y.snp_dim, "snp_id", snp_join)
    sides = []
    for cube in (x, y):
        cells = cube.cell_dim
        if key == "barcode":
            cells = first_of_each(cells.filter("barcode is not null"), "barcode").drop("cell_id")
        sides.append(cells)
    cells = merge_dims(*sides, key, cell_join)
    if key == "barcode":
        cells = cells.select(made(F.col("_ord")).alias("cell_id"), *cells.columns)
    if strict:
        for dim, what in ((snps, "SNPs"), (cells, "cells")):
            if dim.isEmpty():
                raise ValueError(f"No {what} to retain after merge")

    # tables of cells are small beside their counts, which are not sorted for the join but looked up as they come
    def renumbered(cube: AlleleCube) -> DataFrame:
        numbers = cube.cell_dim.select(F.col("cell_id").alias("_old"), "barcode").join(cells.select("barcode", F.col("_ord").alias("_cell")), "barcode").drop("barcode")
        return cube.counts.withColumnRenamed("cell_id", "_old").join(numbers.hint("shuffle_hash"), "_old").select("_cell", *COUNTS, "snp_id")

    if key == "barcode":  # few entries are in both, so nothing is added up before; on the way they hold the number, which is shorter than the id
        cell_id = made(F.col("_cell"))
        both = dealt(renumbered(x).unionByName(renumbered(y)), cell_id).select("snp_id", cell_id.alias("cell_id"), *COUNTS)
    else:
        both = dealt(x.counts.unionByName(y.counts), "cell_id").join(cells.select("cell_id").hint("shuffle_hash"), "cell_id")
    both = both.join(snps.select("snp_id"), "snp_id", "left_semi")
    counts = both.groupBy("snp_id", "cell_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return AlleleCube(counts, snps, cells, x.chr_style if x.chr_style == y.chr_style or y.chr_style == "unknown" else "unknown" if x.chr_style != "unknown" else y.chr_style)
