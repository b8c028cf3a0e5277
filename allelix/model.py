"""The sparse SNP x cell cube of allele counts, as three DataFrames.

counts holds one row per (snp_id, cell_id) with a non-zero count; an absent row means zero. snps and cells are the two
dimension tables with open schemas; `_ord` keeps the order of their rows where order matters (first of duplicates,
generated ids, merges). Metrics are joined to the dimensions when they are asked for, so they always fit the counts.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.chroms import detect_chr_style, normalize_chr_names
from allelix.functions.scalars import snp_key
from allelix.tables import written

COUNTS = ("ref_count", "alt_count", "oth_count")
SNP_METRICS, CELL_METRICS = ("coverage", "non_zero_samples"), ("library_size", "non_zero_snps")


def numbered(df: DataFrame, by: str | None = None) -> DataFrame:
    """df with `_ord`, 1-based: by a column, else by the order of its rows.

    The rows are written once with their partition and place in it, so that numbers and the ids made of them stay the
    same whatever is computed from them later; the partitions' counts give each partition's first number.
    """
    if "_ord" in df.columns and by is None:
        return df
    names = [c for c in df.columns if c != "_ord"]
    df = (df.orderBy(by) if by is not None else df).select(*names, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    rows = written(df, "numbered")
    first = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    first = first.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(first), "_part").select(*names, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_ord"))


def assign_snp_ids(snps: DataFrame) -> DataFrame:
    if "snp_id" in snps.columns:
        return snps
    parts = ("chrom", "pos", "ref", "alt")
    made = snp_key(*(F.col(c) for c in parts)) if set(parts) <= set(snps.columns) else F.concat(F.lit("snp_"), "_ord")
    return snps.select(made.alias("snp_id"), *snps.columns)


def assign_cell_ids(cells: DataFrame) -> DataFrame:
    return cells if "cell_id" in cells.columns else cells.select(F.concat(F.lit("cell_"), "_ord").alias("cell_id"), *cells.columns)


def first_of_each(dim: DataFrame, key: str = "snp_id") -> DataFrame:
    """The first row of each id."""
    return dim.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy("_ord"))).filter("_first = 1").drop("_first")


def snp_metrics(counts: DataFrame) -> DataFrame:
    total = F.col("ref_count") + F.col("alt_count")
    return counts.groupBy("snp_id").agg(F.sum(total).alias("coverage"), F.count_if(total > 0).alias("non_zero_samples"))


def cell_metrics(counts: DataFrame) -> DataFrame:
    total = F.col("ref_count") + F.col("alt_count")
    return counts.groupBy("cell_id").agg(F.sum(total).alias("library_size"), F.count_if(total > 0).alias("non_zero_snps"))


def _with_metrics(dim: DataFrame, metrics: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    kind = metrics.schema[names[0]].dataType
    return dim.drop(*names).join(metrics, key, "left").withColumns({names[0]: F.coalesce(names[0], F.lit(0).cast(kind)), names[1]: F.coalesce(names[1], F.lit(0).cast("long"))})


@dataclass(frozen=True)
class AlleleCube:
    counts: DataFrame
    snp_dim: DataFrame
    cell_dim: DataFrame
    chr_style: str = "unknown"
    fixed_snps: DataFrame | None = None  # set as given by with_snps(), metrics included
    fixed_cells: DataFrame | None = None

    @staticmethod
    def from_frames(counts: DataFrame, snps: DataFrame, cells: DataFrame, check: bool = True, style: str | None = None) -> AlleleCube:
        """From counts keyed by ids (snp_id, cell_id) or by row positions (snp_pos, cell_pos, 1-based).

        Missing ids are made up, the first of SNPs with one id stays with its counts, absent oth_count is zero.
        """
        snps, cells = assign_snp_ids(numbered(snps)), assign_cell_ids(numbered(cells))
        if "oth_count" not in counts.columns:
            counts = counts.withColumn("oth_count", F.lit(0).cast(counts.schema["ref_count"].dataType))
        kept = first_of_each(snps)
        if check:
            again = [r["snp_id"] for r in snps.groupBy("snp_id").count().filter("count > 1").orderBy("snp_id").limit(6).collect()]
            if again:
                warnings.warn(f"duplicate SNP ids, the first rows are kept: {', '.join(again[:5])}{' ...' if len(again) > 5 else ''}", stacklevel=2)
        if "snp_pos" in counts.columns:
            counts = counts.join(kept.select("snp_id", F.col("_ord").alias("snp_pos")), "snp_pos").drop("snp_pos")
        if "cell_pos" in counts.columns:
            if check and not counts.join(cells.select(F.col("_ord").alias("cell_pos")), "cell_pos", "left_anti").isEmpty():
                raise ValueError("counts have more cells than the cell table")
            counts = counts.join(cells.select("cell_id", F.col("_ord").alias("cell_pos")), "cell_pos").drop("cell_pos")
        elif check:
            for key, dim, what in (("snp_id", kept, "SNP"), ("cell_id", cells, "cell")):
                if not counts.join(dim.select(key), key, "left_anti").isEmpty():
                    raise ValueError(f"counts have a {key} that the {what} table lacks")
        if "chrom" in kept.columns:
            style = style or detect_chr_style(kept)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                kept = kept.withColumn("chrom_canonical", normalize_chr_names(F.col("chrom"), style))
        nonzero = (F.col("ref_count") != 0) | (F.col("alt_count") != 0) | (F.col("oth_count") != 0)
        return AlleleCube(counts.filter(nonzero).select("snp_id", "cell_id", *COUNTS), kept.drop(*SNP_METRICS), cells.drop(*CELL_METRICS), style or "unknown")

    @staticmethod
    def from_arrays(spark, ref, alt, snps: DataFrame, cells: DataFrame, oth=None) -> AlleleCube:
        """From dense SNP x cell arrays, for small data."""
        import numpy as np

        ref, alt = np.asarray(ref), np.asarray(alt)
        oth = np.zeros_like(ref) if oth is None else np.asarray(oth)
        if ref.shape != alt.shape or ref.shape != oth.shape:
            raise ValueError("count arrays differ in shape")
        if ref.shape != (snps.count(), cells.count()):
            raise ValueError("count arrays do not fit the SNP and cell tables")
        rows = [(i + 1, j + 1, int(ref[i, j]), int(alt[i, j]), int(oth[i, j])) for i in range(ref.shape[0]) for j in range(ref.shape[1])]
        return AlleleCube.from_frames(spark.createDataFrame(rows, "snp_pos long, cell_pos long, ref_count long, alt_count long, oth_count long"), snps, cells)

    @property
    def snps(self) -> DataFrame:
        return self.fixed_snps if self.fixed_snps is not None else _with_metrics(self.snp_dim, snp_metrics(self.counts), "snp_id", SNP_METRICS)

    @property
    def cells(self) -> DataFrame:
        return self.fixed_cells if self.fixed_cells is not None else _with_metrics(self.cell_dim, cell_metrics(self.counts), "cell_id", CELL_METRICS)

    def count_of(self, name: str) -> DataFrame:
        """ref_count, alt_count or oth_count, non-zero entries."""
        if name not in COUNTS:
            raise ValueError(f"{name} is none of {', '.join(COUNTS)}")
        return self.counts.filter(F.col(name) != 0).select("snp_id", "cell_id", name)

    def coverage(self) -> DataFrame:
        return self.counts.select("snp_id", "cell_id", (F.col("ref_count") + F.col("alt_count")).alias("coverage")).filter("coverage != 0")

    def shape(self) -> tuple[int, int]:
        return self.snp_dim.count(), self.cell_dim.count()

    def each_snp_id(self) -> Iterator[str]:
        """In order, a partition at a time."""
        return (r[0] for r in self.snp_dim.orderBy("_ord").select("snp_id").toLocalIterator())

    def each_cell_id(self) -> Iterator[str]:
        return (r[0] for r in self.cell_dim.orderBy("_ord").select("cell_id").toLocalIterator())

    def snp_ids(self) -> list[str]:
        return list(self.each_snp_id())

    def cell_ids(self) -> list[str]:
        return list(self.each_cell_id())

    def __repr__(self) -> str:
        return f"AlleleCube(snps: {', '.join(self.snp_dim.columns)}; cells: {', '.join(self.cell_dim.columns)}; chromosome style: {self.chr_style})"

    def describe(self) -> dict:
        n, m = self.shape()
        return {"snps": n, "cells": m, "snp_columns": self.snps.columns, "cell_columns": self.cells.columns, "chr_style": self.chr_style}

    def preview(self, n: int = 5) -> dict[str, DataFrame]:
        """The first n rows of the SNP and cell tables, metrics included."""
        return {"snps": self.snps.orderBy("_ord").limit(n).drop("_ord"), "cells": self.cells.orderBy("_ord").limit(n).drop("_ord")}

    def _replaced(self, df: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
        if key not in df.columns:
            raise ValueError(f"{name} needs a column {key}")
        if df.count() != dim.count():
            raise ValueError(f"{name} must have as many rows as before")
        other = df.select(key).join(dim.select(key), key, "left_anti").isEmpty() and dim.select(key).join(df.select(key), key, "left_anti").isEmpty()
        if not other:
            raise ValueError(f"{name} must have the same {key} values as before")
        return df if "_ord" in df.columns else df.join(dim.select(key, "_ord"), key)

    def with_snps(self, df: DataFrame) -> AlleleCube:
        """Sets the SNP table as given; its metrics are not computed again."""
        df = self._replaced(df, self.snp_dim, "snp_id", "the SNP table")
        return replace(self, snp_dim=df.drop(*SNP_METRICS), fixed_snps=df)

    def with_cells(self, df: DataFrame) -> AlleleCube:
        """Sets the cell table as given; its metrics are not computed again."""
        df = self._replaced(df, self.cell_dim, "cell_id", "the cell table")
        return replace(self, cell_dim=df.drop(*CELL_METRICS), fixed_cells=df)

    def keep(self, snps: DataFrame | None = None, cells: DataFrame | None = None) -> AlleleCube:
        """The part of the cube with the given ids (frames with snp_id or cell_id)."""
        counts, s, c = self.counts, self.snp_dim, self.cell_dim
        if snps is not None:
            ids = snps.select("snp_id").distinct()
            counts, s = counts.join(ids, "snp_id", "left_semi"), s.join(ids, "snp_id", "left_semi")
        if cells is not None:
            ids = cells.select("cell_id").distinct()
            counts, c = counts.join(ids, "cell_id", "left_semi"), c.join(ids, "cell_id", "left_semi")
        return AlleleCube(counts, s, c, self.chr_style)

    def subset(self, snps=None, cells=None) -> AlleleCube:
        """Rows and columns by ids, 1-based positions, or booleans.

        Each is a list or array of one of these, a range of positions, or a frame with a column of ids (snp_id, cell_id)
        or of positions (position); ranges and frames stay in Spark. Positions beyond the end are left out.
        """
        return self.keep(*(None if x is None else self._picked(x, dim, key) for x, dim, key in ((snps, self.snp_dim, "snp_id"), (cells, self.cell_dim, "cell_id"))))

    @staticmethod
    def _picked(x, dim: DataFrame, key: str) -> DataFrame:
        import numpy as np
        import pandas as pd

        spark, at = dim.sparkSession, F.col("_ord")
        if isinstance(x, DataFrame):
            if key in x.columns:
                return dim.join(x.select(key).distinct(), key, "left_semi")
            if "position" not in x.columns:
                raise ValueError(f"the frame has neither {key} nor position")
            wanted = x.select(F.col("position").cast("long").alias("_ord"))
        elif not isinstance(x, range):
            x = np.asarray(x if isinstance(x, np.ndarray) else list(x))
            if x.dtype.kind in "US" or x.dtype == object:
                return dim.join(spark.createDataFrame(pd.DataFrame({key: x.astype(str)})).distinct(), key, "left_semi")
            if x.dtype == bool and len(x) != (n := dim.count()):
                raise ValueError(f"{len(x)} booleans for {n} rows")
            x = np.flatnonzero(x) + 1 if x.dtype == bool else x.astype(np.int64)
            wanted = spark.createDataFrame(pd.DataFrame({"_ord": x})) if len(x) else spark.createDataFrame([], "_ord long")
        place = numbered(dim.select(key, "_ord"), by="_ord")  # positions within the present rows
        if isinstance(x, range):
            low, high, step = (min(x), max(x), abs(x.step)) if len(x) else (1, 0, 1)
            return place.filter(at.between(low, high) & ((at - low) % step == 0))
        return place.join(wanted.distinct(), "_ord", "left_semi")


def column_or_sql(condition: Column | str) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition
