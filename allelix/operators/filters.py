"""Filters over SNPs and cells."""

from __future__ import annotations

import logging
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions.scalars import percent
from allelix.model import AlleleCube, column_or_sql

log = logging.getLogger(__name__)


def _matching(df: DataFrame, conditions: tuple[Column | str, ...], name: str) -> DataFrame:
    """Rows for which all conditions are true; a null condition drops the row."""
    try:
        for c in conditions:
            df = df.filter(column_or_sql(c))
    except AnalysisException as e:
        if "UNRESOLVED" in str(e):
            raise ValueError(f"The following columns are not present in {name}: {e}") from e
        raise
    return df


def _tell(before: DataFrame, after: DataFrame, what: str) -> None:
    """Logs how many rows were removed; the rows are counted only where such lines are wanted."""
    if log.isEnabledFor(logging.INFO):
        n, left = before.count(), after.count()
        log.info("%d of %d %s removed (%s)", n - left, n, what, percent(n - left, n))


def filter_snps(cube: AlleleCube, *conditions: Column | str, strict: bool = True) -> AlleleCube:
    """SNPs by conditions over the SNP table, metrics included. strict: an empty result is an error (one cheap job)."""
    kept = _matching(cube.snps, conditions, "the SNP table")
    if strict and kept.isEmpty():
        raise ValueError("No SNPs remain after filtering")
    _tell(cube.snp_dim, kept, "SNPs")
    return cube.keep(snps=kept)


def filter_cells(cube: AlleleCube, *conditions: Column | str, strict: bool = True) -> AlleleCube:
    kept = _matching(cube.cells, conditions, "the cell table")
    if strict and kept.isEmpty():
        raise ValueError("No barcodes remain after filtering")
    _tell(cube.cell_dim, kept, "cells")
    return cube.keep(cells=kept)


filter_barcodes = filter_samples = filter_cells


def _has(df: DataFrame, column: str) -> bool:
    if column in df.columns:
        return True
    warnings.warn(f"there is no column {column}; nothing was removed", stacklevel=3)
    return False


def remove_doublets(cube: AlleleCube, drop_na: bool = True) -> AlleleCube:
    """Without cells whose donor is doublet, and without a donor unless drop_na is false. An empty result is allowed."""
    if not _has(cube.cell_dim, "donor"):
        return cube
    return cube.keep(cells=cube.cell_dim.filter(F.coalesce(F.col("donor") != "doublet", F.lit(not drop_na))))


def remove_na_genes(cube: AlleleCube, gene_col: str = "gene_name") -> AlleleCube:
    return cube.keep(snps=cube.snp_dim.filter(F.col(gene_col).isNotNull())) if _has(cube.snp_dim, gene_col) else cube


def remove_na_clonotypes(cube: AlleleCube, clonotype_col: str = "clonotype") -> AlleleCube:
    return cube.keep(cells=cube.cell_dim.filter(F.col(clonotype_col).isNotNull())) if _has(cube.cell_dim, clonotype_col) else cube


def require_clonotypes(cube: AlleleCube) -> None:
    if "clonotype" not in cube.cell_dim.columns:
        raise ValueError("the cell table has no column clonotype")
    if cube.cell_dim.filter("clonotype is not null").isEmpty():
        raise ValueError("all clonotypes are missing")
