"""Long count frames by cell, donor, clonotype or any cell column, and expression values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.scalars import expression, title
from allelix.model import AlleleCube
from allelix.operators.stats import test_maf

SNP_COLUMNS = ("gene_name", "chrom", "pos", "strand")
NOT_DONORS = ("unassigned", "doublet")


def _ratios(df: DataFrame) -> DataFrame:
    """total_count, ref_ratio and maf of the rows with any depth."""
    df = df.withColumn("total_count", F.col("ref_count") + F.col("alt_count")).filter("total_count > 0")
    return df.withColumns({"ref_ratio": F.col("ref_count") / F.col("total_count"), "maf": F.least("ref_count", "alt_count") / F.col("total_count")})


def _with_snps(df: DataFrame, cube: AlleleCube, group: str) -> DataFrame:
    names = [c for c in SNP_COLUMNS if c in cube.snp_dim.columns and c != group]
    extra = [c for c in df.columns if c not in {"snp_id", group, "ref_count", "alt_count", "total_count", "ref_ratio", "maf"}]
    joined = df.join(cube.snp_dim.select("snp_id", *names), "snp_id", "left")
    return joined.select("snp_id", *names, group, *extra, "ref_count", "alt_count", "total_count", "ref_ratio", "maf")


def groups_of(cube: AlleleCube, group_by: str) -> DataFrame:
    """(cell_id, group) of the cells that have one."""
    if group_by not in cube.cell_dim.columns:
        raise ValueError(f"the cell table has no column {group_by}")
    cells = cube.cell_dim.select("cell_id", F.col(group_by).cast("string").alias(group_by)).filter(F.col(group_by).isNotNull())
    if cells.isEmpty():
        raise ValueError(f"{title(group_by)}: all values are missing")
    return cells


def group_sums(cube: AlleleCube, cells: DataFrame, group_by: str) -> DataFrame:
    """Counts summed over the cells of each group; partial sums come before the shuffle."""
    return cube.counts.join(cells, "cell_id").groupBy("snp_id", group_by).agg(F.sum("ref_count").alias("ref_count"), F.sum("alt_count").alias("alt_count"))


def most_likely_donor(cube: AlleleCube) -> DataFrame:
    """(clonotype, donor) with the most cells; equal counts go to the donor that sorts first."""
    n = cube.cell_dim.filter("donor is not null and clonotype is not null").groupBy("clonotype", "donor").count()
    best = F.row_number().over(Window.partitionBy("clonotype").orderBy(F.desc("count"), "donor"))
    return n.withColumn("_best", best).filter("_best = 1").select(F.col("clonotype").cast("string").alias("clonotype"), "donor")


def cell_counts(cube: AlleleCube, maf_test: bool = True, p: float = 0.10) -> DataFrame:
    out = _with_snps(_ratios(cube.counts.select("snp_id", "cell_id", "ref_count", "alt_count")), cube, "cell_id")
    return test_maf(out, p, check=False) if maf_test else out


barcode_counts = cell_counts


def group_counts(cube: AlleleCube, group_by: str, maf_test: bool = True, p: float = 0.10, add_most_likely_donor: bool = False) -> DataFrame:
    """Counts by any cell column. Grouped by donor, the labels unassigned and doublet are left out."""
    if add_most_likely_donor and group_by != "clonotype":
        raise ValueError("the most likely donor can only be added to clonotypes")
    cells = groups_of(cube, group_by)
    if group_by == "donor":
        cells = cells.filter(~F.col("donor").isin(*NOT_DONORS))
    out = _ratios(group_sums(cube, cells, group_by))
    if add_most_likely_donor:
        if "donor" not in cube.cell_dim.columns:
            raise ValueError("the cell table has no column donor")
        out = out.join(most_likely_donor(cube), "clonotype", "left")
    out = _with_snps(out, cube, group_by)
    return test_maf(out, p, check=False) if maf_test else out


def donor_counts(cube: AlleleCube, maf_test: bool = True, p: float = 0.10) -> DataFrame:
    return group_counts(cube, "donor", maf_test, p)


def clonotype_counts(cube: AlleleCube, maf_test: bool = True, p: float = 0.10) -> DataFrame:
    return group_counts(cube, "clonotype", maf_test, p, add_most_likely_donor="donor" in cube.cell_dim.columns)


LEVELS = {"barcode": "cell_id", "clonotype": "clonotype", "donor": "donor"}


def expression_values(cube: AlleleCube, level: str = "barcode") -> DataFrame:
    """(snp_id, group, expr) at the level, which may be given by a unique prefix; pairs without counts are absent and mean 0."""
    found = [x for x in LEVELS if x.startswith(level)] if level else []
    if len(found) != 1:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    column = LEVELS[found[0]]
    if column == "cell_id":
        summed = cube.counts.select("snp_id", F.col("cell_id").alias("group"), "ref_count", "alt_count")
    else:
        summed = group_sums(cube, groups_of(cube, column), column).withColumnRenamed(column, "group")
    return summed.select("snp_id", "group", expression(F.col("ref_count"), F.col("alt_count")).alias("expr"))


def expression_matrix(cube: AlleleCube, level: str = "donor") -> DataFrame:
    """Expression as a wide frame, a column per group (for few groups); absent pairs are 0."""
    wide = expression_values(cube, level).groupBy("snp_id").pivot("group").agg(F.first("expr"))
    return cube.snp_dim.select("snp_id").join(wide, "snp_id", "left").fillna(0.0)


def top_snp_per_gene(snps: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """The SNP of largest coverage of each gene (SNPs without gene are one group), the first of equal ones."""
    at = Window.partitionBy(*within, "gene_name").orderBy(F.desc("coverage"), "_ord")
    return snps.withColumn("_at", F.row_number().over(at)).filter("_at = 1").drop("_at")
