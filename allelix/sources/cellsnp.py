"""Bundles of count matrices, variants, cells, donors and clonotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions.scalars import without_suffix
from allelix.model import AlleleCube, numbered
from allelix.operators.annotate import add_gene_names
from allelix.sources.files import check_file, delimited, exists, write_lines
from allelix.sources.mtx import read_entries, write_mtx
from allelix.sources.vcf import BASE, read_vcf_base
from allelix.tables import scratch, written

ANNOTATION = ("chrom", "start", "end", "gene_name")
#: File names of the layout.
AD, DP, OTH, VCF, SAMPLES, DONORS, CONTIGS = "cellSNP.tag.AD.mtx", "cellSNP.tag.DP.mtx", "cellSNP.tag.OTH.mtx", "cellSNP.base.vcf.gz", "cellSNP.samples.tsv", "donor_ids.tsv", "filtered_contig_annotations.csv"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, "\t", ["barcode"])


def read_donors(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, "\t")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    df = delimited(spark, path, ",")
    return df.withColumn("barcode", without_suffix(F.col("barcode"))) if "barcode" in df.columns else df


def merge_cell_annotations(donors: DataFrame, contigs: DataFrame | None = None, barcode_column: str = "barcode", clonotype_column: str = "raw_clonotype_id") -> DataFrame:
    """Cells with cell_id, barcode, donor, clonotype and what else the donor table has."""
    cells = numbered(donors)
    for old in ("cell", "cell_id"):
        if "barcode" not in cells.columns and old in cells.columns:
            cells = cells.withColumnRenamed(old, "barcode")
    if "donor_id" in cells.columns:
        cells = cells.withColumnRenamed("donor_id", "donor")
    if contigs is not None:
        for c in (barcode_column, clonotype_column):
            if c not in contigs.columns:
                raise ValueError(f"the contig table has no column {c}")
        pairs = contigs.select(F.col(barcode_column).alias("barcode"), F.col(clonotype_column).alias("clonotype")).distinct()
        cells = cells.drop("clonotype").join(pairs, "barcode", "left")
    for c in ("donor", "clonotype"):
        if c not in cells.columns:
            cells = cells.withColumn(c, F.lit(None).cast("string"))
    rest = [c for c in cells.columns if c not in ("cell_id", "barcode", "donor", "clonotype", "_ord")]
    return cells.select(F.concat(F.lit("cell_"), "_ord").alias("cell_id"), "barcode", "donor", "clonotype", *rest, "_ord")


def import_bundle(spark: SparkSession, folder: str, genes: DataFrame, contigs: str | None = None, donors: str | None = None, barcode_column: str = "barcode", clonotype_column: str = "raw_clonotype_id") -> AlleleCube:
    """A cube from a bundle. Cells are the matrices' columns, in the order of the samples file where there is one, and are tied to donors by barcode."""
    missing = [c for c in ANNOTATION if c not in genes.columns]
    if missing:
        raise ValueError(f"the gene annotation lacks {', '.join(missing)}")
    for name in (DP, AD, OTH, VCF):
        check_file(spark, f"{folder}/{name}")
    for path in (contigs, donors):
        if path:
            check_file(spark, path)
    matrices = {c: read_entries(spark, f"{folder}/{n}", c) for n, c in ((DP, "depth"), (AD, "alt_count"), (OTH, "oth_count"))}
    shape = matrices["depth"][1]
    kind = {c: e.schema[c].dataType for c, (e, _) in matrices.items()}
    depth, alt, oth = (e.select("row", "col", *(F.col(x) if x == c else F.lit(0).cast(kind[x]).alias(x) for x in kind)) for c, (e, _) in matrices.items())
    # what the matrices say of an entry meets once
    counts = written(depth.unionByName(alt).unionByName(oth).groupBy("row", "col").agg(*(F.sum(c).alias(c) for c in kind)), "bundle").filter("depth <> 0 or alt_count <> 0 or oth_count <> 0")
    counts = counts.select(F.col("row").alias("snp_pos"), F.col("col").alias("cell_pos"), (F.col("depth") - F.col("alt_count")).alias("ref_count"), "alt_count", "oth_count")
    snps = add_gene_names(read_vcf_base(spark, f"{folder}/{VCF}"), genes)
    samples = read_samples(spark, f"{folder}/{SAMPLES}") if exists(spark, f"{folder}/{SAMPLES}") else None
    if donors:
        table = read_donors(spark, donors)
        name = next(c for c in ("barcode", "cell", "cell_id") if c in table.columns)
        if samples is not None and samples.join(table.select(F.col(name).alias("barcode")), "barcode", "left_anti").isEmpty():
            table = samples.join(table.drop("_ord").withColumnRenamed(name, "barcode"), "barcode", "left")
    elif samples is not None:
        table = samples.withColumn("donor_id", F.lit("donor0"))
    else:
        raise FileNotFoundError(f"Required file not found: {folder}/{SAMPLES}")
    cells = merge_cell_annotations(table, read_contigs(spark, contigs) if contigs else None, barcode_column, clonotype_column)
    if cells.count() != shape[1]:
        raise ValueError(f"{cells.count()} cells for {shape[1]} matrix columns; a barcode may have several clonotypes")
    return AlleleCube.from_frames(counts, snps, cells)


def export_bundle(cube: AlleleCube, folder: str) -> None:
    """Writes what import_bundle reads; single files, as the layout asks."""
    for dim, names, what in ((cube.snp_dim, ("chrom", "pos", "ref", "alt"), "SNP"), (cube.cell_dim, ("barcode", "donor"), "cell")):
        missing = [c for c in names if c not in dim.columns]
        if missing:
            raise ValueError(f"the {what} table lacks {', '.join(missing)}")
    with scratch(cube.counts.sparkSession):
        _export(cube, folder)


def _export(cube: AlleleCube, folder: str) -> None:
    snps, cells = (numbered(d.drop("_at"), by="_ord") for d in (cube.snp_dim, cube.cell_dim))
    placed = cube.counts.join(snps.select("snp_id", F.col("_ord").alias("row")), "snp_id").join(cells.select("cell_id", F.col("_ord").alias("col")), "cell_id")
    placed = written(placed.select("row", "col", "alt_count", (F.col("ref_count") + F.col("alt_count")).alias("depth"), "oth_count"), "placed")  # three files are made of it
    shape = (snps.count(), cells.count())
    for name, value in ((AD, F.col("alt_count")), (DP, F.col("depth")), (OTH, F.col("oth_count"))):
        write_mtx(placed.select("row", "col", value.alias("value")), shape, f"{folder}/{name}")
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in snps.columns else F.lit(".")
    write_lines(snps.select("_ord", F.concat_ws("\t", *map(field, BASE)).alias("line")), f"{folder}/{VCF}", gzip=True)
    line = lambda *c: F.concat_ws("\t", *(F.coalesce(F.col(x), F.lit("NA")) for x in c))
    donors = cells.groupBy("barcode", "donor").agg(F.min("_ord").alias("_ord"))
    write_lines(donors.select("_ord", line("barcode", "donor").alias("line")), f"{folder}/{DONORS}", ["barcode\tdonor_id"])
    if "clonotype" in cells.columns and not cells.filter("clonotype is not null").isEmpty():
        pairs = cells.filter("clonotype is not null").groupBy("barcode", "clonotype").agg(F.min("_ord").alias("_ord"))
        write_lines(pairs.select("_ord", F.concat_ws(",", "barcode", "clonotype").alias("line")), f"{folder}/{CONTIGS}", ["barcode,raw_clonotype_id"])
    write_lines(cells.select("_ord", F.col("barcode").alias("line")), f"{folder}/{SAMPLES}")


def example_cube(spark: SparkSession) -> AlleleCube:
    """A small synthetic cube."""
    n, m = 12, 20
    snps = spark.createDataFrame([(f"chr{1 + i % 3}", 1000 * (i + 1), "A", "G", f"GENE{i // 2}") for i in range(n)], "chrom string, pos int, ref string, alt string, gene_name string")
    cells = spark.createDataFrame([(f"CELL{j}", f"donor{j % 2}", f"clonotype{j % 5}") for j in range(m)], "barcode string, donor string, clonotype string")
    counts = spark.createDataFrame([(i + 1, j + 1, (3 * i + 5 * j) % 7, (2 * i + j) % 4) for i in range(n) for j in range(m)], "snp_pos long, cell_pos long, ref_count long, alt_count long")
    return AlleleCube.from_frames(counts, snps, cells)
