"""Annotation: SNP to gene intervals, variants in regions, metadata joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.model import CELL_METRICS, SNP_METRICS, AlleleCube, numbered

BIN = 100_000


def _binned(intervals: DataFrame, start: str, end: str) -> DataFrame:
    return intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))


def add_gene_names(snps: DataFrame, genes: DataFrame) -> DataFrame:
    """snps with gene_name: the distinct genes whose closed range holds the position, in annotation order, else null.

    Genes are laid on bins of the chromosome and joined on (chrom, bin), so the join is an equi-join at any size; a SNP
    lies in one bin, so it meets a gene once.
    """
    missing = {"chrom", "start", "end", "gene_name"} - set(genes.columns)
    if missing:
        raise ValueError(f"the gene annotation lacks {', '.join(sorted(missing))}")
    snps = numbered(snps.drop("gene_name"))
    g = _binned(numbered(genes).filter("gene_name is not null").select("chrom", "start", "end", "gene_name", F.col("_ord").alias("_gene")), "start", "end")
    at = snps.select(F.col("_ord"), "chrom", "pos").withColumn("_bin", F.floor(F.col("pos") / BIN))
    hits = at.join(g, ["chrom", "_bin"]).filter("start <= pos and pos <= end")
    named = hits.groupBy("_ord").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_gene", "gene_name"))), lambda x: x["gene_name"])), ", ").alias("gene_name"))
    return snps.join(named, "_ord", "left").select(*snps.columns, "gene_name")


def in_regions(variants: DataFrame, bed: DataFrame, chrom: str = "CHROM", pos: str = "POS", ref: str = "REF") -> DataFrame:
    """Variants that overlap a region (0-based, half-open), as a semi join on (chrom, bin)."""
    b = _binned(bed.select(F.col("chrom").alias("_chrom"), (F.col("start") + 1).alias("_start"), F.col("end").alias("_end")), "_start", "_end")
    v = numbered(variants).withColumns({"_first": F.col(pos).cast("long"), "_last": F.col(pos).cast("long") + F.greatest(F.length(ref), F.lit(1)) - 1})
    ids = _binned(v.select("_ord", F.col(chrom).alias("_chrom"), "_first", "_last"), "_first", "_last").join(b, ["_chrom", "_bin"]).filter("_first <= _end and _last >= _start").select("_ord").distinct()
    return v.join(ids, "_ord", "left_semi").select(variants.columns)


def depth_at(variants: DataFrame, depth: DataFrame, chrom: str = "CHROM", pos: str = "POS") -> DataFrame:
    """Depth (chrom, pos, depth) at the variants' positions; 0 where the table has none."""
    at = variants.select(F.col(chrom).alias("chrom"), F.col(pos).cast("long").alias("pos")).distinct()
    return at.join(depth.select("chrom", F.col("pos").cast("long").alias("pos"), "depth"), ["chrom", "pos"], "left").fillna(0, ["depth"])


def merge_columns(current: DataFrame, metadata: DataFrame, key: str, overwrite: bool, protected: tuple[str, ...], name: str) -> DataFrame:
    """current with the columns of metadata, joined by key.

    Columns that both have are an error unless overwrite; then they are replaced whole, unmatched rows get null. The
    protected columns stay as they are. Keys of metadata that current lacks are ignored.
    """
    for df, what in ((current, name), (metadata, "metadata")):
        if key not in df.columns:
            raise ValueError(f"{what} has no column {key}")
    if not metadata.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"metadata has repeated values of {key}")
    metadata = metadata.drop(*(c for c in protected if c != key))
    both = [c for c in metadata.columns if c in current.columns and c != key]
    if both and not overwrite:
        raise ValueError(f"columns are in {name} already: {', '.join(both)}")
    joined = current.drop(*both).join(metadata, key, "left")
    return joined.select(*current.columns, *(c for c in metadata.columns if c not in current.columns))


def add_cell_metadata(cube: AlleleCube, metadata: DataFrame, join_by: str = "cell_id", overwrite: bool = False) -> AlleleCube:
    merged = merge_columns(cube.cell_dim, metadata, join_by, overwrite, ("cell_id", "_ord", *CELL_METRICS), "the cell table")
    return AlleleCube(cube.counts, cube.snp_dim, merged, cube.chr_style)


def add_snp_metadata(cube: AlleleCube, metadata: DataFrame, join_by: str = "snp_id", overwrite: bool = False) -> AlleleCube:
    merged = merge_columns(cube.snp_dim, metadata, join_by, overwrite, ("snp_id", "_ord", *SNP_METRICS), "the SNP table")
    return AlleleCube(cube.counts, merged, cube.cell_dim, cube.chr_style)


add_barcode_metadata = add_cell_metadata
