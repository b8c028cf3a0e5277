"""Depth of alignments, by sweeping along each contig: a run of covered positions adds one where it starts and takes one off behind its end.

Changes at one position are added up first; sums along the contig go bin by bin, each bin beginning with what the bins
before it add up to, so a deep or long contig is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.sources.bam import read_bam
from allelix.sources.files import write_lines
from allelix.sources.vcf import read_vcf

BIN = 100_000
UNUSED = 0x4 | 0x100 | 0x200 | 0x400  # unmapped, secondary, failed checks, duplicate


def covered(alignments: DataFrame, unused: int = UNUSED, least_mapq: int = 0) -> DataFrame:
    """(chrom, pos, change) of the alignments that count."""
    used = alignments.filter((F.col("flag").bitwiseAND(unused) == 0) & (F.col("mapq") >= least_mapq) & F.col("chrom").isNotNull())
    runs = used.select("chrom", F.explode(F.arrays_zip("starts", "lengths")).alias("r")).select("chrom", F.col("r.starts").cast("long").alias("a"), F.col("r.lengths").cast("long").alias("n"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).cast("long").alias("change")), F.struct((F.col("a") + F.col("n")).alias("pos"), F.lit(-1).cast("long").alias("change")))).alias("e")
    return runs.select("chrom", ends).select("chrom", "e.pos", "e.change").groupBy("chrom", "pos").agg(F.sum("change").alias("change"))


def _swept(changes: DataFrame) -> DataFrame:
    """changes (chrom, pos, change, ...; one row for each position) with the depth from that position on, and the next position."""
    rows = changes.withColumn("bin", F.floor(F.col("pos") / BIN))
    bins = rows.groupBy("chrom", "bin").agg(F.sum("change").alias("in"), F.min("pos").alias("begins"))
    along = Window.partitionBy("chrom").orderBy("bin")  # a row for each bin
    bins = bins.select("chrom", "bin", F.coalesce(F.sum("in").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("begins").over(along).alias("following"))
    here = Window.partitionBy("chrom", "bin").orderBy("pos")
    return rows.join(bins, ["chrom", "bin"]).withColumns({"depth": F.col("before") + F.sum("change").over(here), "next": F.coalesce(F.lead("pos").over(here), "following")}).drop("bin", "before", "following")


def depth_runs(alignments: DataFrame, **how) -> DataFrame:
    """(chrom, first, last, depth) of all stretches of one depth, 1-based and closed, zero left out."""
    return _swept(covered(alignments, **how).filter("change != 0")).filter("depth > 0").select("chrom", F.col("pos").alias("first"), (F.col("next") - 1).alias("last"), "depth")


def depth_at_positions(variants: DataFrame, alignments: DataFrame, chrom: str = "CHROM", pos: str = "POS", **how) -> DataFrame:
    """(chrom, pos, depth) of the distinct positions of variants; 0 where nothing covers them."""
    asked = variants.select(F.col(chrom).alias("chrom"), F.col(pos).cast("long").alias("pos")).distinct()
    both = covered(alignments, **how).withColumn("asked", F.lit(0)).unionByName(asked.withColumns({"change": F.lit(0).cast("long"), "asked": F.lit(1)}))
    return _swept(both.groupBy("chrom", "pos").agg(F.sum("change").alias("change"), F.max("asked").alias("asked"))).filter("asked = 1").select("chrom", "pos", "depth")


def bam_depth_at_positions(spark: SparkSession, bam: str, vcf: str, output: str, every: bool = False, **how) -> DataFrame:
    """Writes contig, position and depth of the variants' positions as a table, by contig as the alignments have them; those that nothing covers only if every."""
    data = read_bam(spark, bam)
    depth = depth_at_positions(read_vcf(spark, vcf).variants, data.alignments, **how)
    depth = depth if every else depth.filter("depth > 0")
    number = spark.createDataFrame([(name, k) for k, (name, _) in enumerate(data.contigs)], "chrom string, contig int")
    placed = depth.join(F.broadcast(number), "chrom", "left")  # as many rows as the header has contigs
    write_lines(placed.select(F.struct(F.coalesce("contig", F.lit(len(data.contigs))), "chrom", "pos").alias("_ord"), F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("depth").cast("string")).alias("line")), output)
    return depth
