"""VCF files and regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions.scalars import snp_key
from allelix.model import column_or_sql, numbered
from allelix.sources.files import blocked_lines_between, check_file, delimited, exists, first_lines, numbered_lines, text_lines, write_lines
from allelix.sources.tabix import ranges_of, read_index, write_index
from allelix.tables import scratch

BASE = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
REQUIRED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")


def read_vcf_base(spark: SparkSession, path: str) -> DataFrame:
    """Eight columns without a header line, # comments left out; snp_id first, `_ord` by line."""
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    parts = F.split("value", "\t", -1)
    df = lines.select("_ord", *(F.get(parts, i).alias(n) for i, n in enumerate(BASE))).withColumn("pos", F.col("pos").cast("int"))
    df = numbered(df.withColumnRenamed("_ord", "_line"), by="_line").drop("_line")
    return df.select(snp_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("snp_id"), *BASE, "_ord")


@dataclass(frozen=True)
class VcfData:
    header: list[str]
    samples: list[str]
    variants: DataFrame

    def __post_init__(self):
        missing = [c for c in REQUIRED if c not in self.variants.columns]
        if missing:
            raise ValueError(f"variants lack {', '.join(missing)}")
        if dict(self.variants.dtypes)["POS"] == "string":
            object.__setattr__(self, "variants", self.variants.withColumn("POS", F.expr("try_cast(POS as double)")))

    def shape(self) -> tuple[int, int]:
        return self.variants.count(), len(self.variants.columns)

    def filter(self, condition) -> VcfData:
        return VcfData(self.header, self.samples, self.variants.filter(column_or_sql(condition)))

    def select(self, *columns: str) -> VcfData:
        return VcfData(self.header, self.samples, self.variants.select(*columns))

    def head(self, n: int = 6) -> DataFrame:
        """The first n variants."""
        return self.variants.limit(n)

    def __repr__(self) -> str:
        return f"VcfData({len(self.header)} header lines, {len(self.samples)} samples, columns {', '.join(self.variants.columns)})"


def _head(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Header lines and column names; only the first lines are read."""
    check_file(spark, path)
    n = 64
    while True:
        head = [x for x in first_lines(spark, path, n) if x.startswith("#")]
        if len(head) < n:
            break
        n *= 8
    names = next((x for x in head if x.startswith("#CHROM")), None)
    if names is None:
        raise ValueError(f"{path} has no line of column names")
    return [x for x in head if x.startswith("##")], names[1:].split("\t")


def _variants(lines: DataFrame, names: list[str]) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(*((F.get(parts, i).cast("int") if n == "POS" else F.get(parts, i)).alias(n) for i, n in enumerate(names)))


def _samples(names: list[str]) -> list[str]:
    return names[names.index("FORMAT" if "FORMAT" in names else "INFO") + 1 :]


def read_vcf(spark: SparkSession, path: str) -> VcfData:
    """Header lines and sample names come to the driver; variants stay a frame, in the order of the file. Samples follow FORMAT, else INFO."""
    header, names = _head(spark, path)
    return VcfData(header, _samples(names), _variants(text_lines(spark, path), names))


def read_vcf_regions(spark: SparkSession, path: str, regions: list[tuple[str, int, int]]) -> VcfData:
    """The variants that overlap regions (chrom, first, last; 1-based, closed); an indexed file is read there only."""
    if not exists(spark, f"{path}.tbi"):
        data = read_vcf(spark, path)
    else:
        header, names = _head(spark, path)
        ranges = ranges_of(read_index(spark, path), regions)
        data = VcfData(header, _samples(names), _variants(blocked_lines_between(spark, path, ranges), names))
    last = F.col("POS") + F.greatest(F.length("REF"), F.lit(1)) - 1
    inside = F.lit(False)
    for chrom, a, z in regions:
        inside = inside | ((F.col("CHROM") == chrom) & (F.col("POS") <= z) & (last >= a))
    return data.filter(inside)


def write_vcf(data: VcfData, path: str, gzip: bool = False, index: bool = False) -> None:
    """In the order of the variants; gzip: in blocks. index: sorted by contig and position, in blocks, with the index beside the file."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in data.variants.columns)).alias("line")
    head = [*data.header, "#" + "\t".join(data.variants.columns)]
    spark = data.variants.sparkSession
    if not index:
        with scratch(spark):
            write_lines(numbered(data.variants).select("_ord", line), path, head, gzip)
        return
    pos = F.col("POS").cast("long")
    rows = data.variants.select(F.struct("CHROM", pos.alias("p"), "REF", "ALT").alias("_ord"), line, F.col("CHROM").alias("chrom"), pos.alias("first"), (pos + F.greatest(F.length("REF"), F.lit(1)) - 1).alias("last"))
    with scratch(spark):
        write_index(spark, path, write_lines(rows, path, head, gzip=True))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, "\t", ["chrom", "start", "end"]).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def exons_to_bed(spark: SparkSession, gff: str, bed: str) -> None:
    """Exon rows of a GFF file as 0-based half-open regions."""
    parts = F.split("value", "\t", -1)
    exons = numbered_lines(spark, gff).filter(~F.col("value").startswith("#")).filter(F.get(parts, 2) == "exon")
    write_lines(exons.select("_ord", F.concat_ws("\t", F.get(parts, 0), (F.get(parts, 3).cast("long") - 1).cast("string"), F.get(parts, 4)).alias("line")), bed)


def filter_vcf_by_bed(spark: SparkSession, vcf: str, bed: str, output: str, gzip: bool = False) -> VcfData:
    """Writes the variants in the regions. Of an indexed file only the 16 kb windows that regions touch are read."""
    from allelix.operators.annotate import in_regions

    regions = read_bed(spark, bed)
    if exists(spark, f"{vcf}.tbi"):
        header, names = _head(spark, vcf)
        data = VcfData(header, _samples(names), _variants(blocked_lines_between(spark, vcf, ranges_of(read_index(spark, vcf), _windows(regions))), names))
    else:
        data = read_vcf(spark, vcf)
    kept = VcfData(data.header, data.samples, in_regions(data.variants, regions))
    write_vcf(kept, output, gzip)
    return kept


def _windows(regions: DataFrame) -> list[tuple[str, int, int]]:
    """The 16 kb windows that regions (0-based, half-open) touch, neighbours joined: as many as the genome has at most."""
    k = F.explode(F.sequence(F.shiftright("start", 14), F.shiftright(F.greatest(F.col("end") - 1, F.col("start")), 14))).alias("k")
    out: list[list] = []
    for r in regions.select("chrom", k).distinct().orderBy("chrom", "k").toLocalIterator():
        if out and out[-1][0] == r["chrom"] and out[-1][2] == r["k"] << 14:
            out[-1][2] += 1 << 14
        else:
            out.append([r["chrom"], (r["k"] << 14) + 1, (r["k"] + 1) << 14])
    return [tuple(x) for x in out]
