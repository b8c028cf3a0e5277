"""Registered queries of files that many tasks read and write: matrices of every kind, alignments, indexed variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.more_queries import _BED, _VCF, _vcf
from allelix.operators import depth as D
from allelix.queries import _query, _t
from allelix.sources import bam, files, mtx, vcf
from allelix.tables import new_path

# ---------------------------------------------------------------- matrices


def _square(spark, d, value):
    """Entries by part and supplier, folded below the diagonal."""
    r, c = F.greatest("l_partkey", "l_suppkey").cast("long"), F.least("l_partkey", "l_suppkey").cast("long")
    li = _t(spark, d, "lineitem").groupBy(r.alias("row"), c.alias("col")).agg(value.alias("value"))
    size = li.agg(F.max("row")).first()[0]
    return li, (size, size)


def _read_back(spark, entries, shape, **how):
    path = f"{new_path(spark, 'matrix')}.mtx"
    mtx.write_mtx(entries, shape, path, **how)
    return mtx.read_mtx(spark, path)[0]


_FOLDED = "select greatest(l_partkey, l_suppkey) as r, least(l_partkey, l_suppkey) as c, {} as v from lineitem group by 1, 2"


@_query("matrix_real", "select l_partkey as row, l_suppkey as col, sum(cast(l_quantity as double) * 0.25) as value from lineitem group by 1, 2")
def _(spark, d):
    li = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col")).agg(F.sum(F.col("l_quantity").cast("double") * 0.25).alias("value"))
    return _read_back(spark, li, tuple(li.agg(F.max("row"), F.max("col")).first()))


@_query("matrix_pattern", "select distinct l_partkey as row, l_suppkey as col, cast(1 as bigint) as value from lineitem")
def _(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col"), F.lit(1).alias("value")).distinct()
    return _read_back(spark, li, tuple(li.agg(F.max("row"), F.max("col")).first()), pattern=True)


@_query("matrix_symmetric", f"with m as ({_FOLDED.format('sum(cast(l_quantity as double) * 0.5)')})\nselect r as row, c as col, v as value from m union all select c, r, v from m where r <> c")
def _(spark, d):
    return _read_back(spark, *_square(spark, d, F.sum(F.col("l_quantity").cast("double") * 0.5)), symmetry="symmetric")


@_query("matrix_symmetric_pattern", f"with m as ({_FOLDED.format('1::bigint')})\nselect r as row, c as col, v as value from m union all select c, r, v from m where r <> c")
def _(spark, d):
    return _read_back(spark, *_square(spark, d, F.lit(1)), symmetry="symmetric", pattern=True)


@_query("matrix_skew_symmetric", f"with m as ({_FOLDED.format('sum(l_linenumber)::bigint')})\nselect r as row, c as col, v as value from m where r <> c union all select c, r, -v from m where r <> c")
def _(spark, d):
    entries, shape = _square(spark, d, F.sum("l_linenumber"))
    return _read_back(spark, entries.filter("row <> col"), shape, symmetry="skew-symmetric")


@_query("matrix_array", "select row_number() over (partition by l_linenumber order by l_orderkey) as row, cast(l_linenumber as bigint) as col, cast(l_quantity as bigint) as value from lineitem join (select l_orderkey from lineitem group by 1 having count(*) = 7 and count(distinct l_linenumber) = 7) using (l_orderkey)")
def _(spark, d):
    """A full array: the quantities of all orders of seven lines."""
    li = _t(spark, d, "lineitem")
    full = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("m")).filter("n = 7 and m = 7").select("l_orderkey")
    path, rows = f"{new_path(spark, 'array')}.mtx", full.count()
    lines = li.join(full, "l_orderkey").select(F.struct("l_linenumber", "l_orderkey").alias("_ord"), F.col("l_quantity").cast("long").cast("string").alias("line"))
    files.write_lines(lines, path, ["%%MatrixMarket matrix array integer general", "% quantities", f"{rows} 7"])
    return mtx.read_mtx(spark, path)[0]


# ---------------------------------------------------------------- alignments

_CIGARS = ("30M", "10M5D10M", "5S20M3I4M", "10M100N10M")


def _bam(spark, d) -> bam.Bam:
    """Lines of orders as alignments at their part's place, written and read back."""
    li, kind = _t(spark, d, "lineitem"), F.col("l_linenumber") % 4
    text = F.element_at(F.array(*map(F.lit, _CIGARS)), (kind + 1).cast("int"))
    rows = li.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("name"), F.when(F.col("l_tax") >= 0.08, 1024).when(F.col("l_tax") >= 0.07, 16).otherwise(0).alias("flag"), (F.col("l_partkey") % 7).cast("string").alias("chrom"), F.col("l_partkey").cast("int").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"), bam.packed_cigar(text).alias("cigar"))
    path, size = f"{new_path(spark, 'alignments')}.bam", rows.agg(F.max("pos")).first()[0]
    bam.write_bam(rows, [(str(k), size + 200) for k in range(7)], path)
    return bam.read_bam(spark, path, split=1 << 20)


_READS = """reads as (select l_orderkey || '.' || l_linenumber as name, case when l_tax >= 0.08 then 1024 when l_tax >= 0.07 then 16 else 0 end as flag, cast(l_partkey % 7 as varchar) as chrom, l_partkey as pos, cast(l_quantity as integer) as mapq, l_linenumber % 4 as kind from lineitem),
runs as (select chrom, cast(pos + o.a as bigint) as a, cast(o.n as bigint) as n from reads, (values (0, 0, 30), (1, 0, 10), (1, 15, 10), (2, 0, 20), (2, 20, 4), (3, 0, 10), (3, 110, 10)) as o(kind, a, n) where o.kind = reads.kind and flag <> 1024)"""


@_query("bam_alignments", f"with {_READS}\nselect name, flag, chrom, cast(pos as integer) as pos, mapq, list_extract([{', '.join(repr(c) for c in _CIGARS)}], kind + 1) as cigar from reads")
def _(spark, d):
    return _bam(spark, d).alignments.select("name", "flag", "chrom", "pos", "mapq", bam.cigar_text(F.col("cigar")).alias("cigar"))


@_query("bam_depth_runs", f"""with {_READS},
changes as (select chrom, pos, sum(change) as change from (select chrom, a as pos, 1 as change from runs union all select chrom, a + n, -1 from runs) group by 1, 2),
swept as (select chrom, pos, sum(change) over w as depth, lead(pos) over w - 1 as last from changes where change <> 0 window w as (partition by chrom order by pos))
select chrom, pos as first, last, cast(depth as bigint) as depth from swept where depth > 0""")
def _(spark, d):
    return D.depth_runs(_bam(spark, d).alignments)


@_query("bam_depth_at_variants", f"with {_READS}\nselect cast(p_partkey % 22 + 1 as varchar) as chrom, cast(p_partkey * 10 as bigint) as pos, (select count(*) from runs where runs.chrom = cast(p_partkey % 22 + 1 as varchar) and p_partkey * 10 between a and a + n - 1) as depth from part")
def _(spark, d):
    """The depth table that is written for a variant file, read back."""
    variants, out = f"{new_path(spark, 'variants')}.vcf.gz", f"{new_path(spark, 'depth')}.tsv"
    vcf.write_vcf(_vcf(spark, d), variants, gzip=True)
    reads = _bam(spark, d)
    path = f"{new_path(spark, 'alignments')}.bam"
    bam.write_bam(reads.alignments, reads.contigs, path, reads.text)
    D.bam_depth_at_positions(spark, path, variants, out, every=True)
    back = files.delimited(spark, out, "\t", ["chrom", "pos", "depth"])
    return back.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("depth").cast("long").alias("depth"))


# ---------------------------------------------------------------- indexed variants


def _indexed(spark, d) -> str:
    path = f"{new_path(spark, 'indexed')}.vcf.gz"
    vcf.write_vcf(_vcf(spark, d), path, index=True)
    return path


@_query("vcf_by_region", f"with {_VCF}\nselect CHROM, POS, REF, INFO from v where CHROM = '7' and POS <= 9000 and POS + length(REF) - 1 >= 503 or CHROM = '12' or CHROM = '3' and POS >= 1000")
def _(spark, d):
    return vcf.read_vcf_regions(spark, _indexed(spark, d), [("7", 503, 9000), ("12", 1, 1 << 29), ("3", 1000, 1 << 29)]).variants.select("CHROM", "POS", "REF", "INFO")


@_query("vcf_by_bed_indexed", f"with {_VCF},\n{_BED}\nselect CHROM, POS, REF, INFO from v where exists (select 1 from b where b.chrom = v.CHROM and POS <= z and POS + length(REF) - 1 > a)")
def _(spark, d):
    folder, k = new_path(spark, "regions"), F.col("s_suppkey")
    bed = _t(spark, d, "supplier").select(k.cast("long").alias("_ord"), F.concat_ws("\t", (k % 22 + 1).cast("string"), (k * 40).cast("string"), (k * 40 + 300).cast("string")).alias("line"))
    files.write_lines(bed, f"{folder}/regions.bed")
    vcf.filter_vcf_by_bed(spark, _indexed(spark, d), f"{folder}/regions.bed", f"{folder}/out.vcf.gz", gzip=True)
    return vcf.read_vcf(spark, f"{folder}/out.vcf.gz").variants.select("CHROM", "POS", "REF", "INFO")
