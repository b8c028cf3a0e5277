"""Further registered queries: files written and read back, tables of the model, merging by barcode, tracks, X-inactivation parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from allelix.functions.chroms import STYLES, TABLE, convert_chr_style, detect_chr_style, normalize_chr_names
from allelix.functions.scalars import in_list, without_suffix
from allelix.model import AlleleCube, assign_cell_ids, assign_snp_ids, numbered
from allelix.operators import aggregate as A
from allelix.operators import annotate as N
from allelix.operators import filters as R
from allelix.operators import xci as X
from allelix.operators.merge import merge_cubes
from allelix.plans import density as K
from allelix.plans import frames as V
from allelix.queries import _BASE, _ODD, _SNP_METRICS, _case, _grouped, _on_x, _pair, _query, _t, _tested, _two_sql, _with_odd_donors, cube_of
from allelix.sources import cellsnp, files, mtx, vcf
from allelix.tables import new_path, written

# ---------------------------------------------------------------- files

_ALLELES = "case when pos % 2 = 0 then 'A' else 'C' end as ref, case when pos % 3 = 0 then 'G' else 'T' end as alt"


def _cube_with_alleles(spark, d) -> AlleleCube:
    cube = cube_of(spark, d)
    two = {"ref": F.when(F.col("pos") % 2 == 0, "A").otherwise("C"), "alt": F.when(F.col("pos") % 3 == 0, "G").otherwise("T")}
    clonotype = F.when(~F.col("clonotype").endswith("MACHINERY"), F.col("clonotype"))
    return AlleleCube(cube.counts, cube.snp_dim.withColumns(two), cube.cell_dim.withColumn("clonotype", clonotype), cube.chr_style)


def _genes(spark, d):
    """An annotation in which genes overlap."""
    at = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(F.concat(F.lit("chr"), at % 22 + 1).alias("chrom"), (at * 4).alias("start"), (at * 4 + 90).alias("end"), F.col("s_name").alias("gene_name"), at.cast("long").alias("_ord"))


def _imported(spark, d) -> AlleleCube:
    """The cube, exported as a bundle and imported from it."""
    folder = new_path(spark, "bundle")
    cellsnp.export_bundle(_cube_with_alleles(spark, d), folder)
    return cellsnp.import_bundle(spark, folder, _genes(spark, d), f"{folder}/{cellsnp.CONTIGS}", f"{folder}/{cellsnp.DONORS}")


_KEYED = f"{_BASE},\nk as (select snp_id, chrom || ':' || pos || ':' || ref || ':' || alt as made, chrom, pos from (select *, {_ALLELES} from snps))"


@_query("bundle_counts", f"{_KEYED}\nselect made as snp_id, barcode, ref_count, alt_count, oth_count from counts join k using (snp_id) join cells using (cell_id)")
def _(spark, d):
    cube = _imported(spark, d)
    return cube.counts.join(cube.cell_dim.select("cell_id", "barcode"), "cell_id").select("snp_id", "barcode", "ref_count", "alt_count", "oth_count")


@_query("bundle_cells", f"{_BASE}\nselect 'cell_' || row_number() over (order by ord) as cell_id, barcode, donor, case when clonotype not like '%MACHINERY' then clonotype end as clonotype from cells")
def _(spark, d):
    return _imported(spark, d).cells.select("cell_id", "barcode", "donor", "clonotype")


@_query("bundle_snps", f"""{_KEYED},
g as (select 'chr' || (s_suppkey % 22 + 1) as chrom, s_suppkey * 4 as a, s_suppkey * 4 + 90 as z, s_name as gene, s_suppkey as o from supplier),
m as ({_SNP_METRICS} from snps left join counts using (snp_id) group by 1)
select made as snp_id, k.chrom, cast(k.pos as integer) as pos, string_agg(gene, ', ' order by o) as gene_name, any_value(coverage) as coverage from k join m using (snp_id) left join g on g.chrom = k.chrom and k.pos between a and z group by 1, 2, 3""")
def _(spark, d):
    return _imported(spark, d).snps.select("snp_id", "chrom", "pos", "gene_name", "coverage")


@_query("matrix_round_trip", "select l_partkey as row, l_suppkey as col, cast(sum(l_linenumber) as bigint) as value from lineitem group by all")
def _(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_linenumber").alias("value"))
    path = new_path(spark, "matrix")
    shape = tuple(li.agg(F.max("l_partkey"), F.max("l_suppkey")).first())
    mtx.write_mtx(li.select(F.col("l_partkey").cast("long").alias("row"), F.col("l_suppkey").cast("long").alias("col"), "value"), shape, path)
    return mtx.read_mtx(spark, path)[0]


def _vcf(spark, d) -> vcf.VcfData:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    rows = _t(spark, d, "part").orderBy("p_partkey").select(text(k % 22 + 1).alias("CHROM"), (k * 10).cast("int").alias("POS"), F.lit(".").alias("ID"), F.when(k % 4 == 0, "ACGT").otherwise("A").alias("REF"), F.lit("G").alias("ALT"), text(F.col("p_size")).alias("QUAL"), F.when(k % 5 == 0, "PASS").otherwise("q10").alias("FILTER"), F.concat(F.lit("BRAND="), F.col("p_brand")).alias("INFO"), F.lit("GT").alias("FORMAT"), F.when(k % 2 == 0, "0/1").otherwise("1/1").alias("S1"))
    return vcf.VcfData(["##fileformat=VCFv4.2", "##source=parts"], ["S1"], rows)


_VCF = "v as (select cast(p_partkey % 22 + 1 as varchar) as CHROM, cast(p_partkey * 10 as integer) as POS, '.' as ID, case when p_partkey % 4 = 0 then 'ACGT' else 'A' end as REF, 'G' as ALT, cast(p_size as varchar) as QUAL, case when p_partkey % 5 = 0 then 'PASS' else 'q10' end as FILTER, 'BRAND=' || p_brand as INFO, 'GT' as FORMAT, case when p_partkey % 2 = 0 then '0/1' else '1/1' end as S1 from part)"


@_query("vcf_round_trip", f"with {_VCF}\nselect * from v")
def _(spark, d):
    path = f"{new_path(spark, 'variants')}.vcf.gz"
    vcf.write_vcf(_vcf(spark, d), path, gzip=True)
    return vcf.read_vcf(spark, path).variants


@_query("vcf_header_and_samples", "select * from (values ('header', '##fileformat=VCFv4.2'), ('header', '##source=parts'), ('sample', 'S1')) as t(kind, line)")
def _(spark, d):
    path = f"{new_path(spark, 'variants')}.vcf"
    vcf.write_vcf(_vcf(spark, d), path)
    read = vcf.read_vcf(spark, path)
    return spark.createDataFrame([*(("header", h) for h in read.header), *(("sample", s) for s in read.samples)], "kind string, line string")


@_query("vcf_base_ids", "with " + _VCF + "\nselect CHROM || ':' || POS || ':' || REF || ':' || ALT as snp_id, POS as pos, QUAL as qual, cast(row_number() over (order by POS) as bigint) as line from v")
def _(spark, d):
    path = f"{new_path(spark, 'base')}.vcf"
    vcf.write_vcf(_vcf(spark, d), path)
    return vcf.read_vcf_base(spark, path).select("snp_id", "pos", "qual", F.col("_ord").alias("line"))


_BED = "b as (select cast(s_suppkey % 22 + 1 as varchar) as chrom, s_suppkey * 40 as a, s_suppkey * 40 + 300 as z from supplier)"


@_query("vcf_by_bed", f"with {_VCF},\n{_BED}\nselect CHROM, POS, REF, INFO from v where exists (select 1 from b where b.chrom = v.CHROM and POS <= z and POS + length(REF) - 1 > a)")
def _(spark, d):
    folder = new_path(spark, "regions")
    vcf.write_vcf(_vcf(spark, d), f"{folder}/in.vcf")
    k = F.col("s_suppkey")
    bed = _t(spark, d, "supplier").select(k.cast("long").alias("_ord"), F.concat_ws("\t", (k % 22 + 1).cast("string"), (k * 40).cast("string"), (k * 40 + 300).cast("string")).alias("line"))
    files.write_lines(bed, f"{folder}/regions.bed")
    vcf.filter_vcf_by_bed(spark, f"{folder}/in.vcf", f"{folder}/regions.bed", f"{folder}/out.vcf")
    return vcf.read_vcf(spark, f"{folder}/out.vcf").variants.select("CHROM", "POS", "REF", "INFO")


@_query("exon_regions", "select 'chr' || (s_suppkey % 22 + 1) as chrom, cast(s_suppkey * 50 - 1 as bigint) as start, cast(s_suppkey * 50 + 20 as bigint) as \"end\" from supplier where s_suppkey % 3 <> 0")
def _(spark, d):
    folder, k = new_path(spark, "exons"), F.col("s_suppkey")
    gff = _t(spark, d, "supplier").select(k.cast("long").alias("_ord"), F.concat_ws("\t", F.concat(F.lit("chr"), (k % 22 + 1).cast("string")), F.lit("x"), F.when(k % 3 == 0, "gene").otherwise("exon"), (k * 50).cast("string"), (k * 50 + 20).cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.lit("ID=1")).alias("line"))
    files.write_lines(gff, f"{folder}/a.gff", ["##gff-version 3"])
    vcf.exons_to_bed(spark, f"{folder}/a.gff", f"{folder}/a.bed")
    return vcf.read_bed(spark, f"{folder}/a.bed")


@_query("depth_at_variants", "select cast(p_partkey % 7 as varchar) as chrom, cast(p_partkey as bigint) as pos, cast(coalesce(n, 0) as bigint) as depth from part left join (select l_partkey, count(*) as n from lineitem group by 1) on l_partkey = p_partkey")
def _(spark, d):
    name = lambda k: (F.col(k) % 7).cast("string")
    depth = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("depth")).select(name("l_partkey").alias("chrom"), F.col("l_partkey").alias("pos"), "depth")
    return N.depth_at(_t(spark, d, "part").select(name("p_partkey").alias("CHROM"), F.col("p_partkey").alias("POS")), depth)


# ---------------------------------------------------------------- tables of the model


@_query("cell_annotations", """with c as (select 'BC' || c_custkey as barcode, n_name as donor, c_custkey, c_mktsegment from customer join nation on c_nationkey = n_nationkey)
select 'cell_' || c_custkey as cell_id, barcode, donor, case when c_custkey % 4 <> 0 then c_mktsegment end as clonotype from c""")
def _(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    donors = c.select(F.concat(F.lit("BC"), "c_custkey").alias("cell"), F.col("n_name").alias("donor_id"), F.col("c_custkey").cast("long").alias("_ord"))
    contigs = c.filter("c_custkey % 4 != 0").select(F.concat(F.lit("BC"), "c_custkey", F.lit("-1")).alias("barcode"), F.col("c_mktsegment").alias("raw_clonotype_id"), F.lit(1).alias("other"))
    contigs = contigs.unionAll(contigs).withColumn("barcode", without_suffix(F.col("barcode")))
    return cellsnp.merge_cell_annotations(donors, contigs).select("cell_id", "barcode", "donor", "clonotype")


@_query("coverage_entries", f"{_BASE}\nselect snp_id, cell_id, ref_count + alt_count as coverage from counts where ref_count + alt_count <> 0")
def _(spark, d):
    return cube_of(spark, d).coverage()


@_query("other_counts", f"{_BASE}\nselect snp_id, cell_id, oth_count from counts where oth_count <> 0")
def _(spark, d):
    return cube_of(spark, d).count_of("oth_count")


@_query("made_up_ids", "select 'snp_' || row_number() over (order by p_partkey) as snp_id, 'cell_' || row_number() over (order by p_partkey) as cell_id, p_name from part")
def _(spark, d):
    rows = numbered(_t(spark, d, "part").select("p_partkey", "p_name"), by="p_partkey")
    return assign_cell_ids(assign_snp_ids(rows)).select("snp_id", "cell_id", "p_name")


@_query("subset_by_position", f"{_BASE},\ns as (select snp_id from (select *, row_number() over (order by pos) as rk from snps) where rk between 11 and 60), c as (select cell_id from (select *, row_number() over (order by ord) as rk from cells) where rk % 2 = 0)\nselect snp_id, cell_id, ref_count, alt_count from counts where snp_id in (from s) and cell_id in (from c)")
def _(spark, d):
    cube = cube_of(spark, d)
    return cube.subset(range(11, 61), [i % 2 == 0 for i in range(1, cube.shape()[1] + 1)]).counts.select("snp_id", "cell_id", "ref_count", "alt_count")


@_query("given_snp_table", f"{_BASE}\nselect snp_id, gene_name || '!' as gene_name, cast(7 as integer) as coverage from snps")
def _(spark, d):
    cube = cube_of(spark, d)
    given = cube.snp_dim.select("snp_id", F.concat("gene_name", F.lit("!")).alias("gene_name"), F.lit(7).alias("coverage"))
    return cube.with_snps(given).snps.select("snp_id", "gene_name", "coverage")


@_query("given_cell_table", f"{_BASE}\nselect cell_id, lower(donor) as donor, cast(ord as bigint) as library_size from cells")
def _(spark, d):
    cube = cube_of(spark, d)
    given = cube.cell_dim.select("cell_id", F.lower("donor").alias("donor"), F.col("_ord").alias("library_size"))
    return cube.with_cells(given).cells.select("cell_id", "donor", "library_size")


@_query("snp_metadata", f"{_BASE}\nselect snp_id, gene_name, chrom, case when pos % 2 = 0 then pos * 2 end as score from snps")
def _(spark, d):
    cube = cube_of(spark, d)
    new = cube.snp_dim.filter("pos % 2 = 0").select("snp_id", (F.col("pos") * 2).alias("score"))
    return N.add_snp_metadata(cube, new).snp_dim.select("snp_id", "gene_name", "chrom", "score")


@_query("cell_metadata_by_barcode", f"{_BASE}\nselect cell_id, donor, case when ord % 3 = 0 then 'batch' || ord % 5 end as batch from cells")
def _(spark, d):
    cube = cube_of(spark, d)
    new = cube.cell_dim.filter("_ord % 3 = 0").select("barcode", F.concat(F.lit("batch"), F.col("_ord") % 5).alias("batch"))
    return N.add_cell_metadata(cube, new, join_by="barcode").cell_dim.select("cell_id", "donor", "batch")


@_query("remove_na_genes", f"{_BASE}\nselect snp_id, gene_name, cast(coalesce(sum(ref_count + alt_count), 0) as bigint) as coverage from snps left join counts using (snp_id) where gene_name not like '%3' group by 1, 2")
def _(spark, d):
    cube = cube_of(spark, d)
    gene = F.when(~F.col("gene_name").endswith("3"), F.col("gene_name"))
    return R.remove_na_genes(AlleleCube(cube.counts, cube.snp_dim.withColumn("gene_name", gene), cube.cell_dim)).snps.select("snp_id", "gene_name", "coverage")


@_query("expression_wide", f"{_ODD},\n{_grouped('region')},\ne as (select snp_id, region, (ref_count - alt_count) / (ref_count + alt_count + 1) * ln(1 + ref_count + alt_count) as expr from g)\nselect snp_id, " + ", ".join(f"round(coalesce(sum(expr) filter (region = '{r}'), 0), 9) as \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " from snps left join e using (snp_id) group by 1")
def _(spark, d):
    cube = _with_odd_donors(cube_of(spark, d))
    wide = A.expression_matrix(AlleleCube(cube.counts, cube.snp_dim, cube.cell_dim.withColumn("donor", F.col("region"))))
    return wide.select("snp_id", *(F.round(c, 9).alias(c) for c in wide.columns if c != "snp_id"))


# ---------------------------------------------------------------- merging


@_query("merge_by_barcode", _two_sql("select snp_id, 'BC' || cell_id as barcode, cast(sum(ref_count) as bigint) as ref_count, cast(sum(alt_count) as bigint) as alt_count, cast(sum(oth_count) as bigint) as oth_count from u group by 1, 2 having sum(ref_count + alt_count + oth_count) > 0"))
def _(spark, d):
    cube = merge_cubes(*_pair(spark, d, barcodes=True), strict=False)
    return cube.counts.join(cube.cell_dim.select("cell_id", "barcode"), "cell_id").select("snp_id", "barcode", "ref_count", "alt_count", "oth_count")


@_query("merge_by_barcode_cells", _two_sql("select 'cell_' || row_number() over (order by x is null, coalesce(x, y)) as cell_id, 'BC' || cell_id as barcode, cast(case when x is not null then 'x' else 'y' end as varchar) as side from (select cell_id, x.ord as x, y.ord as y from lx x full join ly y using (cell_id))"))
def _(spark, d):
    x, y = _pair(spark, d, barcodes=True)
    side = lambda c, s: AlleleCube(c.counts, c.snp_dim, c.cell_dim.withColumn("side", F.lit(s)), c.chr_style)
    return merge_cubes(side(x, "x"), side(y, "y"), strict=False).cell_dim.select("cell_id", "barcode", "side")


@_query("merge_snp_table", _two_sql("select snp_id, coalesce(x.gene_name, y.gene_name) as gene_name, cast(coalesce(x.own, y.own) as varchar) as own, xs, ys from (select *, 'x' as own, 1 as xs from sx) x full join (select *, 'y' as own, 2 as ys from sy) y using (snp_id)"))
def _(spark, d):
    x, y = _pair(spark, d)
    both = [AlleleCube(c.counts, c.snp_dim.withColumns({"own": F.lit(s), f"{s}s": F.lit(n)}), c.cell_dim, c.chr_style) for c, s, n in ((x, "x", 1), (y, "y", 2))]
    return merge_cubes(*both, strict=False).snp_dim.select("snp_id", "gene_name", "own", "xs", "ys")


# ---------------------------------------------------------------- names of chromosomes


@_query("chrom_styles", "select * from (values " + ", ".join(f"('{s}', '{s}')" for s in STYLES) + ", ('other', 'unknown')) as t(given, found)")
def _(spark, d):
    part, found = _t(spark, d, "part"), []
    for style in STYLES:
        names = list(TABLE[style].values())
        column = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
        found.append((style, detect_chr_style(part.select(column.alias("chrom")))))
    found.append(("other", detect_chr_style(part.select(F.col("p_brand").alias("chrom")))))
    return spark.createDataFrame(found, "given string, found string")


_MOUSE = list(TABLE["genbank_mouse"])


@_query("chrom_normalize_mouse", f"with r as (select p_partkey, list_extract([{', '.join(repr(TABLE['genbank_mouse'][c]) for c in _MOUSE)}], p_partkey % {len(_MOUSE)} + 1) as chrom from part)\nselect p_partkey, chrom, {_case({TABLE['genbank_mouse'][c]: TABLE['ucsc'][c] for c in _MOUSE})} as canonical, {_case({TABLE['genbank_mouse'][c]: TABLE['refseq_mouse'][c] for c in _MOUSE})} as refseq from r")
def _(spark, d):
    name = F.element_at(F.array(*(F.lit(TABLE["genbank_mouse"][c]) for c in _MOUSE)), (F.col("p_partkey") % len(_MOUSE) + 1).cast("int"))
    raw = _t(spark, d, "part").select("p_partkey", name.alias("chrom"))
    return raw.select("p_partkey", "chrom", normalize_chr_names(F.col("chrom"), "genbank_mouse").alias("canonical"), convert_chr_style(F.col("chrom"), "genbank_mouse", "refseq_mouse").alias("refseq"))


@_query("names_in_lists", "select s_suppkey, list_contains(string_split(s_name || ',' || s_suppkey % 3 || ',b', ','), '2') as found, regexp_replace('BC' || s_suppkey || '-' || s_suppkey % 12, '-[0-9]+$', '') as barcode from supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select("s_suppkey", in_list(F.concat_ws(",", "s_name", k % 3, F.lit("b")), "2").alias("found"), without_suffix(F.concat(F.lit("BC"), k, F.lit("-"), k % 12)).alias("barcode"))


# ---------------------------------------------------------------- tracks

_BINS = "select cast(least(floor((v - a) / w), 49) as integer) as bin, count(*) as n, round(a + least(floor((v - a) / w), 49) * w, 6) as low, round(a + (least(floor((v - a) / w), 49) + 1) * w, 6) as high, round(count(*) / total / w, 9) as density from (select v, a, greatest((z - a) / 50, 1e-12) as w, total from x, (select min(v) as a, max(v) as z, count(*) as total from x)) group by a, w, total, 1, 3, 4"


def _binned(df):
    return df.select("bin", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("density", 9).alias("density"))


@_query("snp_coverage_histogram", f"{_BASE},\nc as ({_SNP_METRICS} from snps left join counts using (snp_id) group by 1),\nx as (select log10(coverage) as v from c where coverage > 0)\n{_BINS}")
def _(spark, d):
    return _binned(V.snp_coverage_frame(cube_of(spark, d)))


@_query("maf_histogram", f"{_BASE},\n{_grouped('donor')},\nx as (select least(ref_count, alt_count) / (ref_count + alt_count) as v from g)\n{_BINS}")
def _(spark, d):
    return _binned(V.maf_frame(A.donor_counts(cube_of(spark, d), maf_test=False)))


_DENSITY = """,
s as (select count(*) as n, min(v) as a, max(v) as z, stddev_samp(v) as sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 as iqr from x),
b as (select *, 0.9 * case when least(sd, iqr) > 0 then least(sd, iqr) else sd end * pow(n, -0.2) as h, (z - a) / 511 as step from s)
select cast(i as integer) as point, round(any_value(a + i * step), 6) as x, round(sum(exp(-0.5 * pow((a + i * step - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) as density from b, range(512) t(i), x group by i"""


def _smooth(df):
    return df.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@_query("library_size_density", f"{_BASE},\nc as (select cell_id, coalesce(sum(ref_count + alt_count), 0) as size from cells left join counts using (cell_id) group by 1),\nx as (select cast(size as double) as v from c){_DENSITY}")
def _(spark, d):
    return _smooth(K.library_size_density(cube_of(spark, d)))


@_query("snp_coverage_density", f"{_BASE},\nc as ({_SNP_METRICS} from snps left join counts using (snp_id) group by 1),\nx as (select log10(coverage) as v from c where coverage > 0){_DENSITY}")
def _(spark, d):
    return _smooth(K.snp_coverage_density(cube_of(spark, d)))


@_query("maf_density", f"{_BASE},\n{_grouped('donor')},\nx as (select least(ref_count, alt_count) / (ref_count + alt_count) as v from g){_DENSITY}")
def _(spark, d):
    return _smooth(K.maf_density(A.donor_counts(cube_of(spark, d), maf_test=False)))


@_query("gene_track", "select 'chr' || (s_suppkey % 22 + 1) as chrom, cast(s_suppkey * 4 as bigint) as start, cast(s_suppkey * 4 + 90 as bigint) as \"end\", s_name as gene_name from supplier where s_suppkey * 4 + 90 >= 150 and s_suppkey * 4 <= 300")
def _(spark, d):
    return V.gene_track(_genes(spark, d), 150, 300).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


@_query("maf_track", f"{_BASE},\n{_grouped('donor')}\nselect snps.pos, least(ref_count, alt_count) / (ref_count + alt_count) as maf, donor as facet from g join snps using (snp_id) where pos between 10 and 5000")
def _(spark, d):
    return V.maf_track(A.donor_counts(cube_of(spark, d), maf_test=False), "donor", 10, 5000)


@_query("p_value_track", f"{_BASE},\n{_grouped('region')},{_tested('g')}\nselect snps.pos, round(case when adj_p_val > 0 then abs(log10(adj_p_val)) end, 4) as neg_log10_p, region as facet from t join snps using (snp_id)")
def _(spark, d):
    out = V.p_value_track(A.group_counts(cube_of(spark, d), "region"), "region")
    return out.select("pos", F.round("neg_log10_p", 4).alias("neg_log10_p"), "facet")


# ---------------------------------------------------------------- X-inactivation


@_query("xci_informative_snps", f"{_BASE.replace('n_name as donor', 'r_name as donor')},\n{_grouped('donor')},\ng2 as (select *, ref_count + alt_count >= 10 as tested from g),{_tested('g2', keep='tested', family='donor')},\nh as (select donor, snp_id, gene_name, cast(ref_count + alt_count as bigint) as coverage, row_number() over (partition by donor, gene_name order by ref_count + alt_count desc, pos) as rk from t join snps using (snp_id) where tested and adj_p_val < 0.05)\nselect donor, snp_id, gene_name, coverage from h where rk = 1")
def _(spark, d):
    return X.informative_snps(_on_x(spark, d)).select("donor", "snp_id", "gene_name", "coverage")


_INFORMATIVE = f"""{_BASE.replace('n_name as donor', 'r_name as donor')},
{_grouped('donor')},
g2 as (select *, ref_count + alt_count >= 10 as tested from g),{_tested('g2', keep='tested', family='donor')},
best as (select donor, snp_id from (select donor, snp_id, row_number() over (partition by donor, gene_name order by ref_count + alt_count desc, pos) as rk from t join snps using (snp_id) where tested and adj_p_val < 0.05) where rk = 1),
state as (select donor, snp_id, gene % 2 as h, 0.05 + 0.02 * (gene % 9) as pi from (select *, row_number() over (partition by donor order by snp_id) - 1 as gene from best)),
entry as (select donor, cell_id as unit, snp_id, h, pi, ref_count as r, ref_count + alt_count as n from counts join cells using (cell_id) join state using (donor, snp_id) where ref_count + alt_count > 0),
term as (select *, lgamma(r + pi * 19) + lgamma(n - r + (1 - pi) * 19) as inactive, lgamma(r + (1 - pi) * 19) + lgamma(n - r + pi * 19) as active from entry),
odds as (select donor, unit, sum((1 - 2 * h) * (inactive - active)) as odds from term group by 1, 2)"""


def _given_fit(spark, d):
    """Units of the informative SNPs, and a state of the fit: phases alternate, escape fractions go in steps."""
    cube = _on_x(spark, d)
    units = written(X._units(X._on_x(cube), "cell"), "units")
    snps = written(X.informative_snps(X._by_donor(cube, units)).select("donor", "snp_id"), "informative")
    names: dict[str, list[str]] = {}
    for r in snps.orderBy("donor", "snp_id").collect():
        names.setdefault(r["donor"], []).append(r["snp_id"])
    donors = sorted(names)
    genes = spark.createDataFrame([(x, s, k, i) for k, x in enumerate(donors) for i, s in enumerate(names[x])], "donor string, snp_id string, donor_no int, gene int")
    fits = {}
    for k, x in enumerate(donors):
        i = np.arange(len(names[x]))
        fits[k] = {"h": i % 2, "pi": 0.05 + 0.02 * (i % 9)}
        fits[k] |= {"h_used": fits[k]["h"], "pi_used": fits[k]["pi"]}
    packed = X.pack(X._informative_entries(units, snps), genes)
    return packed, fits, donors, names


@_query("xci_unit_posteriors", f"{_INFORMATIVE}\nselect donor, unit, round(1 / (1 + exp(-greatest(-500, least(500, odds)))), 6) as post from odds")
def _(spark, d):
    packed, fits, donors, _ = _given_fit(spark, d)
    named = spark.createDataFrame(list(enumerate(donors)), "donor int, name string")
    return X.posteriors(packed, fits).join(F.broadcast(named), "donor").select(F.col("name").alias("donor"), "unit", F.round("post", 6).alias("post"))


@_query("xci_gene_evidence", f"{_INFORMATIVE}\nselect donor, snp_id, round(sum((1 - 2 * h) * (inactive - active) / (1 + exp(-greatest(-500, least(500, odds))))), 4) as evidence from term join odds using (donor, unit) group by 1, 2")
def _(spark, d):
    packed, fits, donors, names = _given_fit(spark, d)
    found = X.gene_evidence(packed, fits)
    rows = [(x, s, float(v)) for k, x in enumerate(donors) for s, v in zip(names[x], found[k], strict=True)]
    return spark.createDataFrame(rows, "donor string, snp_id string, evidence double").withColumn("evidence", F.round("evidence", 4))


def _assigned(spark, d) -> AlleleCube:
    """Assignments as they might come out of a fit: X1, X2 or none by cell, every third SNP informative."""
    cube = _on_x(spark, d)
    k = F.col("_ord")
    cells = cube.cell_dim.withColumns({"inactive_x": F.when(k % 5 != 0, F.when(k % 2 == 0, "X1").otherwise("X2")), "xci_post_X1": (k * 37 % 101) / F.lit(101.0)})
    snps = cube.snp_dim.withColumns({"xci_informative": k % 3 == 0, "xci_informative_donor": F.when(k % 2 == 0, "ASIA,EUROPE").otherwise("AFRICA,EUROPE"), "xci_allele_on_x1": F.when(k % 2 == 0, "REF").otherwise("ALT"), "xci_escape_fraction": F.lit(0.1)})
    return AlleleCube(cube.counts, snps, cells, cube.chr_style)


_CALLED = f"{_BASE},\ncalled as (select cell_id, region as donor, case when ord % 5 <> 0 then case when ord % 2 = 0 then 'X1' else 'X2' end end as inactive_x, (ord * 37 % 101) / 101.0::double as post from cells)"


@_query("xci_tally", f"{_CALLED}\nselect coalesce(inactive_x, 'unassigned') as inactive_x, count(*) as count from called group by 1")
def _(spark, d):
    return X.assignment_tally(_assigned(spark, d))


@_query("heatmap_values", f"""{_CALLED},
s as (select snp_id, gene_name as gene from snps where pos % 3 = 0),
e as (select cell_id, gene, ref_count / (ref_count + alt_count) as ref_fraction, ref_count + alt_count as depth, inactive_x, post from counts join s using (snp_id) join called using (cell_id) where inactive_x is not null and donor = 'EUROPE' and ref_count + alt_count > 0),
q as (select gene, count(*) as covered, abs((sum(case inactive_x when 'X1' then ref_fraction else 0 end) + 2.5) / (count(*) filter (inactive_x = 'X1') + 5) - (sum(case inactive_x when 'X2' then ref_fraction else 0 end) + 2.5) / (count(*) filter (inactive_x = 'X2') + 5)) as discrimination from e group by 1),
o as (select *, row_number() over (order by discrimination desc, gene) as gene_order from q where covered >= 3),
f as (select * from e join o using (gene) where gene_order <= 8),
u as (select cell_id, row_number() over (order by post desc, cell_id) as unit_order from (select distinct cell_id, post from f))
select cell_id, gene, round(ref_fraction, 9) as ref_fraction, cast(depth as bigint) as depth, inactive_x, round(post, 9) as xci_post_X1, unit_order, gene_order, round(discrimination, 9) as discrimination from f join u using (cell_id)""")
def _(spark, d):
    out = X.heatmap_frame(_assigned(spark, d), "EUROPE", min_coverage_cells=3, max_genes=8)
    return out.withColumns({c: F.round(c, 9) for c in ("ref_fraction", "xci_post_X1", "discrimination")})
