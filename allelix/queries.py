"""Registered queries of the allele-count engine, over a cube built from the star schema, with their SQL.

SNPs are pairs of part brand and type, cells are customers, donors nations, clonotypes nation and market segment.
Discounts below 0.09 count for the reference allele, others for the alternate; high taxes count as other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions.chroms import TABLE, convert_chr_style, normalize_chr_names
from allelix.functions.scalars import snp_key
from allelix.model import COUNTS, AlleleCube, assign_snp_ids, cell_metrics, first_of_each, snp_metrics
from allelix.operators import aggregate as A
from allelix.operators import annotate as N
from allelix.operators import filters as R
from allelix.operators import stats as S
from allelix.operators import xci as X
from allelix.operators.merge import merge_cubes
from allelix.plans.frames import histogram
from allelix.tables import dealt


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def counts_of(spark: SparkSession, d: str, orders: str | None = None, snp=lambda c: c, cell=lambda c: c) -> DataFrame:
    """snp and cell: what is made of the ids, one to one. They come here, as ids that change once counts are dealt out by them must be dealt out anew."""
    o = _t(spark, d, "orders")
    o = o.filter(orders) if orders else o
    part = _t(spark, d, "part").select("p_partkey", F.concat_ws(":", "p_brand", "p_type").alias("snp_id"))
    q = F.col("l_quantity").cast("long")
    given = lambda c, v: F.when(c, v).otherwise(F.lit(0)).cast("long")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", given(F.col("l_discount") < 0.09, q).alias("ref_count"), given(F.col("l_discount") >= 0.09, q).alias("alt_count"), given(F.col("l_tax") >= 0.08, F.lit(1)).alias("oth_count"))
    li = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    cell_id = cell(F.col("o_custkey").cast("string"))
    # few lines share SNP and cell, so they are dealt out by cell, as joins with the cells need them, and added up there; on
    # the way they hold what the ids are made of, which is shorter
    li = dealt(li.select("o_custkey", *COUNTS, "snp_id"), cell_id)
    return li.select(snp(F.col("snp_id")).alias("snp_id"), cell_id.alias("cell_id"), *COUNTS).groupBy("snp_id", "cell_id").agg(*(F.sum(c).alias(c) for c in COUNTS))


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").cast("string").alias("cell_id"), F.concat(F.lit("BC"), "c_custkey").alias("barcode"), F.col("n_name").alias("donor"), F.col("r_name").alias("region"), F.concat_ws("_", "n_name", "c_mktsegment").alias("clonotype"), F.col("c_custkey").cast("long").alias("_ord"))


def snps_of(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").cast("long").alias("pos"))
    return p.select(F.concat_ws(":", "p_brand", "p_type").alias("snp_id"), F.concat(F.lit("chr"), F.col("pos") % 22 + 1).alias("chrom"), "pos", F.col("p_brand").alias("gene_name"), F.col("pos").alias("_ord"))


def cube_of(spark: SparkSession, d: str, orders: str | None = None) -> AlleleCube:
    return _cube(counts_of(spark, d, orders), spark, d)


def _cube(counts: DataFrame, spark: SparkSession, d: str) -> AlleleCube:
    return AlleleCube.from_frames(counts, snps_of(spark, d), cells_of(spark, d), check=False, style="ucsc")


_X, _Y = "o_orderdate < date'1996-01-01'", "o_orderdate >= date'1995-01-01'"


def _counts_sql(name: str, where: str = "true") -> str:
    return f"""{name} as (
  select p_brand || ':' || p_type as snp_id, cast(o_custkey as varchar) as cell_id,
         cast(sum(case when l_discount < 0.09 then l_quantity else 0 end) as bigint) as ref_count,
         cast(sum(case when l_discount >= 0.09 then l_quantity else 0 end) as bigint) as alt_count,
         cast(sum(case when l_tax >= 0.08 then 1 else 0 end) as bigint) as oth_count
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where {where} group by 1, 2)"""


_DIMS = """cells as (
  select cast(c_custkey as varchar) as cell_id, 'BC' || c_custkey as barcode, n_name as donor, r_name as region,
         n_name || '_' || c_mktsegment as clonotype, cast(c_custkey as bigint) as ord
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
snps as (
  select p_brand || ':' || p_type as snp_id, 'chr' || (min(p_partkey) % 22 + 1) as chrom, cast(min(p_partkey) as bigint) as pos, p_brand as gene_name
  from part group by p_brand, p_type)"""
_BASE = "with " + _counts_sql("counts") + ",\n" + _DIMS
_LONG = "ref_count, alt_count, ref_count + alt_count as total_count, ref_count / (ref_count + alt_count) as ref_ratio, least(ref_count, alt_count) / (ref_count + alt_count) as maf"


def _grouped(group: str, extra: str = "", name: str = "g", more: str = "true") -> str:
    return f"""{name} as (select snp_id, {group}{extra}, cast(sum(ref_count) as bigint) as ref_count, cast(sum(alt_count) as bigint) as alt_count
  from counts join cells using (cell_id) where {group} is not null and {more} group by all having sum(ref_count) + sum(alt_count) > 0)"""


def _tested(source: str, p: float = 0.1, keep: str = "true", family: str = "") -> str:
    """CTEs: a row of `source` with p_val and adj_p_val; keep: which rows are tested."""
    by = f"partition by {family} " if family else ""
    return f"""
m as (select *, case when {keep} then least(ref_count, alt_count) end as minor_allele_count, ref_count + alt_count as n from {source}),
tail as (select minor_allele_count, n, case when minor_allele_count = 0 then 1 else least(1, list_sum(list_transform(range(minor_allele_count, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p}))))) end as p_val
  from (select distinct minor_allele_count, n from m where minor_allele_count is not null)),
r as (select m.*, p_val, count(p_val) over ({by}) * p_val / count(p_val) over ({by}order by p_val nulls last range unbounded preceding) as q from m left join tail using (minor_allele_count, n)),
t as (select *, case when p_val is not null then least(1.0, min(q) over ({by}order by p_val desc nulls first range unbounded preceding)) end as adj_p_val from r)"""


_P = "minor_allele_count, round(p_val + 1e-12, 6) as p_val, round(adj_p_val + 1e-12, 6) as adj_p_val"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-12, 6) for c in ("p_val", "adj_p_val")})


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query("barcode_counts", f"{_BASE},\ng as (select * from counts where ref_count + alt_count > 0),{_tested('g')}\nselect snp_id, gene_name, chrom, pos, cell_id, {_LONG}, {_P} from t join snps using (snp_id)")
def _(spark, d):
    return _rounded(A.cell_counts(cube_of(spark, d)))


@_query("donor_counts", f"{_BASE},\n{_grouped('donor')},{_tested('g')}\nselect snp_id, gene_name, chrom, pos, donor, {_LONG}, {_P} from t join snps using (snp_id)")
def _(spark, d):
    return _rounded(A.donor_counts(cube_of(spark, d)))


_LIKELY = "k as (select clonotype, donor from (select clonotype, donor, row_number() over (partition by clonotype order by count(*) desc, donor) as rk from cells where donor is not null and clonotype is not null group by 1, 2) where rk = 1)"


@_query("clonotype_counts_with_donor", f"{_BASE},\n{_grouped('clonotype')},\n{_LIKELY},{_tested('g')}\nselect snp_id, gene_name, chrom, pos, clonotype, donor, {_LONG}, {_P} from t join snps using (snp_id) left join k using (clonotype)")
def _(spark, d):
    return _rounded(A.clonotype_counts(cube_of(spark, d)))


@_query("most_likely_donor", f"{_BASE.replace('n_name as donor', 'r_name as donor').replace(chr(39) + '_' + chr(39) + ' || c_mktsegment', chr(39) + '_' + chr(39) + ' || c_mktsegment')},\nk as (select segment, donor from (select right(clonotype, 3) as segment, donor, row_number() over (partition by right(clonotype, 3) order by count(*) desc, donor) as rk from cells group by 1, 2) where rk = 1)\nselect segment as clonotype, donor from k")
def _(spark, d):
    cube = cube_of(spark, d)
    cells = cube.cell_dim.withColumns({"donor": F.col("region"), "clonotype": F.expr("right(clonotype, 3)")})
    return A.most_likely_donor(AlleleCube(cube.counts, cube.snp_dim, cells, cube.chr_style))


@_query("group_counts_custom", f"{_BASE},\n{_grouped('region')},{_tested('g')}\nselect snp_id, gene_name, chrom, pos, region, {_LONG}, {_P} from t join snps using (snp_id)")
def _(spark, d):
    return _rounded(A.group_counts(cube_of(spark, d), "region"))


_SNP_METRICS = "select snp_id, cast(coalesce(sum(ref_count + alt_count), 0) as bigint) as coverage, count(*) filter (ref_count + alt_count > 0) as non_zero_samples"
_CELL_METRICS = "select cell_id, cast(coalesce(sum(ref_count + alt_count), 0) as bigint) as library_size, count(*) filter (ref_count + alt_count > 0) as non_zero_snps"


@_query("snp_metrics", f"{_BASE}\n{_SNP_METRICS} from snps left join counts using (snp_id) group by 1")
def _(spark, d):
    return cube_of(spark, d).snps.select("snp_id", "coverage", "non_zero_samples")


@_query("cell_metrics", f"{_BASE}\n{_CELL_METRICS} from cells left join counts using (cell_id) group by 1")
def _(spark, d):
    return cube_of(spark, d).cells.select("cell_id", "library_size", "non_zero_snps")


@_query("filter_snps_coverage", f"{_BASE},\nk as (select snp_id from counts group by 1 having sum(ref_count + alt_count) > 10000),\nc as (select * from counts where snp_id in (select snp_id from k))\n{_CELL_METRICS} from cells left join c using (cell_id) group by 1")
def _(spark, d):
    return R.filter_snps(cube_of(spark, d), "coverage > 10000", strict=False).cells.select("cell_id", "library_size", "non_zero_snps")


@_query("filter_cells_libsize", f"{_BASE},\nk as (select cell_id from counts group by 1 having sum(ref_count + alt_count) > 1000),\nc as (select * from counts where cell_id in (select cell_id from k))\n{_SNP_METRICS} from snps left join c using (snp_id) group by 1")
def _(spark, d):
    return R.filter_cells(cube_of(spark, d), F.col("library_size") > 1000, strict=False).snps.select("snp_id", "coverage", "non_zero_samples")


def _with_odd_donors(cube: AlleleCube) -> AlleleCube:
    donor = F.when(F.col("donor") == "NATION_3", "doublet").when(F.col("donor") == "NATION_4", F.lit(None)).when(F.col("donor") == "NATION_5", "unassigned").otherwise(F.col("donor"))
    clonotype = F.when(~F.col("clonotype").endswith("MACHINERY"), F.col("clonotype"))
    return AlleleCube(cube.counts, cube.snp_dim, cube.cell_dim.withColumns({"donor": donor, "clonotype": clonotype}), cube.chr_style)


_ODD = _BASE.replace("n_name as donor", "case n_name when 'NATION_3' then 'doublet' when 'NATION_5' then 'unassigned' when 'NATION_4' then null else n_name end as donor").replace("n_name || '_' || c_mktsegment as clonotype", "case when c_mktsegment <> 'MACHINERY' then n_name || '_' || c_mktsegment end as clonotype")


@_query("remove_doublets", f"{_ODD}\nselect cell_id, donor, cast(coalesce(sum(ref_count + alt_count), 0) as bigint) as library_size from cells left join counts using (cell_id) where donor <> 'doublet' group by 1, 2")
def _(spark, d):
    return R.remove_doublets(_with_odd_donors(cube_of(spark, d))).cells.select("cell_id", "donor", "library_size")


@_query("remove_na_group", f"{_ODD},\n{_grouped('clonotype')},{_tested('g')}\nselect snp_id, clonotype, {_LONG}, {_P} from t")
def _(spark, d):
    return _rounded(A.group_counts(R.remove_na_clonotypes(_with_odd_donors(cube_of(spark, d))), "clonotype")).drop("gene_name", "chrom", "pos")


@_query("donor_counts_exclusion", f"{_ODD},\n{_grouped('donor', more=chr(100) + 'onor not in (' + chr(39) + 'doublet' + chr(39) + ', ' + chr(39) + 'unassigned' + chr(39) + ')')}\nselect snp_id, donor, ref_count, alt_count from g")
def _(spark, d):
    return A.donor_counts(_with_odd_donors(cube_of(spark, d)), maf_test=False).select("snp_id", "donor", "ref_count", "alt_count")


_EXPR = "round((ref_count - alt_count) / (ref_count + alt_count + 1) * ln(1 + ref_count + alt_count), 9) as expr"


@_query("expr_barcode", f"{_BASE}\nselect snp_id, cell_id as \"group\", {_EXPR} from counts where ref_count + alt_count + oth_count > 0")
def _(spark, d):
    return A.expression_values(cube_of(spark, d), "barcode").withColumn("expr", F.round("expr", 9))


@_query("expr_donor", f"{_ODD},\n{_grouped('donor')}\nselect snp_id, donor as \"group\", {_EXPR} from g")
def _(spark, d):
    return A.expression_values(_with_odd_donors(cube_of(spark, d)), "don").withColumn("expr", F.round("expr", 9))


@_query("maf_test_donor", f"{_BASE},\n{_grouped('donor')},{_tested('g')}\nselect snp_id, donor, minor_allele_count, round(p_val + 1e-12, 6) as p_val, round(adj_p_val + 1e-12, 6) as adj_p_val from t")
def _(spark, d):
    return A.donor_counts(cube_of(spark, d)).select("snp_id", "donor", "minor_allele_count", F.round(F.col("p_val") + 1e-12, 6).alias("p_val"), F.round(F.col("adj_p_val") + 1e-12, 6).alias("adj_p_val"))


@_query("bh_adjust", "with p as (select c_custkey, (c_custkey * 7919 % 997 + 1) / 1000.0 as p_val from customer), q as (select *, cast(count(*) over () as double) * p_val / count(*) over (order by p_val range unbounded preceding) as q from p)\nselect c_custkey, round(cast(p_val as double), 9) as p_val, round(cast(least(1.0, min(q) over (order by p_val desc range unbounded preceding)) as double), 9) as adj_p_val from q")
def _(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 997 + 1) / F.lit(1000.0)).alias("p_val"))
    return S.bh_adjust(c).withColumns({"p_val": F.round("p_val", 9), "adj_p_val": F.round("adj_p_val", 9)})


_CALL = "case when tested and adj_p_val < 0.05 then 'het' when tested then 'hom' else 'unknown' end as zygosity"


@_query("het_status", f"{_BASE},\n{_grouped('donor')},\ng2 as (select *, ref_count + alt_count >= 300 as tested from g),{_tested('g2', keep='tested')}\nselect snp_id, donor, ref_count, alt_count, tested, round(p_val + 1e-12, 6) as p_val, round(adj_p_val + 1e-12, 6) as adj_p_val, {_CALL} from t")
def _(spark, d):
    out = S.donor_het_status(cube_of(spark, d), min_total_count=300)
    return out.select("snp_id", "donor", "ref_count", "alt_count", "tested", F.round(F.col("p_val") + 1e-12, 6).alias("p_val"), F.round(F.col("adj_p_val") + 1e-12, 6).alias("adj_p_val"), "zygosity")


@_query("donor_het_subset", f"{_BASE},\n{_grouped('donor', more=chr(100) + 'onor = ' + chr(39) + 'NATION_3' + chr(39))},\ng2 as (select *, ref_count + alt_count >= 10 as tested from g),{_tested('g2', keep='tested')}\nselect snp_id, cast(ref_count + alt_count as bigint) as coverage from t where tested and adj_p_val < 0.05")
def _(spark, d):
    return S.donor_het_cube(cube_of(spark, d), "NATION_3").snps.select("snp_id", "coverage")


@_query("gene_interval_join", """with s as (select p_partkey, 'chr' || (p_partkey % 22 + 1) as chrom, p_partkey * 10 as pos from part),
g as (select 'chr' || (s_suppkey % 22 + 1) as chrom, s_suppkey * 40 as a, s_suppkey * 40 + 900 as z, s_name as gene_name, s_suppkey as ord from supplier)
select p_partkey, s.chrom, pos, string_agg(gene_name, ', ' order by ord) as gene_name from s left join g on s.chrom = g.chrom and pos between a and z group by 1, 2, 3""")
def _(spark, d):
    key = lambda c: F.concat(F.lit("chr"), F.col(c) % 22 + 1).alias("chrom")
    snps = _t(spark, d, "part").select("p_partkey", key("p_partkey"), (F.col("p_partkey") * 10).alias("pos"), F.col("p_partkey").cast("long").alias("_ord"))
    genes = _t(spark, d, "supplier").select(key("s_suppkey"), (F.col("s_suppkey") * 40).alias("start"), (F.col("s_suppkey") * 40 + 900).alias("end"), F.col("s_name").alias("gene_name"), F.col("s_suppkey").cast("long").alias("_ord"))
    return N.add_gene_names(snps, genes).select("p_partkey", "chrom", "pos", "gene_name")


@_query("region_semi_join", """with v as (select p_partkey, p_partkey % 22 as chrom, p_partkey * 10 as pos from part), b as (select s_suppkey % 22 as chrom, s_suppkey * 40 as a, s_suppkey * 40 + 300 as z from supplier)
select p_partkey from v where exists (select 1 from b where b.chrom = v.chrom and pos > a and pos <= z)""")
def _(spark, d):
    v = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 22).alias("CHROM"), (F.col("p_partkey") * 10).alias("POS"), F.lit("A").alias("REF"), F.col("p_partkey").cast("long").alias("_ord"))
    bed = _t(spark, d, "supplier").select((F.col("s_suppkey") % 22).alias("chrom"), (F.col("s_suppkey") * 40).alias("start"), (F.col("s_suppkey") * 40 + 300).alias("end"))
    return N.in_regions(v, bed).select("p_partkey")


def _case(names: dict[str, str]) -> str:
    return "case chrom " + " ".join(f"when '{a}' then '{b}'" for a, b in names.items()) + " else chrom end"


_RAW = "with r as (select p_partkey, case p_partkey % 27 when 0 then 'X' when 23 then 'Y' when 24 then 'MT' when 25 then 'KI270728.1' else cast(p_partkey % 27 as varchar) end as chrom from part)"
_CANONICAL = {TABLE["numeric"][c]: TABLE["ucsc"][c] for c in TABLE["numeric"]}


@_query("chrom_normalize", f"{_RAW}\nselect p_partkey, {_case(_CANONICAL)} as canonical, {_case({TABLE['numeric'][c]: TABLE['refseq_human'][c] for c in TABLE['numeric']})} as refseq from r")
def _(spark, d):
    k = F.col("p_partkey") % 27
    raw = _t(spark, d, "part").select("p_partkey", F.when(k == 0, "X").when(k == 23, "Y").when(k == 24, "MT").when(k == 25, "KI270728.1").otherwise(k.cast("string")).alias("chrom"))
    return raw.select("p_partkey", normalize_chr_names(F.col("chrom"), "numeric").alias("canonical"), convert_chr_style(F.col("chrom"), "numeric", "refseq_human").alias("refseq"))


@_query("snp_id_build", "select p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'NA') || ':' || p_size || ':' || p_type || ':' || p_name as snp_id from part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", snp_key(F.expr("nullif(p_brand, 'Brand#11')"), F.col("p_size"), F.col("p_type"), F.col("p_name")).alias("snp_id"))


@_query("dedupe_snps", "select p_brand || ':' || p_size as snp_id, cast(min(p_partkey) as bigint) as pos from part group by 1")
def _(spark, d):
    snps = _t(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_size").alias("snp_id"), F.col("p_partkey").cast("long").alias("pos"), F.col("p_partkey").cast("long").alias("_ord"))
    return first_of_each(assign_snp_ids(snps)).select("snp_id", "pos")


def _two_sql(query: str) -> str:
    """SQL over two overlapping cubes: orders up to 1995 and from 1995 on. Some SNPs and cells go by other names in one of them, so each has ids of its own."""
    snp_x, snp_y = "case when snp_id >= 'Brand#4' then 'old:' || snp_id else snp_id end", "case when snp_id < 'Brand#2' then 'new:' || snp_id else snp_id end"
    cell_x, cell_y = "case when cast(cell_id as bigint) % 3 = 0 then 'x' || cell_id else cell_id end", "case when cast(cell_id as bigint) % 3 = 1 then 'y' || cell_id else cell_id end"
    sides = [f"""
u{k} as (select {snp} as snp_id, {cell} as cell_id, ref_count, alt_count, oth_count from c{k}),
s{k} as (select {snp} as snp_id, gene_name, pos from snps), l{k} as (select {cell} as cell_id, ord from cells)""" for k, snp, cell in (("x", snp_x, cell_x), ("y", snp_y, cell_y))]
    return "with " + _counts_sql("cx", "o_orderdate < date '1996-01-01'") + ",\n" + _counts_sql("cy", "o_orderdate >= date '1995-01-01'") + ",\n" + _DIMS + "," + ",".join(sides) + ",\nu as (select * from ux union all select * from uy)\n" + query


_SUMS = "select snp_id, cell_id, cast(sum(ref_count) as bigint) as ref_count, cast(sum(alt_count) as bigint) as alt_count, cast(sum(oth_count) as bigint) as oth_count"


def _pair(spark, d, barcodes: bool = False) -> tuple[AlleleCube, AlleleCube]:
    out = []
    sides = (_X, lambda c: F.when(c >= "Brand#4", "old:"), lambda c: F.when(c.cast("long") % 3 == 0, "x")), (_Y, lambda c: F.when(c < "Brand#2", "new:"), lambda c: F.when(c.cast("long") % 3 == 1, "y"))
    for when, *marks in sides:
        snp, cell = ((lambda c, mark=m: F.concat(F.coalesce(mark(c), F.lit("")), c)) for m in marks)
        cube = _cube(counts_of(spark, d, when, snp, cell), spark, d)
        cells = cube.cell_dim.withColumn("cell_id", cell(F.col("cell_id")))
        cells = cells.withColumn("barcode", F.concat(F.lit("BC"), "cell_id")) if barcodes else cells.drop("barcode")
        out.append(AlleleCube(cube.counts, cube.snp_dim.withColumn("snp_id", snp(F.col("snp_id"))), cells, cube.chr_style))
    return tuple(out)


def _merge_sql(snps: str, cells: str) -> str:
    return _two_sql(f"{_SUMS} from u where snp_id in ({snps}) and cell_id in ({cells}) group by 1, 2 having sum(ref_count + alt_count + oth_count) > 0")


def _either(a: str, b: str, key: str, how: str) -> str:
    one = {"union": f"select {key} from {a} union select {key} from {b}", "intersect": f"select {key} from {a} intersect select {key} from {b}", "left": f"select {key} from {a}", "right": f"select {key} from {b}"}
    return one[how]


for _s in ("union", "intersect", "left", "right"):
    for _c in ("union", "intersect", "left", "right"):

        @_query(f"merge_{_s}_{_c}", _merge_sql(_either("sx", "sy", "snp_id", _s), _either("lx", "ly", "cell_id", _c)))
        def _(spark, d, s=_s, c=_c):
            return merge_cubes(*_pair(spark, d), s, c, strict=False).counts


@_query("metadata_overwrite", f"{_BASE},\nnew as (select cell_id, cast(ord % 5 as varchar) as region, ord as batch from cells where ord % 2 = 0)\nselect cell_id, donor, new.region, batch from cells left join new using (cell_id)")
def _(spark, d):
    cube = cube_of(spark, d)
    new = cube.cell_dim.filter("_ord % 2 = 0").select("cell_id", (F.col("_ord") % 5).cast("string").alias("region"), F.col("_ord").alias("batch"))
    return N.add_cell_metadata(cube, new, overwrite=True).cell_dim.select("cell_id", "donor", "region", "batch")


@_query("top_snp_per_gene", f"{_BASE},\nc as ({_SNP_METRICS} from snps left join counts using (snp_id) group by 1)\nselect gene_name, snp_id, coverage from (select *, row_number() over (partition by gene_name order by coverage desc, pos) as rk from c join snps using (snp_id)) where rk = 1")
def _(spark, d):
    return A.top_snp_per_gene(cube_of(spark, d).snps).select("gene_name", "snp_id", "coverage")


@_query("percentile_summary", f"{_BASE},\nc as ({_CELL_METRICS} from cells left join counts using (cell_id) group by 1)\nselect cast(min(library_size) as double) as min, quantile_cont(library_size, 0.1) as p10, quantile_cont(library_size, 0.25) as p25, quantile_cont(library_size, 0.5) as median, quantile_cont(library_size, 0.75) as p75, quantile_cont(library_size, 0.9) as p90, quantile_cont(library_size, 0.95) as p95, round(quantile_cont(library_size, 0.99), 6) as p99, cast(max(library_size) as double) as max from c")
def _(spark, d):
    out = S.percentile_summary(cube_of(spark, d).cells, "library_size")
    return out.withColumn("p99", F.round("p99", 6))


@_query("outlier_genes", f"""{_BASE},
u as (select gene_name as gene, cell_id, sum(ref_count) as r, sum(alt_count) as a from counts join snps using (snp_id) group by 1, 2 having sum(ref_count) + sum(alt_count) >= 1),
s as (select gene, count(*) as covered, greatest(count(*) filter (r > a) / count(*), 1 - count(*) filter (r > a) / count(*)) as skew from u group by 1 having count(*) >= 10),
e as (select *, median(skew) over () as mid from s), f as (select *, 1.4826 * median(abs(skew - mid)) over () as mad from e)
select gene, covered, round(skew, 9) as skew, round(case when mad > 0 then (skew - mid) / mad else 0 end, 6) as z, abs(case when mad > 0 then (skew - mid) / mad else 0 end) <= 2 as keep from f""")
def _(spark, d):
    cube = cube_of(spark, d)
    units = cube.counts.join(cube.snp_dim.select("snp_id", F.col("gene_name").alias("gene")), "snp_id").groupBy("gene", "cell_id").agg(F.sum("ref_count").alias("ref_count"), F.sum("alt_count").alias("alt_count"))
    return S.outlier_genes(units).withColumns({"skew": F.round("skew", 9), "z": F.round("z", 6)})


@_query("library_size_histogram", f"{_BASE},\nc as ({_CELL_METRICS} from cells left join counts using (cell_id) group by 1), s as (select min(library_size) as a, max(library_size) as z from c)\nselect cast(least(floor((library_size - a) / greatest((z - a) / 50, 1e-12)), 49) as integer) as bin, count(*) as n from c, s group by 1")
def _(spark, d):
    return histogram(cube_of(spark, d).cells, "library_size").select("bin", "n")


def _on_x(spark, d) -> AlleleCube:
    cube = cube_of(spark, d)
    return AlleleCube(cube.counts, cube.snp_dim.withColumns({"chrom": F.lit("chrX"), "chrom_canonical": F.lit("chrX")}), cube.cell_dim.withColumn("donor", F.col("region")), cube.chr_style)
