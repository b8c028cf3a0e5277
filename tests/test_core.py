import math
import re
import warnings

import numpy as np
import plain_xci
import pytest
from pyspark.sql import functions as F

from allelix import more_queries, queries, xci_queries  # noqa: F401  more_queries adds to queries
from allelix.functions.binomial import binom_tail
from allelix.functions.chroms import convert_chr_style, normalize_chr_names, style_of
from allelix.model import AlleleCube, assign_cell_ids, numbered
from allelix.operators import aggregate as A
from allelix.operators import annotate as N
from allelix.operators import filters as R
from allelix.operators import stats as S
from allelix.operators import xci as X
from allelix.operators import xci_kernel as K
from allelix.operators.merge import merge_cubes
from allelix.sources.cellsnp import DONORS, export_bundle, example_cube, import_bundle, merge_cell_annotations


def two(spark, ref=((5, 7), (6, 8)), alt=((1, 3), (2, 4))):
    snps = spark.createDataFrame([("snp_1", 100), ("snp_2", 200)], "snp_id string, pos int")
    cells = spark.createDataFrame([("cell_1", "donor_1", "clonotype_1"), ("cell_2", "donor_1", "clonotype_2")], "cell_id string, donor string, clonotype string")
    return AlleleCube.from_arrays(spark, ref, alt, snps, cells)


def test_metrics(spark):
    cube = two(spark)
    assert [tuple(r) for r in cube.snps.orderBy("snp_id").select("coverage", "non_zero_samples").collect()] == [(16, 2), (20, 2)]
    assert [tuple(r) for r in cube.cells.orderBy("cell_id").select("library_size", "non_zero_snps").collect()] == [(14, 2), (22, 2)]
    kept = R.filter_cells(cube, "cell_id = 'cell_1'")
    assert [r.coverage for r in kept.snps.orderBy("snp_id").collect()] == [6, 8]


def test_counts_by_group(spark):
    cube = two(spark)
    d = {r.snp_id: (r.ref_count, r.alt_count) for r in A.donor_counts(cube).collect()}
    assert d == {"snp_1": (12, 4), "snp_2": (14, 6)}
    assert A.clonotype_counts(cube, maf_test=False).count() == A.cell_counts(cube, maf_test=False).count() == 4
    golden = two(spark, ((90, 70), (80, 60)), ((10, 30), (20, 40)))
    rows = {r.snp_id: (r.total_count, r.ref_ratio, r.maf) for r in A.group_counts(golden, "donor", maf_test=False).collect()}
    assert rows == {"snp_1": (200, 0.8, 0.2), "snp_2": (200, 0.7, 0.3)}
    with pytest.raises(ValueError):
        A.group_counts(cube, "nothing")


def test_first_of_duplicate_snps_stays(spark):
    snps = spark.createDataFrame([("dup", 100), ("dup", 300), ("one", 200)], "snp_id string, pos int")
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        cube = AlleleCube.from_arrays(spark, [[5, 6], [7, 8], [9, 10]], [[1, 2], [3, 4], [5, 6]], snps, cells)
    assert any("duplicate" in str(x.message) for x in w)
    assert [r.pos for r in cube.snp_dim.orderBy("_ord").collect()] == [100, 200]
    assert {r.coverage for r in cube.snps.collect()} == {14, 30}


def test_binomial_tail_is_exact():
    for n in (1, 5, 10, 25, 100):
        for p, side in ((0.3, "greater"), (0.7, "less")):
            x = np.arange(n + 1)
            got = binom_tail(x, np.full(n + 1, n), p, side)
            pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
            want = [sum(pmf[k:]) if side == "greater" else sum(pmf[: k + 1]) for k in x]
            assert np.allclose(got, want, rtol=1e-10, atol=1e-14)
    assert 0 <= binom_tail([200_000], [5_200_000], 0.1)[0] <= 1
    with pytest.raises(ValueError):
        binom_tail([3], [2], 0.1)


def test_maf_golden(spark):
    df = spark.createDataFrame([(10, 2, 12), (5, 8, 13), (20, 1, 21)], "ref_count long, alt_count long, total_count long")
    rows = S.test_maf(df).orderBy("ref_count").collect()
    by = {r.ref_count: (r.p_val, r.adj_p_val) for r in rows}
    for k, (p, q) in {10: (0.3409977482, 0.5114966223), 5: (0.0064601560, 0.0193804679), 20: (0.8905810109, 0.8905810109)}.items():
        assert by[k] == pytest.approx((p, q), abs=1e-9)
    with pytest.raises(ValueError, match="rows 1"):
        S.test_maf(spark.createDataFrame([(10, 5, 12)], "ref_count long, alt_count long, total_count long"))
    missing = S.test_maf(spark.createDataFrame([(10, 2, 12), (None, 5, 13)], "ref_count long, alt_count long, total_count long"))
    assert missing.filter("ref_count is null").first().minor_allele_count is None


def test_bh_matches_plain(spark):
    p = np.random.default_rng(1).random(300).round(2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p_val double")
    got = [r.adj_p_val for r in S.bh_adjust(df, buckets=8).orderBy("i").collect()]
    order = np.argsort(-p)
    rank = np.arange(300, 0, -1)
    want = np.empty(300)
    want[order] = np.minimum(1, np.minimum.accumulate(300 / rank * p[order]))
    assert np.allclose(got, want)


def het_cube(spark):
    snps = spark.createDataFrame([(f"snp{i}",) for i in range(1, 5)], "snp_id string")
    cells = spark.createDataFrame([(f"c{j}", f"donor{1 + j // 2}") for j in range(4)], "cell_id string, donor string")
    return AlleleCube.from_arrays(spark, [[5] * 4, [9] * 4, [5] * 4, [0, 1, 2, 3]], [[5] * 4, [1] * 4, [5] * 4, [1, 2, 3, 4]], snps, cells)


def test_heterozygosity(spark):
    rows = {(r.snp_id, r.donor): r for r in S.donor_het_status(het_cube(spark)).collect()}
    assert [rows[f"snp{i}", "donor1"].zygosity for i in range(1, 5)] == ["het", "hom", "het", "unknown"]
    assert rows["snp4", "donor1"].p_val is None and rows["snp4", "donor2"].adj_p_val == pytest.approx(0.0060610806, abs=1e-9)
    assert rows["snp1", "donor1"].adj_p_val == pytest.approx(1.25141e-05, rel=1e-4)
    kept = S.donor_het_cube(het_cube(spark), "donor1")
    assert kept.snp_ids() == ["snp1", "snp3"] and kept.shape() == (2, 2)
    with pytest.raises(ValueError):
        S.donor_het_cube(het_cube(spark), "donor1", min_total_count=100)


def test_filters(spark):
    cube = two(spark)
    with pytest.raises(ValueError, match="No SNPs remain"):
        R.filter_snps(cube, "pos > 1000")
    with pytest.raises(ValueError, match="not present"):
        R.filter_snps(cube, "nothing > 1")
    cells = spark.createDataFrame([("cell_1", "doublet"), ("cell_2", None)], "cell_id string, donor string")
    odd = AlleleCube(cube.counts, cube.snp_dim, cube.cell_dim.drop("donor").join(cells, "cell_id"))
    assert R.remove_doublets(odd).shape()[1] == 0 and R.remove_doublets(odd, drop_na=False).cell_ids() == ["cell_2"]


def merge_pair(spark):
    def cube(snps, cells, ref, alt):
        return AlleleCube.from_arrays(spark, ref, alt, spark.createDataFrame(snps, "snp_id string, gene string"), spark.createDataFrame(cells, "cell_id string, donor string"))

    x = cube([("snpA", "geneA"), ("snpB", "geneB_x")], [("cell1", "d1"), ("cell2", "d2")], [[3, 1], [0, 1]], [[1, 0], [0, 2]])
    y = cube([("snpB", "geneB_y"), ("snpC", "geneC")], [("cell2", "d2_y"), ("cell3", "d3")], [[0, 1], [2, 1]], [[1, 2], [0, 1]])
    return x, y


def test_merge(spark):
    x, y = merge_pair(spark)
    m = merge_cubes(x, y)
    got = {(r.snp_id, r.cell_id): (r.ref_count, r.alt_count) for r in m.counts.collect()}
    assert got == {("snpA", "cell1"): (3, 1), ("snpA", "cell2"): (1, 0), ("snpB", "cell2"): (1, 3), ("snpB", "cell3"): (1, 2), ("snpC", "cell2"): (2, 0), ("snpC", "cell3"): (1, 1)}
    assert [(r.gene, r.coverage) for r in m.snps.orderBy("_ord").collect()] == [("geneA", 5), ("geneB_x", 7), ("geneC", 4)]
    assert [(r.donor, r.library_size, r.non_zero_snps) for r in m.cells.orderBy("_ord").collect()] == [("d1", 4, 1), ("d2", 7, 3), ("d3", 5, 2)]
    assert [tuple(r) for r in merge_cubes(x, y, "intersect", "intersect").counts.select("ref_count", "alt_count").collect()] == [(1, 3)]


def test_metadata(spark):
    cube = two(spark)
    new = spark.createDataFrame([("cell_1", "d9", 1)], "cell_id string, donor string, extra int")
    with pytest.raises(ValueError):
        N.add_cell_metadata(cube, new)
    got = N.add_cell_metadata(cube, new, overwrite=True).cells.orderBy("cell_id").collect()
    assert [(r.donor, r.extra, r.library_size) for r in got] == [("d9", 1, 14), (None, None, 22)]


def test_gene_join(spark):
    snps = spark.createDataFrame([("chr1", 150), ("chr1", 5), ("chr2", 150)], "chrom string, pos int")
    genes = spark.createDataFrame([("chr1", 150, 400_000, "B"), ("chr1", 100, 150, "A"), ("chr1", 120, 160, "B")], "chrom string, start int, end int, gene_name string")
    assert [r.gene_name for r in N.add_gene_names(snps, genes).orderBy("_ord").collect()] == ["B, A", None, None]


def test_chromosome_styles(spark):
    assert style_of(["1", "X"]) == "numeric" and style_of(["foo"]) == "unknown" and style_of(["NC_000001.11"]) == "refseq_human"
    with pytest.raises(ValueError):
        style_of(["1", "chr1"])
    df = spark.createDataFrame([("1",), ("MT",), ("scaffold",)], "c string")
    assert [r[0] for r in df.select(normalize_chr_names(F.col("c"), "numeric")).collect()] == ["chr1", "chrM", "scaffold"]
    assert df.select(convert_chr_style(F.col("c"), "numeric", "refseq_human")).first()[0] == "NC_000001.11"


def test_expression(spark):
    rows = {(r.snp_id, r.group): r.expr for r in A.expression_values(two(spark), "bar").collect()}
    assert rows["snp_1", "cell_1"] == pytest.approx((5 - 1) / 7 * math.log(7))


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "x int")
    r = S.percentile_summary(df, "x", (0.25, 0.75)).first()
    assert (r.min, r.p25, r["median"], r.p75, r.max) == (1, 3.25, 5.5, 7.75, 10)
    assert "median" not in S.percentile_summary(df, "x", (0.1, 0.25)).columns


def test_bundle_round_trip(spark, tmp_path):
    cube = example_cube(spark)
    folder = f"file://{tmp_path}"
    export_bundle(cube, folder)
    genes = spark.createDataFrame([("chr1", 1, 10**9, "G")], "chrom string, start int, end int, gene_name string")
    back = import_bundle(spark, folder, genes, f"{folder}/filtered_contig_annotations.csv", f"{folder}/{DONORS}")
    total = lambda c: c.counts.agg(F.sum("ref_count"), F.sum("alt_count"), F.sum("oth_count")).first()
    assert total(back) == total(cube) and back.shape() == cube.shape() and back.chr_style == "ucsc"
    assert {(r.barcode, r.donor, r.clonotype) for r in back.cell_dim.collect()} == {(r.barcode, r.donor, r.clonotype) for r in cube.cell_dim.collect()}


def test_cell_annotations(spark):
    donors = spark.createDataFrame([("CELL1", "d1"), ("CELL2", "d2"), ("CELL3", "d3")], "cell string, donor_id string")
    vdj = spark.createDataFrame([("CELL1", "t1", "a"), ("CELL2", "t2", "b"), ("CELL4", "t4", "c")], "barcode string, raw_clonotype_id string, other string")
    got = {r.barcode: r.clonotype for r in merge_cell_annotations(donors, vdj).collect()}
    assert got == {"CELL1": "t1", "CELL2": "t2", "CELL3": None}


def simulated(spark, genes=20, cells=80, depth=20):
    rng = np.random.default_rng(3)
    phase, group = rng.integers(0, 2, genes), np.repeat([0, 1], cells // 2)
    p = np.where(phase[:, None] == group, 0.05, 0.95)
    ref = rng.binomial(depth, p)
    snps = spark.createDataFrame([("X", 1000 * (i + 1), "A", "G", f"g{i}") for i in range(genes)], "chrom string, pos int, ref string, alt string, gene_name string")
    frame = spark.createDataFrame([(f"c{j:02d}", f"b{j}", "donor0", f"t{group[j]}_{j // 4}") for j in range(cells)], "cell_id string, barcode string, donor string, clonotype string")
    return AlleleCube.from_arrays(spark, ref, depth - ref, snps, frame), group


def test_inactive_x(spark):
    cube, group = simulated(spark)
    fitted = X.assign_inactive_x(cube, n_inits=4)
    rows = X.xci_assignments(fitted).orderBy("cell_id").collect()
    label = np.array([r.inactive_x == "X1" for r in rows])
    agree = (label == group).mean()
    assert max(agree, 1 - agree) > 0.9
    h = X.xci_haplotypes(fitted).collect()
    assert h and all(0 < r.escape_fraction < 0.5 and r.allele_on_x1 in ("REF", "ALT") for r in h)
    assert X.heatmap_frame(fitted, "donor0", max_genes=3).select("gene").distinct().count() == 3
    assert X.assign_inactive_x_by_clonotype(cube, n_inits=2).cell_dim.filter("inactive_x is not null").count() == 80


@pytest.mark.parametrize("name", ["xci_assignments", "xci_haplotypes", "heatmap_frame"])
def test_registered_fits_use_every_restart(spark, monkeypatch, name):
    tried, fit = [], X.fit
    monkeypatch.setattr(X, "fit", lambda cube, by, n_inits, *how: tried.append(n_inits) or fit(cube, by, n_inits, *how))
    xci_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert tried == [10]


def test_log_gamma():
    x = np.concatenate([np.linspace(0.001, 40, 5000), [1e3, 1e6]])
    assert np.allclose(K.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("by, refit", [("cell", False), ("clonotype", False), ("cell", True)])
def test_spread_fit_is_the_plain_one(spark, monkeypatch, by, refit):
    """Two donors, odd genes and many partitions against a fit of each donor at once."""
    if refit:
        monkeypatch.setattr(K, "MOST_BYTES", 0)
        monkeypatch.setattr(K, "MOST_ENTRIES", 40)
        monkeypatch.setattr(X, "MOST_STATE", 1)
    rng = np.random.default_rng(7)
    genes, cells = 24, 120
    phase, group, escape = rng.integers(0, 2, genes), rng.integers(0, 2, cells), np.where(np.arange(genes) % 8 == 0, 0.4, 0.06)
    p = np.where(phase[:, None] == group, escape[:, None], 1 - escape[:, None])
    depth = rng.poisson(6, (genes, cells))
    ref = rng.binomial(depth, p)
    snps = spark.createDataFrame([("X", 1000 * (i + 1), "A", "G", f"g{i}") for i in range(genes)], "chrom string, pos int, ref string, alt string, gene_name string")
    frame = spark.createDataFrame([(f"c{j:03d}", f"d{j % 2}", f"t{group[j]}{j % 2}_{j // 6}") for j in range(cells)], "cell_id string, donor string, clonotype string").repartition(7)
    cube = AlleleCube.from_arrays(spark, ref, depth - ref, snps, numbered(frame, by="cell_id"))
    got = X.fit(cube, by, 3, 0.95, refit).toPandas()
    entries = X._entries(cube, X.informative_snps(cube), by).toPandas().sort_values(["unit", "snp_id"])
    assert len(got) > 40 and got.donor.nunique() == 2
    for donor, rows in entries.groupby("donor"):
        units, u = np.unique(rows["unit"].to_numpy(str), return_inverse=True)
        names, s = np.unique(rows["snp_id"].to_numpy(str), return_inverse=True)
        want = plain_xci.infer(s, u, rows["ref_count"].to_numpy(np.int64), rows["alt_count"].to_numpy(np.int64), len(names), len(units), names.tolist(), 3, 0.95, refit)
        mine = got[got.donor == donor]
        a, b = mine[mine.kind == "unit"].set_index("name"), mine[mine.kind == "snp"].set_index("name")
        assert sorted(a.index) == sorted(units[want["unit"]]) and sorted(b.index) == sorted(names[want["gene"]])
        assert np.allclose(a.loc[units[want["unit"]]].post, want["post"], atol=1e-6) and a.loc[units[want["unit"]]].label.tolist() == want["label"].tolist()
        assert b.loc[names[want["gene"]]].label.tolist() == want["phase"].tolist() and np.allclose(b.loc[names[want["gene"]]].post, want["escape"], atol=1e-6)



def test_streaming_sums(spark, tmp_path):
    from allelix.streaming.counts import running_group_counts

    cube = example_cube(spark)
    cube.counts.write.parquet(str(tmp_path / "in"))
    q = running_group_counts(spark, str(tmp_path / "in"), cube.cell_dim, "donor").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.snp_id, r.donor): r.ref_count for r in A.group_sums(cube, A.groups_of(cube, "donor"), "donor").collect()}
    assert {(r.snp_id, r.donor): r.ref_count for r in spark.table("sums").collect()} == want


def test_log_preview_and_positions(spark, caplog):
    cube = two(spark)
    with caplog.at_level("INFO", logger="allelix.operators.filters"):
        R.filter_snps(cube, "coverage > 17")
    assert "1 of 2 SNPs removed (50.0%)" in caplog.text
    assert [r.snp_id for r in cube.preview(1)["snps"].collect()] == ["snp_1"] and cube.preview(1)["cells"].first().library_size == 14
    assert [r.snp_id for r in cube.subset(snps=[2]).snp_dim.collect()] == ["snp_2"]
    assert cube.subset(cells=[False, True]).cell_ids() == ["cell_2"] and cube.subset(snps=["snp_1"]).snp_ids() == ["snp_1"]


def test_numbers_stay(spark):
    """Made-up ids are the same in every later frame, also of shuffled rows."""
    rows = spark.range(1000).repartition(13).withColumn("v", F.rand())
    made = assign_cell_ids(numbered(rows))
    assert made.collect() == made.collect() and sorted(r._ord for r in made.collect()) == list(range(1, 1001))
    by = numbered(rows, by="id").collect()
    assert all(r._ord == r.id + 1 for r in by)


def test_adjusted_ties_and_families(spark):
    rng = np.random.default_rng(1)
    rows = [(int(f), float(p)) for f in range(3) for p in np.round(rng.random(300) ** 3, 2)] + [(0, None), (4, 1.0)] + [(0, 1.0)] * 500
    got = S.bh_adjust(spark.createDataFrame(rows, "f int, p_val double"), within=("f",)).toPandas()
    for f, part in got.groupby("f"):
        known = part[part.p_val.notna()].sort_values("p_val", kind="stable")
        n = len(known)
        q = np.minimum.accumulate((known.p_val * n / np.arange(1, n + 1))[::-1])[::-1].clip(upper=1)
        assert np.allclose(known.adj_p_val, q) and part[part.p_val.isna()].adj_p_val.isna().all()


def test_mouse_names():
    assert style_of(["CM001013.2"]) == "genbank_mouse" and style_of(["NC_000086.7", "NC_000067.6"]) == "refseq_mouse"


def watched(spark, cube):
    """The cube, and the number of rows of its counts that were worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return AlleleCube(cube.counts.mapInArrow(look, cube.counts.schema), cube.snp_dim, cube.cell_dim, cube.chr_style), seen


@pytest.mark.parametrize("by", ["cell", "clonotype"])
def test_the_fit_works_the_counts_out_once(spark, by):
    cube, _ = simulated(spark)
    n, (cube, seen) = cube.counts.count(), watched(spark, cube)
    X.fit(cube, by, n_inits=2)
    assert seen.value == n


@pytest.mark.parametrize("by", ["cell", "clonotype"])
def test_the_fit_knows_how_few_snps_units_are_joined_with(spark, monkeypatch, by):
    plans, join = [], X._informative_entries
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "_informative_entries", lambda units, snps: plans.append((plan(snps), plan(join(units, snps)))) or join(units, snps))
    X.fit(simulated(spark)[0], by, n_inits=2)
    (snps, entries), = plans
    assert "Exchange" not in snps and "BroadcastHashJoin" in entries and "hashpartitioning" not in entries


def test_the_heatmap_works_the_counts_out_once(spark):
    cube, _ = simulated(spark)
    cells = cube.cell_dim.withColumns({"inactive_x": F.lit("X1"), "xci_post_X1": F.lit(1.0)})
    snps = cube.snp_dim.withColumns({"xci_informative": F.lit(True), "xci_informative_donor": F.lit("donor0")})
    n, (cube, seen) = cube.counts.count(), watched(spark, AlleleCube(cube.counts, snps, cells, cube.chr_style))
    assert X.heatmap_frame(cube, "donor0").count() == n == seen.value


def test_a_bundle_is_made_of_counts_worked_out_once(spark, tmp_path):
    cube = example_cube(spark)
    n, (watching, seen) = cube.counts.count(), watched(spark, cube)
    export_bundle(watching, str(tmp_path / "b"))
    assert seen.value == n
    genes = spark.createDataFrame([("chr1", 1, 10, "G")], "chrom string, start int, end int, gene_name string")
    back = import_bundle(spark, str(tmp_path / "b"), genes, donors=str(tmp_path / "b" / DONORS))
    assert not any(f.endswith(".mtx") for f in back.counts.inputFiles())  # the matrices were put together once
    assert back.counts.agg(*(F.sum(c) for c in ("ref_count", "alt_count", "oth_count"))).first() == cube.counts.agg(*(F.sum(c) for c in ("ref_count", "alt_count", "oth_count"))).first()


@pytest.mark.parametrize("key", ["cell_id", "barcode"])
def test_merging_deals_counts_out_once_and_does_not_sort_them(spark, key):
    x, y = two(spark), two(spark)
    if key == "barcode":
        x, y = (AlleleCube(c.counts, c.snp_dim, c.cell_dim.withColumn("barcode", F.concat(F.lit("b"), "cell_id"))) for c in (x, y))
    merged = merge_cubes(x, y)
    plan = merged.counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == (1 if key == "cell_id" else 2) and "SortMergeJoin" not in plan
    assert not re.search(r"hashpartitioning\(snp_id#\d+, cell_id", plan)  # by cell alone
    assert sorted(r.ref_count for r in merged.counts.collect()) == [10, 12, 14, 16]


@pytest.mark.parametrize("key", ["cell_id", "barcode"])
def test_counts_to_be_added_up_stay_in_all_partitions(spark, key):
    """Adaptive execution would make one task of these few rows, and of many rows tasks whose tables are over ten times their compressed size."""
    x, y = two(spark), two(spark)
    if key == "barcode":
        x, y = (AlleleCube(c.counts, c.snp_dim, c.cell_dim.withColumn("barcode", F.concat(F.lit("b"), "cell_id"))) for c in (x, y))
    assert merge_cubes(x, y).counts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_merging_moves_counts_dealt_out_by_cell_no_more_than_it_must(spark):
    """Lines are dealt out once for each cube; after that only new cell ids move counts, and rows on the way hold what ids are made of."""
    plans = {n: queries.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("merge_union_union", "merge_by_barcode")}
    deals = {n: re.findall(r"Exchange hashpartitioning\((.*), \d+\), REPARTITION_BY_NUM", p) for n, p in plans.items()}
    assert [len(d) for d in deals.values()] == [2, 3]
    assert all("o_custkey" in d or "cast(_cell" in d for ds in deals.values() for d in ds)
    assert len(re.findall(r"Exchange hashpartitioning\(_old", plans["merge_by_barcode"])) == 2  # the two tables of cells, not the counts


def test_the_first_cell_of_a_barcode_is_merged(spark):
    def cube(cells):
        rows = [("snpA", c[0], 1, 2, 0) for c in cells]
        counts = spark.createDataFrame(rows, "snp_id string, cell_id string, ref_count long, alt_count long, oth_count long")
        return AlleleCube.from_frames(counts, spark.createDataFrame([("snpA", 1)], "snp_id string, _ord long"), spark.createDataFrame(cells, "cell_id string, barcode string, donor string, _ord long"))

    m = merge_cubes(cube([("a", "B1", "late", 9), ("b", "B1", "early", 2), ("c", None, "none", 3)]), cube([("d", "B1", "y", 1), ("e", "B2", "y", 2)]))
    assert [(r.cell_id, r.barcode, r.donor) for r in m.cell_dim.orderBy("_ord").collect()] == [("cell_1", "B1", "early"), ("cell_2", "B2", "y")]
    assert sorted((r.cell_id, r.ref_count, r.alt_count) for r in m.counts.collect()) == [("cell_1", 3, 6), ("cell_2", 1, 2)]
