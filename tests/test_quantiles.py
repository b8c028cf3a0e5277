"""Percentiles by ranges, kernel densities, subsets by frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.model import AlleleCube
from allelix.operators import stats as S
from allelix.operators.quantiles import quantiles
from allelix.plans.density import bandwidth, density


@pytest.mark.parametrize("ranges", [1, 2, 7, 256])
def test_quantiles_by_ranges(spark, ranges):
    rng = random.Random(ranges)
    for n, values in ((1, [3.5]), (2, [1.0, 2.0]), (300, [rng.choice((0.0, 1.0, 1.0, rng.gauss(0, 1e6), -7.25)) for _ in range(300)]), (400, [5.0] * 400)):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
        at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
        assert quantiles(df, "x", at, ranges) == pytest.approx(np.quantile(values, at).tolist(), rel=1e-12), n


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert quantiles(none, "x", (0.0, 0.5)) == [None, None]
    assert S.percentile_summary(none, "x").first() == (None,) * 9


def test_percentile_summary_holds_no_percentile_aggregate(spark):
    out = S.percentile_summary(spark.range(1000), "id")
    assert out.columns == ["min", "p10", "p25", "median", "p75", "p90", "p95", "p99", "max"]
    assert "ercentile" not in out._jdf.queryExecution().toString().replace("percentile_summary", "")


def direct(values, points):
    v = np.array(values)
    h = bandwidth(len(v), v.std(ddof=1), tuple(np.quantile(v, (0.25, 0.75))), v.min())
    x = np.linspace(v.min(), v.max(), points)
    return x, np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("bins, off", [(1 << 16, 1e-9), (2000, 1e-4)])
def test_densities_against_the_direct_sum(spark, bins, off):
    rng = random.Random(5)
    values = [rng.gauss(rng.choice((0, 10)), 1) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    got = density(df, "x", points=100, bins=bins).orderBy("point").collect()
    x, want = direct(values, 100)
    assert np.allclose([r.x for r in got], x) and np.abs(np.array([r.density for r in got]) - want).max() < off


def test_densities_of_logarithms_and_of_few_values(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 10, 10, 1000)], "x int")
    got = density(df, "x", points=7, log10=True).orderBy("point").collect()
    assert np.allclose([r.density for r in got], direct([0, 1, 1, 3], 7)[1])
    assert density(df.limit(0), "x").count() == density(df.filter("x = 1"), "x").count() == 0
    same = density(spark.createDataFrame([(4.0,)] * 3, "x double"), "x", points=3).collect()
    assert {r.x for r in same} == {4.0} and len(same) == 3 and bandwidth(3, 0.0, (4.0, 4.0), 4.0) == pytest.approx(3.6 * 3**-0.2)


def test_subsets_by_frames_ranges_and_arrays(spark):
    n, m = 30, 8
    snps = spark.createDataFrame([(f"s{i}", i) for i in range(1, n + 1)], "snp_id string, pos int")
    cells = spark.createDataFrame([(f"c{j}",) for j in range(1, m + 1)], "cell_id string")
    cube = AlleleCube.from_arrays(spark, np.ones((n, m), int), np.ones((n, m), int), snps, cells)
    names = lambda c: c.snp_ids()
    want = [f"s{i}" for i in range(3, 20, 4)]
    for x in (range(3, 20, 4), list(range(3, 20, 4)), np.arange(3, 20, 4), spark.range(3, 20, 4).toDF("position"), snps.filter("pos >= 3 and pos < 20 and pos % 4 = 3"), want, np.array([3 <= i < 20 and i % 4 == 3 for i in range(1, n + 1)]), range(19, 2, -4)):
        part = cube.subset(x)
        assert names(part) == want and part.counts.count() == len(want) * m
    again = cube.subset(range(11, 31)).subset(range(1, 3), [True, False] * 4)  # positions within what is left
    assert names(again) == ["s11", "s12"] and list(again.each_cell_id()) == ["c1", "c3", "c5", "c7"]
    assert names(cube.subset([])) == [] and names(cube.subset(range(0))) == [] and names(cube.subset([99])) == []
    with pytest.raises(ValueError, match="booleans"):
        cube.subset([True, False])
    with pytest.raises(ValueError, match="position"):
        cube.subset(cells)


def test_a_subset_of_very_many_positions(spark):
    """Ten million positions, as a range and as a frame, without a list of them."""
    n = 10_000_000
    k = F.col("id")
    snps = spark.range(1, n + 1).select(F.concat(F.lit("s"), k).alias("snp_id"), k.alias("_ord"))
    counts = snps.filter(k % 1000 == 0).select("snp_id", F.lit("c1").alias("cell_id"), *(F.lit(1).alias(c) for c in ("ref_count", "alt_count", "oth_count")))
    cube = AlleleCube(counts, snps, spark.createDataFrame([("c1", 1)], "cell_id string, _ord long"))
    assert cube.subset(range(1, n + 1, 2)).snp_dim.count() == n // 2


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from allelix.tables import scratch, shared_dir, stored, written

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch(spark):
        inner = written(spark.range(10), "inner")
        with scratch(spark):
            written(inner, "deeper")
        assert len(set(os.listdir(folder)) - before) == 1
        kept = stored(inner.selectExpr("id * 2 as x"), f"file://{folder}/kept-{len(before)}")
    assert {n for n in set(os.listdir(folder)) - before} == {f"kept-{len(before)}"} and kept.count() == 10
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(spark.range(3), "lost")
        raise ZeroDivisionError
    assert not any(n.startswith("lost") for n in os.listdir(folder))
    with scratch(spark):
        out = stored(S.percentile_summary(spark.range(100), "id"), f"file://{folder}/summary-{len(before)}")
    assert out.first()["max"] == 99.0
