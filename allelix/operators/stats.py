"""Minor-allele tests, Benjamini-Hochberg adjustment and heterozygosity calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.binomial import binom_column
from allelix.functions.scalars import smaller
from allelix.model import AlleleCube
from allelix.operators.quantiles import quantiles
from allelix.tables import written


def bh_adjust(df: DataFrame, p: str = "p_val", weight: str | None = None, within: tuple[str, ...] = (), out: str = "adj_p_val", buckets: int = 64) -> DataFrame:
    """df with Benjamini-Hochberg adjusted p values; null p values stay null and do not count.

    weight: how many tests a row stands for. within: columns that part the tests into families. Equal p values become
    one row first, written once; these are cut into ranges of p, so that ranks and running minima are windows over a
    range, joined by the ranges' own sums and minima.
    """
    keys = list(within)
    distinct = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_n"))
    distinct = written(distinct, "p_values")
    # a row for each family, with as many bounds as ranges
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx(p, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    placed = distinct.join(cuts, keys) if keys else distinct.crossJoin(F.broadcast(cuts))
    placed = placed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(p)))).drop("_cuts")
    family, here = Window.partitionBy(*keys), Window.partitionBy(*keys, "_range")
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_in").over(family.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_in").over(family)}).drop("_in")
    ranked = placed.join(sums, [*keys, "_range"]).withColumn("_rank", F.col("_before") + F.sum("_n").over(here.orderBy(p)))
    ranked = ranked.withColumn("_q", F.col("_all") * F.col(p) / F.col("_rank")).select(*keys, p, "_range", "_q")
    low = ranked.groupBy(*keys, "_range").agg(F.min("_q").alias("_least"))
    low = low.withColumn("_later", F.min("_least").over(family.orderBy("_range").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    done = ranked.join(low, [*keys, "_range"]).withColumn("_q", F.min("_q").over(here.orderBy(F.desc(p))))
    done = done.select(*keys, p, F.least(F.lit(1.0), "_q", F.coalesce("_later", F.lit(1.0))).alias(out))
    return df.drop(out).join(done, [*keys, p], "left").select(*[c for c in df.columns if c != out], out)


def check_counts(df: DataFrame) -> None:
    """Errors name up to five rows by their position."""
    missing = {"ref_count", "alt_count", "total_count"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    negative = (F.col("ref_count") < 0) | (F.col("alt_count") < 0) | (F.col("total_count") < 0)
    over = F.col("ref_count") + F.col("alt_count") > F.col("total_count")
    for bad, what in ((negative, "negative counts"), (over, "ref_count + alt_count exceeds total_count")):
        if not df.filter(bad).isEmpty():
            rows = df.withColumn("_bad", bad).select("_bad").rdd.zipWithIndex().filter(lambda r: r[0]["_bad"]).map(lambda r: r[1] + 1).take(6)
            raise ValueError(f"{what} in rows {', '.join(map(str, rows[:5]))}{', ...' if len(rows) > 5 else ''}")


def test_maf(df: DataFrame, p: float = 0.10, within: tuple[str, ...] = (), only: str | None = None, check: bool = True) -> DataFrame:
    """df with minor_allele_count, p_val = P(X >= minor) under Binomial(ceil(total), p), and adj_p_val over all rows.

    within: families of the adjustment. only: a boolean column; other rows have null statistics and do not count.
    df is written once, as it is read again for the pairs. The tail is computed once for each distinct pair, and ranks
    come from the pairs' counts.
    """
    if check:
        check_counts(df)
    minor = smaller(F.col("ref_count"), F.col("alt_count"))
    if only:
        minor = F.when(F.col(only), minor)
    df = df.drop("minor_allele_count", "p_val", "adj_p_val").withColumns({"minor_allele_count": minor, "_n": F.ceil("total_count")})
    df = written(df, "counts")
    pairs = df.filter("minor_allele_count is not null and _n is not null").groupBy(*within, "minor_allele_count", "_n").agg(F.count("*").alias("_w"))
    pairs = written(pairs.withColumn("p_val", binom_column(F.col("minor_allele_count"), F.col("_n"), p)), "pairs")
    tested = bh_adjust(pairs, weight="_w", within=within).drop("_w")
    return df.join(tested, [*within, "minor_allele_count", "_n"], "left").select(*[c for c in df.columns if c != "_n"], "p_val", "adj_p_val")


test_maf.__test__ = False


def donor_het_status(cube: AlleleCube, min_total_count: int = 10, p_value_threshold: float = 0.05, minor_allele_prop: float = 0.1, within: tuple[str, ...] = ()) -> DataFrame:
    """Zygosity of each SNP and donor: het, hom, or unknown where depth is below min_total_count.

    Only tested rows enter the adjustment. within=("donor",) adjusts for each donor by itself.
    """
    from allelix.operators.aggregate import donor_counts

    if min_total_count < 0:
        raise ValueError("min_total_count must not be negative")
    if not 0 <= p_value_threshold <= 1 or not 0 <= minor_allele_prop <= 1:
        raise ValueError("p_value_threshold and minor_allele_prop must be between 0 and 1")
    counts = donor_counts(cube, maf_test=False).withColumn("tested", F.col("total_count") >= min_total_count)
    tested = test_maf(counts, minor_allele_prop, within, only="tested", check=False)
    call = F.when(F.col("tested") & (F.col("adj_p_val") < p_value_threshold), "het").when(F.col("tested"), "hom").otherwise("unknown")
    return tested.withColumn("zygosity", call)


def donor_het_cube(cube: AlleleCube, donor: str, **how) -> AlleleCube:
    """A donor's cells and the SNPs that are heterozygous in them, judged on those cells alone."""
    from allelix.operators.filters import filter_cells

    own = filter_cells(cube, F.col("donor") == donor)
    het = donor_het_status(own, **how).filter("zygosity = 'het'")
    if het.isEmpty():
        raise ValueError("No SNPs remain after filtering")
    return own.keep(snps=het)


def percentile_summary(df: DataFrame, column: str, percentiles: tuple[float, ...] = (0.1, 0.25, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: min, pNN (linear interpolation), median before the first percentile over one half, max. The values are looked up at once."""
    names, at = ["min"], [0.0]
    for q in percentiles:
        if q > 0.5 and "median" not in names:
            names.append("median")
            at.append(0.5)
        names.append(f"p{round(q * 100):02d}")
        at.append(q)
    names, at = [*names, "max"], [*at, 1.0]
    return df.sparkSession.createDataFrame([tuple(quantiles(df, column, tuple(at)))], ", ".join(f"`{n}` double" for n in names))


def outlier_genes(units: DataFrame, min_cells: int = 10, min_cov: int = 1, mad_threshold: float = 2.0, within: tuple[str, ...] = ()) -> DataFrame:
    """Genes with enough covered units and an ordinary skew, of a frame (gene, ref_count, alt_count), a row per unit.

    The skew is the larger share of ref-dominated and other units; a gene stays if it lies within mad_threshold robust
    deviations of the median. Columns: gene, covered, skew, z, keep.
    """
    covered = units.filter(F.col("ref_count") + F.col("alt_count") >= min_cov)
    genes = covered.groupBy(*within, "gene").agg(F.count("*").alias("covered"), F.count_if(F.col("ref_count") > F.col("alt_count")).alias("_up"))
    s = F.col("_up") / F.col("covered")
    genes = genes.filter(F.col("covered") >= min_cells).withColumn("skew", F.greatest(s, 1 - s)).drop("_up")
    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, list(within)) if within else a.crossJoin(F.broadcast(b))  # one row

    with_median = joined(genes, genes.groupBy(*within).agg(F.percentile("skew", 0.5).alias("_mid")))
    spread = with_median.groupBy(*within).agg((1.4826 * F.percentile(F.abs(F.col("skew") - F.col("_mid")), 0.5)).alias("_mad"))
    z = F.when(F.col("_mad") > 0, (F.col("skew") - F.col("_mid")) / F.col("_mad")).otherwise(0.0)
    return joined(with_median, spread).withColumn("z", z).withColumn("keep", F.abs("z") <= mad_threshold).drop("_mid", "_mad")
