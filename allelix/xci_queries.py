"""Registered fits of X-inactivation, with the whole expectation maximisation as recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelix.operators import xci as X
from allelix.queries import _BASE, QUERIES, _grouped, _on_x, _query, _tested  # noqa: F401


def _kernel(p: str) -> str:
    """The beta-binomial log likelihood up to what cancels in every comparison."""
    return f"lgamma(r + {p} * 19) + lgamma(n - r + (1 - {p}) * 19)"


def _fitted(unit: str) -> str:
    """CTEs up to the best restart of each donor: post (donor, unit, post) and kept (donor, snp_id, h, pi)."""
    return f"""{_BASE.replace('n_name as donor', 'r_name as donor').replace('with ', 'with recursive ', 1)},
{_grouped('donor')},
g2 as (select *, ref_count + alt_count >= 10 as tested from g),{_tested('g2', keep='tested', family='donor')},
chosen as (select donor, snp_id from (select donor, snp_id, row_number() over (partition by donor, gene_name order by ref_count + alt_count desc, pos) as rk from t join snps using (snp_id) where tested and adj_p_val < 0.05) where rk = 1),
entries as materialized (select donor, {unit} as unit, snp_id, sum(ref_count)::double as r, sum(ref_count + alt_count)::double as n from counts join cells using (cell_id) join chosen using (donor, snp_id) group by 1, 2, 3 having sum(ref_count + alt_count) >= 1),
skews as (select donor, snp_id, greatest(up / covered, 1 - up / covered) as skew from (select donor, snp_id, count(*) as covered, count(*) filter (r > n - r) as up from entries group by 1, 2) where covered >= 10),
middles as (select *, median(skew) over (partition by donor) as mid from skews),
spreads as (select *, 1.4826 * median(abs(skew - mid)) over (partition by donor) as mad from middles),
usual as materialized (select donor, snp_id from spreads where mad = 0 or abs(skew - mid) / mad <= 2),
entry as materialized (select * from entries semi join usual using (donor, snp_id)),
em as (
  select 0 as it, donor, snp_id, seed, ('0x' || md5(seed || ':' || snp_id)[1:2])::int & 1 as h, 0.05::double as pi, '-infinity'::double as ll, true as live from usual, range(1, 11) s(seed)
  union all
  select it + 1, donor, snp_id, seed, h2, least(0.499, greatest(0.001, case when h2 = 0 then first else reads - first end / reads)), now, abs(now - ll) >= 1e-4 and it + 1 < 50
  from (select it, donor, snp_id, seed, any_value(ll) as ll, any_value(now) as now, case when sum(w * b + (1 - w) * a) > sum(w * a + (1 - w) * b) then 1 else 0 end as h2, sum(w * r + (1 - w) * (n - r)) as first, sum(n) as reads
    from (select *, 1 / (1 + exp(-odds)) as w, sum(case when nth = 1 then least(0, odds) - ln(1 + exp(-abs(odds))) else 0 end) over (partition by donor, seed) as now
      from (select *, sum(case when h = 0 then a - b else b - a end) over (partition by donor, seed, unit) as odds, row_number() over (partition by donor, seed, unit) as nth
        from (select it, em.donor, em.snp_id, seed, h, pi, ll, unit, r, n, {_kernel('pi')} as a, {_kernel('(1 - pi)')} as b from em join entry on em.donor = entry.donor and em.snp_id = entry.snp_id where live)))
    group by it, donor, snp_id, seed)),
ends as materialized (select *, max(it) over (partition by donor, seed) as last from em),
best as (select donor, seed from (select donor, seed, row_number() over (partition by donor order by any_value(ll) desc, seed) as rk from ends where it = last group by donor, seed) where rk = 1),
final as materialized (select donor, snp_id, h, pi from ends join best using (donor, seed) where it = last),
used as materialized (select donor, snp_id, h, pi from ends join best using (donor, seed) where it = last - 1),
post as materialized (select donor, unit, 0.5 * (1 + tanh(odds / 2)) as post from (select donor, unit, sum(case when h = 0 then a - b else b - a end) as odds from (select donor, unit, h, {_kernel('pi')} as a, {_kernel('(1 - pi)')} as b from used join entry using (donor, snp_id)) group by 1, 2)),
evidence as (select donor, snp_id, any_value(h) as h, any_value(pi) as pi, sum(post * case when h = 0 then a - b else b - a end) as llr from (select donor, snp_id, unit, h, pi, {_kernel('pi')} as a, {_kernel('(1 - pi)')} as b from final join entry using (donor, snp_id)) join post using (donor, unit) group by 1, 2),
escapes as (select *, median(pi) over (partition by donor) as mid from evidence),
kept as materialized (select donor, snp_id, h, pi from (select *, 1.4826 * median(abs(pi - mid)) over (partition by donor) as mad from escapes) where llr > 0 and (mad = 0 or (pi - mid) / mad <= 2)),
label as (select donor, unit, post, case when post >= 0.95 then 'X1' when post <= 1 - 0.95 then 'X2' end as inactive_x from post)"""


@_query("xci_assignments", f"{_fitted('cell_id')}\nselect cells.cell_id, cells.donor, inactive_x, round(post, 6) as xci_post_X1 from cells left join label on label.donor = cells.donor and unit = cell_id")
def _(spark, d):
    return X.xci_assignments(X.assign_inactive_x(_on_x(spark, d), strict=False)).withColumn("xci_post_X1", F.round("xci_post_X1", 6))


@_query("xci_haplotypes", f"{_fitted('clonotype')}\nselect snp_id, gene_name, case when arg_min(h, donor) = 1 then 'ALT' else 'REF' end as allele_on_x1, round(arg_min(pi, donor), 6) as escape_fraction from kept join snps using (snp_id) group by 1, 2")
def _(spark, d):
    return X.xci_haplotypes(X.assign_inactive_x_by_clonotype(_on_x(spark, d), strict=False)).withColumn("escape_fraction", F.round("escape_fraction", 6))


@_query("heatmap_frame", f"""{_fitted('cell_id')},
e as (select cell_id, gene_name as gene, ref_count / (ref_count + alt_count) as ref_fraction, ref_count + alt_count as depth, inactive_x, post from counts join (select snp_id from kept where donor = 'ASIA') using (snp_id) join snps using (snp_id) join label on unit = cell_id where inactive_x is not null and donor = 'ASIA' and ref_count + alt_count > 0),
q as (select gene, count(*) as covered, abs((sum(case inactive_x when 'X1' then ref_fraction else 0 end) + 2.5) / (count(*) filter (inactive_x = 'X1') + 5) - (sum(case inactive_x when 'X2' then ref_fraction else 0 end) + 2.5) / (count(*) filter (inactive_x = 'X2') + 5)) as discrimination from e group by 1),
o as (select *, row_number() over (order by round(discrimination, 12) desc, gene) as gene_order from q where covered >= 1),
u as (select cell_id, row_number() over (order by round(post, 9) desc, cell_id) as unit_order from (select distinct cell_id, post from e join o using (gene)))
select cell_id, gene, round(ref_fraction, 9) as ref_fraction, cast(depth as bigint) as depth, inactive_x, round(post, 6) as xci_post_X1, unit_order, gene_order, round(discrimination, 9) as discrimination from e join o using (gene) join u using (cell_id)""")
def _(spark, d):
    out = X.heatmap_frame(X.assign_inactive_x(_on_x(spark, d), strict=False), "ASIA")
    return out.withColumns({"ref_fraction": F.round("ref_fraction", 9), "xci_post_X1": F.round("xci_post_X1", 6), "discrimination": F.round("discrimination", 9)})


@_query("xci_snp_columns", f"""{_fitted('cell_id')},
told as (select snp_id, string_agg(donor, ',' order by donor) as donors, case when arg_min(h, donor) = 1 then 'ALT' else 'REF' end as allele, arg_min(pi, donor) as escape from kept group by 1)
select snps.snp_id, told.snp_id is not null as xci_informative, donors as xci_informative_donor, allele as xci_allele_on_x1, round(escape, 6) as xci_escape_fraction from snps left join told on told.snp_id = snps.snp_id""")
def _(spark, d):
    fitted = X.assign_inactive_x(_on_x(spark, d), strict=False)
    return fitted.snp_dim.select("snp_id", *X.XCI_SNP).withColumn("xci_escape_fraction", F.round("xci_escape_fraction", 6))


@_query("xci_cells_by_clonotype", f"{_fitted('clonotype')}\nselect cells.cell_id, cells.clonotype, inactive_x, round(post, 6) as xci_post_X1, case when post is not null then 'clonotype' end as xci_fit_unit from cells left join label on label.donor = cells.donor and unit = clonotype")
def _(spark, d):
    fitted = X.assign_inactive_x_by_clonotype(_on_x(spark, d), strict=False)
    return fitted.cell_dim.select("cell_id", "clonotype", "inactive_x", F.round("xci_post_X1", 6).alias("xci_post_X1"), "xci_fit_unit")
