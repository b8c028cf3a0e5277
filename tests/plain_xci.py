"""Beta-binomial expectation maximisation for one donor's X-inactivation, in numpy.

Each unit (cell or clonotype) has one of two X chromosomes inactive; each gene has a phase h (whether the alternate
allele lies on X1) and an escape fraction pi, the share of reads from the inactive chromosome. Given phase and
inactive X, the reference count is beta-binomial with mean pi or 1 - pi and fixed overdispersion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from allelix.functions.binomial import log_beta
from allelix.operators.xci_kernel import first_phase

RHO, PI_START, PI_LOW, PI_HIGH = 0.05, 0.05, 0.001, 0.499


@dataclass
class Data:
    """Covered entries: gene and unit numbers, reference count, depth; and the distinct (ref, n, gene)."""

    gene: np.ndarray
    unit: np.ndarray
    ref: np.ndarray
    n: np.ndarray
    genes: int
    units: int

    def __post_init__(self):
        rows = np.stack([self.ref, self.n, self.gene], 1)
        self.distinct, self.index = np.unique(rows, axis=0, return_inverse=True)
        self.index = self.index.reshape(-1)


def log_kernel(ref: np.ndarray, n: np.ndarray, p: np.ndarray, rho: float = RHO) -> np.ndarray:
    """Beta-binomial log likelihood without the binomial coefficient, which cancels in every comparison."""
    a, b = p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho
    return log_beta(ref + a, n - ref + b) - log_beta(a, b)


def both(d: Data, pi: np.ndarray, rho: float = RHO) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods with the reference allele on the inactive and on the active X, from distinct arguments."""
    ref, n, g = d.distinct.T
    return log_kernel(ref, n, pi[g], rho)[d.index], log_kernel(ref, n, 1 - pi[g], rho)[d.index]


def e_step(d: Data, h: np.ndarray, ll: tuple[np.ndarray, np.ndarray], prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    sign = np.where(h[d.gene] == 0, 1.0, -1.0)
    odds = np.bincount(d.unit, sign * (ll[0] - ll[1]), d.units) + np.log(prior / (1 - prior))
    return sigmoid(odds), odds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def phase_step(d: Data, post: np.ndarray, h: np.ndarray, ll: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """h = 1 only where it is strictly better; genes without data keep theirs."""
    w = post[d.unit]
    zero = np.bincount(d.gene, w * ll[0] + (1 - w) * ll[1], d.genes)
    one = np.bincount(d.gene, w * ll[1] + (1 - w) * ll[0], d.genes)
    seen = np.bincount(d.gene, minlength=d.genes) > 0
    return np.where(seen, (one > zero).astype(int), h)


def escape_step(d: Data, post: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Share of reads from the inactive chromosome, within bounds."""
    inactive_ref = np.where(h[d.gene] == 0, post[d.unit], 1 - post[d.unit])
    inactive = np.bincount(d.gene, inactive_ref * d.ref + (1 - inactive_ref) * (d.n - d.ref), d.genes)
    total = np.bincount(d.gene, d.n, d.genes)
    return np.where(total > 0, np.clip(inactive / np.maximum(total, 1), PI_LOW, PI_HIGH), PI_START)


def run_em(d: Data, seed: int, snps: list[str], most: int = 50, tolerance: float = 1e-4) -> dict:
    h, pi, last = np.array([first_phase(seed, x) for x in snps]), np.full(d.genes, PI_START), -np.inf
    post = np.full(d.units, 0.5)
    for _ in range(most):
        ll = both(d, pi)
        post, odds = e_step(d, h, ll)
        value = float(-np.logaddexp(0, -odds).sum())
        h = phase_step(d, post, h, ll)
        pi = escape_step(d, post, h)
        if abs(value - last) < tolerance:
            break
        last = value
    return {"post": post, "h": h, "pi": pi, "ll": value}


def gene_evidence(d: Data, fit: dict) -> np.ndarray:
    """Log-likelihood ratio of each gene, weighted by the units' probability of X1."""
    ll = both(d, fit["pi"])
    sign = np.where(fit["h"][d.gene] == 0, 1.0, -1.0)
    return np.bincount(d.gene, fit["post"][d.unit] * sign * (ll[0] - ll[1]), d.genes)


def ordinary_genes(ref: np.ndarray, alt: np.ndarray, gene: np.ndarray, genes: int, min_units: int = 10, min_cov: int = 1, threshold: float = 2.0) -> np.ndarray:
    """Genes covered in enough units whose skew is within `threshold` robust deviations of the median."""
    c = ref + alt >= min_cov
    covered = np.bincount(gene[c], minlength=genes)
    up = np.bincount(gene[c], ref[c] > alt[c], genes)
    enough = covered >= min_units
    if not enough.any():
        raise ValueError("insufficient data: no gene is covered in enough units")
    s = up / np.maximum(covered, 1)
    s = np.maximum(s, 1 - s)
    middle = np.median(s[enough])
    spread = 1.4826 * np.median(np.abs(s[enough] - middle))
    return enough & ((np.abs(s - middle) / spread <= threshold) if spread > 0 else True)


def kept_genes(d: Data, fit: dict, threshold: float = 2.0) -> np.ndarray:
    """Genes that speak for the assignment and do not escape more than usual."""
    middle = np.median(fit["pi"])
    spread = 1.4826 * np.median(np.abs(fit["pi"] - middle))
    usual = (fit["pi"] - middle) / spread <= threshold if spread > 0 else np.ones(d.genes, bool)
    return (gene_evidence(d, fit) > 0) & usual


def infer(gene: np.ndarray, unit: np.ndarray, ref: np.ndarray, alt: np.ndarray, genes: int, units: int, snps: list[str], n_inits: int = 10, confidence: float = 0.95, refit: bool = False) -> dict:
    """Assignments of units and haplotypes of genes; gene numbers are the given ones."""
    good = ordinary_genes(ref, alt, gene, genes)
    number = np.cumsum(good) - 1
    some = good[gene] & (ref + alt >= 1)
    names = np.flatnonzero(good)
    d = Data(number[gene[some]], unit[some], ref[some], (ref + alt)[some], len(names), units)
    fit = max((run_em(d, s, [snps[k] for k in names]) for s in range(1, n_inits + 1)), key=lambda f: f["ll"])  # the first of equal ones
    keep = kept_genes(d, fit)
    if refit and keep.any() and not keep.all():
        again = np.cumsum(keep) - 1
        s = keep[d.gene]
        d2 = Data(again[d.gene[s]], d.unit[s], d.ref[s], d.n[s], int(keep.sum()), units)
        fit = max((run_em(d2, s, [snps[k] for k in names[keep]]) for s in range(1, n_inits + 1)), key=lambda f: f["ll"])
        names, keep = names[keep], np.ones(int(keep.sum()), bool)
    seen = np.bincount(unit[some], minlength=units) > 0
    label = np.where(fit["post"] >= confidence, "X1", np.where(fit["post"] <= 1 - confidence, "X2", "unassigned")).astype(object)
    return {"unit": np.arange(units)[seen], "post": fit["post"][seen], "label": label[seen], "gene": names[keep], "phase": np.where(fit["h"][keep] == 0, "REF", "ALT"), "escape": fit["pi"][keep]}
