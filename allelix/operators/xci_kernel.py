"""Beta-binomial expectation maximisation for X-inactivation, over units spread across tasks.

Each unit (cell or clonotype) has one of two X chromosomes inactive; each gene has a phase h (whether the alternate
allele lies on X1) and an escape fraction pi, the share of reads from the inactive chromosome. Given phase and
inactive X, the reference count is beta-binomial with mean pi or 1 - pi and fixed overdispersion.

Units are packed into blocks, a row each, whose entries point into the block's own dictionary of distinct (gene,
reference count, depth): likelihoods are worked out once for each of these. The state of a donor is a pair of arrays (restarts x genes), as many
numbers as genes on one chromosome, and travels to the tasks; a round adds up what each task finds for all restarts at
once, by donor, and the driver makes the next state of it. So no task holds a donor's units together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RHO, PI_START, PI_LOW, PI_HIGH = 0.05, 0.05, 0.001, 0.499
UNIT = "donor int, unit string, genes array<int>, refs array<int>, depths array<int>"
#: A block: names of its units and their numbers of entries, each entry's place in the dictionary, and that.
PACKED = "donor int, units array<string>, sizes array<int>, codes array<int>, genes array<int>, refs array<int>, depths array<int>"
MOST_ENTRIES = 1 << 18  # of a block, unless a single unit has more
MOST_BYTES = 32 << 20  # of sums that tasks send to the driver
SUMS = "donor int, sums binary, value binary"


@dataclass
class State:
    """Of one donor: phases and escape fractions (restarts x genes), and which restarts still change."""

    h: np.ndarray
    pi: np.ndarray
    live: np.ndarray

    @staticmethod
    def start(genes: list[str], seeds: list[int]) -> State:
        h = np.array([[first_phase(s, g) for g in genes] for s in seeds], int).reshape(len(seeds), len(genes))
        return State(h, np.full(h.shape, PI_START), np.ones(len(seeds), bool))


def first_phase(seed: int, gene: str) -> int:
    """The phase that a restart begins with: the last bit of the first byte of a hash of seed and SNP."""
    return hashlib.md5(f"{seed}:{gene}".encode()).digest()[0] & 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after the argument was raised by eight; relative error about 1e-15."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * (691 / 360360 - z / 156)))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kernel(ref: np.ndarray, n: np.ndarray, p: np.ndarray, rho: float = RHO) -> np.ndarray:
    """Beta-binomial log likelihood without the binomial coefficient, which cancels in every comparison."""
    a, b = p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho
    whole = (1 - rho) / rho
    return log_gamma(ref + a) + log_gamma(n - ref + b) - log_gamma(n + whole) - log_gamma(a) - log_gamma(b) + log_gamma(np.full(1, whole))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the units of each donor in a batch of rows (donor, unit, genes, refs, depths)."""
    for batch in batches:
        donors = batch.column("donor").to_numpy()
        for d in np.unique(donors):
            own = batch.filter(pa.array(donors == d))
            sizes = np.diff(own.column("genes").offsets.to_numpy())
            upto, at = np.cumsum(sizes), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MOST_ENTRIES, "right")))
                some = own.slice(at, to - at)
                entries = np.stack([some.column(c).flatten().to_numpy() for c in ("genes", "refs", "depths")], 1)
                distinct, codes = np.unique(entries, axis=0, return_inverse=True)
                lists = (some.column("unit").to_pylist(), sizes[at:to], codes.reshape(-1), *distinct.T)
                kinds = (pa.string(), *(pa.int32(),) * 5)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds, strict=True))], ["donor", "units", "sizes", "codes", "genes", "refs", "depths"])
                at = to


@dataclass
class Units:
    """A block of one donor's units: of each entry its unit and place among the distinct ones; of those gene, reference count and depth."""

    unit: np.ndarray
    code: np.ndarray
    gene_of: np.ndarray
    ref_of: np.ndarray
    n_of: np.ndarray
    units: int

    def __post_init__(self):
        self.gene, self.ref, self.n = (x[self.code] for x in (self.gene_of, self.ref_of, self.n_of))

    @staticmethod
    def of(block: dict[str, np.ndarray]) -> Units:
        sizes = block["sizes"]
        return Units(np.repeat(np.arange(len(sizes)), sizes), block["codes"], *(block[c].astype(np.int64) for c in ("genes", "refs", "depths")), len(sizes))

    def expectation(self, h: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, ...]:
        """For one state: log likelihoods with the reference allele on the inactive and the active X, of entries; log odds of X1, of units."""
        p = pi[self.gene_of]
        inactive, active = log_kernel(self.ref_of, self.n_of, p), log_kernel(self.ref_of, self.n_of, 1 - p)
        contrast = np.where(h[self.gene_of] == 0, inactive - active, active - inactive)
        return inactive[self.code], active[self.code], np.bincount(self.unit, contrast[self.code], self.units)

    def sums(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        """What the next state is made of: (restarts x 5 x genes) evidence for both phases, reads by the first phase, reads, entries; and log likelihoods."""
        genes = state.h.shape[1]
        out, value = np.zeros((len(state.h), 5, genes)), np.zeros(len(state.h))
        for k in np.flatnonzero(state.live):
            inactive, active, odds = self.expectation(state.h[k], state.pi[k])
            value[k] = -np.logaddexp(0, -odds).sum()
            w = sigmoid(odds)[self.unit]
            per = (w * inactive + (1 - w) * active, w * active + (1 - w) * inactive, w * self.ref + (1 - w) * (self.n - self.ref), self.n, np.ones(len(w)))
            out[k] = [np.bincount(self.gene, x, genes) for x in per]
        return out, value

    def evidence(self, h: np.ndarray, pi: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each gene, weighted by the units' probability of X1."""
        inactive, active, _ = self.expectation(h, pi)
        sign = np.where(h[self.gene] == 0, 1.0, -1.0)
        return np.bincount(self.gene, sigmoid(odds)[self.unit] * sign * (inactive - active), len(h))


def by_donor(batches: Iterator[pa.RecordBatch], only) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each block's donor and columns, of the donors asked for."""
    for batch in batches:
        for i, d in enumerate(batch.column("donor").to_pylist()):
            if d in only:
                yield d, {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("units", "sizes", "codes", "genes", "refs", "depths")}


def added_up(packed: DataFrame, work, shapes: dict[int, tuple[tuple[int, ...], int]], tasks: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By donor, the sums over all its units of work(donor, units): two arrays.

    Tasks add up what they see. What they send meets by donor before it comes to the driver, unless it is little.
    """

    def total(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for d, a, b in rows:
            if d in found:
                found[d][0] += a
                found[d][1] += b
            else:
                found[d] = [a.copy(), b.copy()]
        for d, (a, b) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["donor", "sums", "value"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row["donor"], np.frombuffer(row["sums"]), np.frombuffer(row["value"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total((d, *work(d, Units.of(some))) for d, some in by_donor(batches, shapes))

    parts = packed.mapInArrow(each, SUMS)
    size = 8 * sum(int(np.prod(a)) + b for a, b in shapes.values())
    if size * (tasks or packed.rdd.getNumPartitions()) > MOST_BYTES:
        parts = parts.repartition("donor").mapInArrow(lambda batches: total(read(batches)), SUMS)
    rows = total((r["donor"], np.frombuffer(r["sums"]), np.frombuffer(r["value"])) for r in parts.collect())
    out = {}
    for r in (x for batch in rows for x in batch.to_pylist()):
        a, b = shapes[r["donor"]]
        out[r["donor"]] = np.frombuffer(r["sums"]).reshape(a), np.frombuffer(r["value"]).reshape(b)
    return out


def run_em(packed: DataFrame, names: dict[int, list[str]], n_inits: int, most: int = 50, tolerance: float = 1e-4) -> dict[int, dict]:
    """By donor the best of n_inits restarts: h and pi, those that its posteriors were made with, and the likelihood.

    names: the genes' SNPs by donor. A restart ends when its likelihood stays, and the first of equal ones is taken.
    """
    genes, tasks = {d: len(x) for d, x in names.items()}, packed.rdd.getNumPartitions()
    now = {d: State.start(x, list(range(1, n_inits + 1))) for d, x in names.items()}
    used = {d: (s.h, s.pi) for d, s in now.items()}
    last = {d: np.full(n_inits, -np.inf) for d in genes}
    for _ in range(most):
        live = {d: s for d, s in now.items() if s.live.any()}
        if not live:
            break
        found = added_up(packed, lambda d, units, live=live: units.sums(live[d]), {d: ((n_inits, 5, genes[d]), n_inits) for d in live}, tasks)
        for d, (sums, value) in found.items():
            s = now[d]
            zero, one, first, reads, seen = (sums[:, i] for i in range(5))
            on = s.live[:, None]
            # h = 1 only where it is strictly better; genes without entries keep theirs
            h = np.where(on & (seen > 0), (one > zero).astype(int), s.h)
            inactive = np.where(h == 0, first, reads - first)
            pi = np.where(on, np.where(reads > 0, np.clip(inactive / np.maximum(reads, 1), PI_LOW, PI_HIGH), PI_START), s.pi)
            used[d] = np.where(on, s.h, used[d][0]), np.where(on, s.pi, used[d][1])
            done = np.abs(value - last[d]) < tolerance
            last[d] = np.where(s.live, value, last[d])
            now[d] = State(h, pi, s.live & ~done)
    best = {d: int(np.argmax(last[d])) for d in genes}
    return {d: {"h": now[d].h[k], "pi": now[d].pi[k], "h_used": used[d][0][k], "pi_used": used[d][1][k], "ll": last[d][k]} for d, k in best.items()}


def gene_evidence(packed: DataFrame, fits: dict[int, dict]) -> dict[int, np.ndarray]:
    def work(d: int, units: Units) -> tuple[np.ndarray, np.ndarray]:
        f = fits[d]
        return units.evidence(f["h"], f["pi"], units.expectation(f["h_used"], f["pi_used"])[2]), np.zeros(1)

    return {d: s for d, (s, _) in added_up(packed, work, {d: ((len(f["h"]),), 1) for d, f in fits.items()}).items()}


def kept_genes(evidence: np.ndarray, pi: np.ndarray, threshold: float = 2.0) -> np.ndarray:
    """Genes that speak for the assignment and do not escape more than usual."""
    middle = np.median(pi)
    spread = 1.4826 * np.median(np.abs(pi - middle))
    usual = (pi - middle) / spread <= threshold if spread > 0 else np.ones(len(pi), bool)
    return (evidence > 0) & usual


def posteriors(packed: DataFrame, fits: dict[int, dict]) -> DataFrame:
    """(donor, unit, post): each unit's probability that X1 is inactive."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, some in by_donor(batches, fits):
            post = sigmoid(Units.of(some).expectation(fits[d]["h_used"], fits[d]["pi_used"])[2])
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(post), pa.int32()), pa.array(some["units"], pa.string()), pa.array(post)], ["donor", "unit", "post"])

    return packed.mapInArrow(judge, "donor int, unit string, post double")
