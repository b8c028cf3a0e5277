"""Embedding near-dedup: inverted lists with product-quantised residuals, table-lookup distances, exact cosine rerank.

A coarse quantiser and the residuals' subspace codebooks are fitted on a bounded sample of unit vectors. Every vector is
indexed: it goes to the list of its nearest centroid, as residual codes and the length of its quantisation error. A
vector probes each list that can hold a neighbour: x within distance r of q is in list j rather than in q's own list i
only if q lies within r of the plane between the two centroids. In a list, distances to all entries come from table
look-ups (asymmetric: exact query, coded entry); an entry stays if the distance less its error length is at most r, a
bound that loses nothing, and the cosine of what stays is computed in double precision from the vectors.

Only rows of equal, non-null labels meet. Rows with equal label and vector are one entry with a count. Lists are dealt
by (label, list) in blocks of bounded size, each pair of blocks a task's group, so a hot list is spread over tasks.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows with a
null label; vectors of different lengths never link; each row of a repeated id is linked as a vector of its own, and
counts for the others; null ids link with nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ragged, written


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x size
    books: np.ndarray  # subspaces x codes x part
    radius: float

    def __post_init__(self):
        """Distances between all centroids, worked out in blocks of bounded size."""
        c = self.centroids
        most = max(1, (4 << 20) // max(1, c.size))
        gaps = [np.sqrt(np.maximum(((c[i : i + most, None] - c) ** 2).sum(2), 1e-30)) for i in range(0, len(c), most)]
        self.gaps = np.concatenate(gaps)

    @property
    def parts(self) -> tuple[int, int]:
        return self.books.shape[0], self.books.shape[2]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and all squared distances to the centroids."""
        d = (x * x).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return d.argmin(1), d

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each list that can hold a vector within the radius of the row's."""
        own, d = self.nearest(x)
        away = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gaps[own])
        return np.nonzero(away <= self.radius + 1e-6)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and length of the quantisation error."""
        m, part = self.parts
        codes, error = np.empty((len(residual), m), np.uint8), np.zeros(len(residual))
        for s in range(m):
            r = residual[:, s * part : (s + 1) * part]
            d = (r * r).sum(1)[:, None] + (self.books[s] ** 2).sum(1) - 2 * r @ self.books[s].T
            codes[:, s] = d.argmin(1)
            error += np.maximum(d[np.arange(len(r)), codes[:, s]], 0)
        return codes, np.sqrt(error)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of query residuals to coded entries of one list, by look-up tables."""
        m, part = self.parts
        out = np.zeros((len(residual), len(codes)))
        for s in range(m):
            r = residual[:, s * part : (s + 1) * part]
            table = (r * r).sum(1)[:, None] + (self.books[s] ** 2).sum(1) - 2 * r @ self.books[s].T
            out += table[:, codes[:, s]]
        return np.sqrt(np.maximum(out, 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def fit(sample: np.ndarray, lists: int, subspaces: int, codes: int, radius: float, seed: int = 7) -> Quantiser:
    rng = np.random.default_rng(seed)
    c = _kmeans(sample, lists, rng)
    q = Quantiser(c, np.zeros((subspaces, codes, sample.shape[1] // subspaces)), radius)
    residual = sample - c[q.nearest(sample)[0]]
    part = sample.shape[1] // subspaces
    q.books = np.stack([_kmeans(residual[:, s * part : (s + 1) * part], codes, rng) for s in range(subspaces)])
    return q


def _table(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros, each scaled by a power of two to components of 1 at most, which changes no cosine."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)] = column.flatten().to_numpy(zero_copy_only=False)
    return np.ldexp(out, -np.frexp(np.abs(out).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(entries: DataFrame, width: int, least: float, sample: int, subspaces: int, codes: int, per_list: int, most_lists: int, block: int) -> DataFrame:
    """(a, b): nodes of linked entries (node, label, size, vector); no vector has more than `width` components."""
    width += -width % subspaces
    total, labels = entries.agg(F.count("*"), F.approx_count_distinct("label")).first()
    lists = max(1, min(most_lists, total // max(1, labels) // per_list * 4))
    share = min(1.0, sample / total)
    got = entries.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vector")  # about `sample` rows
    x = _unit(_table(got.toArrow().column("vector").combine_chunks(), width))
    if not len(x):
        x = np.eye(1, width)
    q = fit(x, min(lists, len(x)), subspaces, codes, float(np.sqrt(max(0.0, 2 - 2 * least))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An entry for its own list, and one query for each list to probe."""
        names = ["node", "label", "size", "vector"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                y = _unit(_table(part.column("vector"), width))
                own, _ = q.nearest(y)
                row, to = q.probes(y)
                for rows_, lists_, is_query in ((np.arange(len(y)), own, False), (row, to, True)):
                    take = pa.array(rows_)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in names), pa.array(lists_.astype(np.int32)), pa.array(np.full(len(rows_), is_query))], [*names, "list", "is_query"])

    kind = dict(entries.dtypes)["label"]
    placed = written(entries.select("node", "label", "size", "vector").mapInArrow(place, f"node long, label {kind}, size int, vector array<double>, list int, is_query boolean"), "placed")
    key = ["label", "size", "list"]
    counts = placed.groupBy(*key).agg(F.ceil(F.count_if("is_query") / block).cast("int").alias("q_blocks"), F.ceil(F.count_if(~F.col("is_query")) / block).cast("int").alias("e_blocks")).filter("q_blocks > 0 and e_blocks > 0")
    dealt = placed.join(counts, key)
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("is_query"), F.col("q_blocks")).otherwise(F.col("e_blocks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("e_blocks")).otherwise(F.col("q_blocks")) - 1))
    dealt = dealt.withColumn("mine", spread).withColumn("other", other)
    dealt = dealt.select(*key, F.when(F.col("is_query"), F.col("mine")).otherwise(F.col("other")).alias("q_block"), F.when(F.col("is_query"), F.col("other")).otherwise(F.col("mine")).alias("e_block"), "is_query", "node", "vector")

    def search(group: pa.Table) -> pa.Table:
        asked = group.column("is_query").to_numpy(zero_copy_only=False)
        nodes, raw = group.column("node").to_numpy(), _table(group.column("vector").combine_chunks(), width)
        norm = np.linalg.norm(raw, axis=1, keepdims=True)
        residual = raw / norm - q.centroids[group.column("list")[0].as_py()]
        e = np.flatnonzero(~asked)
        coded, error = q.encode(residual[e])
        a, b = [], []
        for i in range(0, len(nodes), 512):
            some = i + np.flatnonzero(asked[i : i + 512])
            if not len(some):
                continue
            d = q.distances(residual[some], coded)
            j, k = np.nonzero((d - error <= q.radius + 1e-6) & (nodes[some][:, None] < nodes[e]))
            for s in range(0, len(j), 1 << 16):
                jj, kk = some[j[s : s + (1 << 16)]], e[k[s : s + (1 << 16)]]
                exact = (raw[jj] * raw[kk]).sum(1) / (norm[jj, 0] * norm[kk, 0])
                ok = exact >= least
                a.append(nodes[jj[ok]])
                b.append(nodes[kk[ok]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy(*key, "q_block", "e_block").applyInArrow(search, "a long, b long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, sample: int = 20_000, subspaces: int = 8, codes: int = 64, per_list: int = 256, most_lists: int = 1024, block: int = 2048) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    sample bounds the vectors that a quantiser is fitted on. The number of lists is the number of distinct vectors over
    labels and per_list, between 1 and most_lists. Vectors meet others of their own length only; one quantiser serves
    the lengths up to each power of two.
    """
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    key = F.md5(F.to_json(F.struct("label", "vector")))
    entries = rows.filter(good).withColumn("key", key).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    entries = written(entries.select(F.xxhash64("key").alias("node"), "key", "id", "n", "label", "vector", F.size("vector").alias("size"), F.ceil(F.log2(F.size("vector"))).cast("int").alias("scale")), "entries")
    scales = sorted(r[0] for r in entries.select("scale").distinct().collect())  # 31 at most
    if not scales:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = [written(_pairs(entries.filter(F.col("scale") == k), 1 << k, least, sample, subspaces, codes, per_list, most_lists, block), "pairs") for k in scales]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    weight = entries.select("node", F.col("n").alias("count"))
    ends = pairs.join(weight.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "count").unionAll(pairs.join(weight.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "count"))
    linked = ends.groupBy("node").agg(F.sum("count").alias("links"))
    classes = entries.select("node", "key", "id", "n").join(linked, "node", "left").join(components(pairs), "node", "left").withColumn("part", F.coalesce("component", "node"))
    first = classes.groupBy("part").agg(F.min("id").alias("component_id"))
    classes = classes.join(first, "part").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    every = rows.select("id", F.when(good, key).alias("key"))
    out = every.join(classes, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.coalesce(F.col("id") == component, F.lit(True))).alias("kept"))


def brute_force(rows: list[tuple[int, list | None, int | None]], least: float = 0.98) -> pd.DataFrame:
    """The same from all cosines, for tests."""
    ok = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for size in {len(rows[i][1]) for i in ok}:
        mine = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in mine], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([rows[i][2] for i in mine])
        for a, b in zip(*np.nonzero(np.triu((x @ x.T >= least - 1e-12) & (label[:, None] == label), 1)), strict=True):
            i, j = mine[a], mine[b]
            n[i] += 1
            n[j] += 1
            p, r = find(i), find(j)
            root[p] = r
    groups: dict[int, int] = {}
    for i, (k, _, _) in enumerate(rows):
        groups[find(i)] = min(k, groups.get(find(i), k))
    return pd.DataFrame([(k, n[i], groups[find(i)], groups[find(i)] == k) for i, (k, _, _) in enumerate(rows)], columns=["vec_id", "n_links", "component_id", "kept"])
