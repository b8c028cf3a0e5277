"""Vector code compression: a codebook for each part of the vectors, searched by annular norm pruning, in exact integers.

Components become integers and vectors are cut into equal parts. Each part position has a codebook, whose entries start
as the parts of the first vectors and are moved to the mean of their parts in a fixed number of rounds. An entry can be
as near to a part as the best one known only if its norm differs from the part's by no more than that distance. So
entries are sorted by norm; the one nearest in norm gives a first distance, two binary searches the annulus that this
allows, its ends included, and only entries within are compared, exactly.

A round is one job over all vectors: tasks send sums and counts of the entries' parts, which are added up in groups of
tasks before the driver, which holds the codebooks (entries x length of a vector), adds the groups' sums.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length
have codebooks of their own, as the lengths in use are few; where the number of parts does not divide the length, the first parts are one
longer; an empty vector has code 0 in every part. Fewer vectors than entries give as many entries. Rows of null ids
come after all others, rows of one id in the order of their vectors. Integers of any size are exact; an error that does
not fit a long is null, as is the label_error of its label. Null labels count as one label. Other columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ragged, with_totals, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
TASK_GROUPS = 64
SUMS = "size int, part int, entry int, n long, sums array<string>"


def cuts(size: int, parts: int) -> list[tuple[int, int]]:
    """Starts and ends of the parts."""
    least, more = divmod(size, parts)
    at = [k * least + min(k, more) for k in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def as_integer(x: float) -> int:
    y = x * SCALE
    return math.floor(y) if math.isfinite(y) else int(x) * SCALE


@dataclass
class Part:
    """The codebook of one part position, entries by norm beside their numbers."""

    entries: list[list[int]]

    def __post_init__(self):
        squares = [sum(c * c for c in e) for e in self.entries]
        self.order = sorted(range(len(squares)), key=squares.__getitem__)
        self.roots = [math.isqrt(squares[k]) for k in self.order]
        width = len(self.entries[0])
        #: Components under it keep sums of squares within 64 bits, with the entry's number behind them or over 32 parts.
        self.limit = math.isqrt((1 << 62) // (4 * max(1, width) * max(32, len(self.entries))))
        self.narrow = all(-self.limit < c < self.limit for e in self.entries for c in e)
        if self.narrow:
            self.table = np.array(self.entries, np.int64).reshape(len(self.entries), width)
            self.by_norm = np.array(self.order)
            self.norms = np.sqrt(np.array([squares[k] for k in self.order], float))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances of narrow parts (rows x width)."""
        k, width = self.table.shape
        most = max(1, (1 << 19) // (k * max(1, width)))
        found = [self._annulus(x[i : i + most]) for i in range(0, len(x), most)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.table)
        norm = np.sqrt((x * x).sum(1).astype(float))
        above = np.searchsorted(self.norms, norm)
        low, high = np.maximum(above - 1, 0), np.minimum(above, k - 1)
        start = np.where(norm - self.norms[low] <= self.norms[high] - norm, low, high)
        best = np.sqrt(((x - self.table[self.by_norm[start]]) ** 2).sum(1).astype(float))
        slack = 1e-6 + 1e-12 * (norm + best)  # more than square roots in doubles are off, so no entry at an end is left out
        first = np.searchsorted(self.norms, norm - best - slack, "left")
        count = np.searchsorted(self.norms, norm + best + slack, "right") - first
        entry = self.by_norm[ragged(first, count)]
        away = ((np.repeat(x, count, 0) - self.table[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(away * k + entry, np.cumsum(count) - count)  # of equal distances the lower number
        return least % k, least // k

    def nearest_wide(self, x: list[int]) -> tuple[int, int]:
        """The same for one part of integers of any size."""
        root = math.isqrt(sum(c * c for c in x))
        away = lambda e: sum((a - b) ** 2 for a, b in zip(x, self.entries[e], strict=True))
        start = min(max(bisect_left(self.roots, root), 0), len(self.roots) - 1)
        reach = math.isqrt(away(self.order[start])) + 2
        return min((away(e), e) for e in self.order[bisect_left(self.roots, root - reach) : bisect_right(self.roots, root + reach)])[::-1]


@dataclass
class Codebooks:
    """The parts' codebooks for vectors of one length."""

    parts: list[Part]

    @staticmethod
    def of(vectors: list[list[int]], size: int, parts: int) -> Codebooks:
        return Codebooks([Part([v[a:z] for v in vectors]) for a, z in cuts(size, parts)])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for p in self.parts for e in p.entries for c in e).encode()).hexdigest()

    def encode(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | list, np.ndarray]]:
        """(part, entries, squared distances, components) of vectors (rows x length); integers of any size where they need it."""
        width = x.shape[1]
        y = np.floor(x * float(SCALE)) if len(x) and np.abs(x).max(initial=0) < 1e300 else np.full(x.shape, np.inf)
        for k, ((a, z), part) in enumerate(zip(cuts(width, len(self.parts)), self.parts, strict=True)):
            own = y[:, a:z]
            if part.narrow and np.abs(own).max(initial=0) < part.limit:
                own = own.astype(np.int64)
                yield k, *part.nearest(own), own
            else:
                rows = [[as_integer(float(c)) for c in row[a:z]] for row in x]
                found = [part.nearest_wide(r) for r in rows]
                yield k, np.array([f[0] for f in found], np.int64), [f[1] for f in found], np.array(rows, object).reshape(len(rows), z - a)

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """With each entry that has parts at their mean, rounded down."""
        mean = lambda k, e, old: [s // sums[k, e][0] for s in sums[k, e][1]] if (k, e) in sums else old
        return Codebooks([Part([mean(k, e, old) for e, old in enumerate(p.entries)]) for k, p in enumerate(self.parts)])


def vectors_of(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in the column: the rows, and their vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.flatten().to_numpy(zero_copy_only=False).astype(float)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(offsets[rows] - offsets[0])[:, None] + np.arange(size)].reshape(len(rows), size)


def _summed(kept: DataFrame, books: dict[int, Codebooks]) -> dict[int, dict[tuple[int, int], tuple[int, list[int]]]]:
    """By length, part and entry: how many parts the entry is nearest to, and their sum."""

    def total(rows: Iterator[tuple[tuple, int, list[int]]]) -> pa.RecordBatch:
        found: dict[tuple, list] = {}
        for key, n, s in rows:
            now = found.setdefault(key, [0, [0] * len(s)])
            now[0] += n
            now[1] = [a + b for a, b in zip(now[1], s, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.int32()) for i in range(3)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([[str(c) for c in v[1]] for v in found.values()], pa.list_(pa.string()))], ["size", "part", "entry", "n", "sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], np.ndarray] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in vectors_of(batch.column("vector")):
                size = x.shape[1]
                for k, code, _, own in books[size].encode(x):
                    at, most = (size, k), len(books[size].parts[k].entries)
                    if at not in sums:
                        n[at], sums[at] = np.zeros(most, np.int64), np.zeros((most, own.shape[1]), object)
                    n[at] += np.bincount(code, minlength=most)
                    part = np.zeros((most, own.shape[1]), own.dtype)
                    np.add.at(part, code, own)
                    sums[at] = sums[at] + part
        yield total(((size, k, e), int(n[size, k][e]), [int(c) for c in sums[size, k][e]]) for size, k in n for e in np.flatnonzero(n[size, k]).tolist())

    def read(rows: list[dict]) -> Iterator[tuple[tuple, int, list[int]]]:
        return (((r["size"], r["part"], r["entry"]), r["n"], list(map(int, r["sums"]))) for r in rows)

    sent = kept.select("vector").mapInArrow(lean(each), SUMS).withColumn("tasks", F.spark_partition_id() % TASK_GROUPS)
    met = sent.groupBy("tasks", "part").applyInArrow(lambda t: pa.Table.from_batches([total(read(t.to_pylist()))]), SUMS)
    out: dict[int, dict] = {size: {} for size in books}
    for size, k, e, n, s in zip(*total(read([r.asDict() for r in met.collect()])).to_pydict().values(), strict=True):
        out[size][k, e] = n, list(map(int, s))
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df whose vector is whole: its id, code, error, label_error and codebooks_sha256."""
    v = F.col("vector")
    plain = dict(df.dtypes)[vector_col] in ("array<float>", "array<double>")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), (F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")).alias("vector"))
    kept = written(rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), "vectors")
    first = kept.withColumn("size", F.size("vector")).withColumn("k", F.row_number().over(Window.partitionBy("size").orderBy(F.col("id").asc_nulls_last(), "vector"))).filter(F.col("k") <= entries)
    starts: dict[int, list] = {}
    for r in first.orderBy("size", "k").select("size", "vector").collect():  # of each length as many as entries
        starts.setdefault(r["size"], []).append([as_integer(float(c)) for c in r["vector"]])
    books = {size: Codebooks.of(vectors, size, parts) for size, vectors in starts.items()}
    for _ in range(rounds if books else 0):
        sums = _summed(kept, books)
        books = {size: b.moved(sums[size]) for size, b in books.items()}
    digests = {size: b.digest() for size, b in books.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{e:02x}" for e in range(256)], "S2")
        for batch in batches:
            for at, x in vectors_of(batch.column("vector")):
                size = x.shape[1]
                codes, error = np.empty((len(at), parts), "S2"), np.zeros(len(at), np.int64 if parts <= 32 else object)
                for k, found, away, _ in books[size].encode(x):
                    codes[:, k] = names[found]
                    error = error + (away if isinstance(away, np.ndarray) and parts <= 32 else np.array([int(a) for a in away], object))
                take = pa.array(at)
                text = [c.decode() for c in np.ascontiguousarray(codes).view(f"S{2 * parts}").ravel()]
                fits = pa.array(error if error.dtype == np.int64 else [e if e < 1 << 63 else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("label").take(take), pa.array(text, pa.string()), fits, pa.array([digests[size]] * len(at), pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(kept.dtypes)
    coded = written(kept.mapInArrow(lean(code), f"id {kinds['id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"), "codes")
    totals = coded.groupBy("label").agg(F.count("*").alias("rows"), F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"))
    return with_totals(coded, totals, "label", "rows").select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def oracle() -> str:
    """DuckDB SQL of the registered query, its rounds written out."""
    near = lambda r: f"a{r} as materialized (select vec_id, label, p, x, min({{'d': d, 'e': e}}) as m from (select vec_id, label, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join c{r} on parts.p = c{r}.p) group by all)"
    move = lambda r: f"c{r + 1} as materialized (select c{r}.p, c{r}.e, coalesce(y, c) as c from c{r} left join (select p, e, list(y order by i) as y from (select p, m.e as e, i, floor(sum(x[i])::double / count(*))::bigint as y from a{r}, range(1, 9) t(i) group by all) group by 1, 2) n on n.p = c{r}.p and n.e = c{r}.e)"
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(ROUNDS))
    return f"""with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, p, v[p * 8 + 1 : p * 8 + 8] as x from kept, range({PARTS}) t(p)),
c0 as materialized (select p, e, x as c from (select *, row_number() over (partition by p order by vec_id) - 1 as e from parts) where e < {ENTRIES}),
{steps},
{near(ROUNDS)},
coded as (select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a{ROUNDS} group by 1, 2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from c{ROUNDS}) as codebooks_sha256 from coded"""


def brute_force(rows: list[tuple[int | None, list | None, int | None]], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[tuple]:
    """The same with every entry compared, for tests: (id, code, error, label_error, digest), sorted."""
    whole = [(i, v, y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out, by_label = [], {}
    for size in {len(v) for _, v, _ in whole}:
        mine = sorted(((i, v, y) for i, v, y in whole if len(v) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [[[as_integer(c) for c in v[a:z]] for _, v, _ in mine] for a, z in cuts(size, parts)]
        books = [xs[:entries] for xs in cut]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            for p, xs in enumerate(cut):
                own = [near(x, books[p])[1] for x in xs]
                groups = [[x for x, o in zip(xs, own, strict=True) if o == k] for k in range(len(books[p]))]
                books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, books[p], strict=True)]
        digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for j, (i, _, y) in enumerate(mine):
            found = [near(xs[j], books[p]) for p, xs in enumerate(cut)]
            error = sum(f[0] for f in found)
            by_label[y] = by_label.get(y, 0) + error
            out.append((i, "".join(f"{f[1]:02x}" for f in found), error, y, digest))
    fits = lambda e: e if e < 1 << 63 else None
    return sorted(((i, c, fits(e), None if any(fits(x[2]) is None for x in out if x[3] == y) else fits(by_label[y]), d) for i, c, e, y, d in out), key=str)
