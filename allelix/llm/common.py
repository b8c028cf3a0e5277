"""Shared pieces: tables in the shared folder, Arrow buffers as numpy arrays, word hashes, link components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.tables import hdfs, new_path, written  # noqa: F401  used by the operators

U64 = np.uint64
NULL_ID = (1 << 63) - 1  # a null id sorts after every other id

# ---------------------------------------------------------------- shared folder


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hdfs(spark, path)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def filesystem(path: str):
    """pyarrow's file system for the path, for workers, and the path in it. Its module is loaded only where it is needed, as it takes memory."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", path))
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_totals(rows: DataFrame, totals: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """rows joined to totals (a row for each key, nulls included) where one key may have most of the rows.

    `count` says how many rows a key has. Keys with more than a share of 1 / most of all rows are fewer than `most`, so
    those totals are broadcast and their rows stay where they are; the rows of all other keys meet theirs in a shuffle.
    """
    least = totals.agg((F.sum(count) / most).alias("least")).first()["least"] or 0
    t = totals.withColumnRenamed(key, "_of")
    hot, rest = t.filter(F.col(count) > least), t.filter(F.col(count) <= least)
    same = F.col(key).eqNullSafe(F.col("_of"))
    there = rows.join(F.broadcast(hot), same)
    other = rows.join(F.broadcast(hot), same, "left_anti").join(rest, same)
    return there.unionAll(other).drop("_of")


def repeated(rows: DataFrame, times: str, number: str, most: int = 10_000) -> DataFrame:
    """Each row as often as `times` says, with `number` from 1 on. A row with very many goes to many tasks, `most` repeats at a time."""
    upto = lambda a, z: F.explode(F.sequence(a, z))
    few = rows.filter(F.col(times).between(1, most)).withColumn(number, upto(F.lit(1).cast("long"), F.col(times)))
    many = rows.filter(F.col(times) > most).withColumn("_run", upto(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / most)))
    many = many.repartition(shuffle_parts(rows.sparkSession), F.xxhash64("_run", times)).withColumn(number, upto(F.col("_run") * most + 1, F.least(F.col("_run") * most + most, F.col(times))))
    return few.unionAll(many.drop("_run"))


# ---------------------------------------------------------------- memory of Python workers

#: What operators keep in a worker between tasks, by name.
CACHES: dict[str, dict] = {}


def keep_only(*names: str) -> None:
    for name, cache in CACHES.items():
        if name not in names:
            cache.clear()


def trim() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(work: Callable[[Iterator], Iterator], *names: str) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker, which later stages use again, keeps only the caches named, and no freed memory."""

    def run(batches: Iterator) -> Iterator:
        keep_only(*names)
        trim()
        yield from work(batches)
        trim()

    return run


# ---------------------------------------------------------------- Arrow text as bytes


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, (_, offs, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def in_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about `most` bytes of text; one longer text makes a run of its own."""
    _, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at)
        at = to


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no gaps: by default ASCII white space), and the n + 1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection whose output bits all depend on all input bits."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, U64), np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(max(n + n // 4, 1 << 16), b, U64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))
        return self.up[:n], self.down[:n]


BYTES, WORDS, WORDS2 = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each span of items, from prefix sums of a polynomial modulo 2**64. Spans ascend; runs of them of about `most` items are done at a time."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        at, s, e = starts[i], starts[i:j] - starts[i], ends[i:j] - starts[i]
        up, down = BYTES.to(int(e[-1]) + 1)
        p = sums((data[at : at + e[-1]].astype(U64) + U64(1)) * up[:-1])
        out[i:j] = mix((p[e] - p[s]) * down[s] + (e - s).astype(U64) * U64(0x2545F4914F6CDD1D))
        i = j
    return out


def run_hash(h: np.ndarray, at: np.ndarray, n: int | np.ndarray, powers: Powers = WORDS) -> np.ndarray:
    """A hash of h[i : i + n] for each i of at."""
    if not len(at):
        return np.zeros(0, U64)
    up, down = powers.to(len(h) + 1)
    p = sums(h * up[:-1])
    return mix((p[at + n] - p[at]) * down[at])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges start .. start + count - 1, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return out + np.arange(total)


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending; an index of each; and for each element its value's number."""
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return s[new], order[new], number


class HashIndex:
    """Numbers 64-bit hashes in the order they are added."""

    def __init__(self):
        self.old, self.new = (np.zeros(0, U64), np.zeros(0, np.int64)), (np.zeros(0, U64), np.zeros(0, np.int64))
        self.n = 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Numbers of distinct ascending hashes; -1: not known."""
        out = np.full(len(h), -1)
        for keys, numbers in (self.old, self.new):
            if len(keys):
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[k] == h
                out[hit] = numbers[k[hit]]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        numbers = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        self.new = self._joined(self.new, (h, numbers))
        if 4 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = self._joined(self.old, self.new), (np.zeros(0, U64), np.zeros(0, np.int64))
        return numbers

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        keys, numbers = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(keys)
        return keys[order], numbers[order]


class Grown:
    """An array that is appended to."""

    def __init__(self, kind, width: int = 0):
        self.data, self.n = np.zeros((1024, width) if width else 1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            more = np.empty((max(len(self.data) * 5 // 4, self.n + len(x)), *self.data.shape[1:]), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


def codes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text column and the n + 1 offsets of its rows; null counts as empty."""
    data, offsets = utf8(column)
    lead = (data & 0xC0) != 0x80
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), sums(lead.astype(np.int64))[offsets]


# ---------------------------------------------------------------- components of links


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, component), the component's smallest node, for every linked node.

    Alternates large-star and small-star; each round is written to the shared folder. A node with very many neighbours
    is reduced by partial aggregation to its smallest one and joined back, so no task gathers its neighbours in a list.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: each larger neighbour is tied to the smallest of a's neighbourhood
        large = both.join(low, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "edges")
        # small star: each smaller neighbour, and a itself, is tied to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        same = (small.count(), small.select(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]) == (edges.count(), edges.select(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        for old in (edges, large):
            drop(old)
        edges = small
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


