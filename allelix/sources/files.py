"""Reading and writing single files with many tasks.

A written file is made of parts, one for each partition of the sorted rows, that tasks format, compress and write side
by side; then the parts become one file: by the store's own concatenation, else by tasks that copy each part to its
place, else, in a store that can do neither, by one task. Blocked gzip files are read by ranges of bytes.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.sources import bgzf
from allelix.tables import counted_up, hdfs, written

SPLIT = 32 << 20  # bytes of a blocked file that a task reads


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hdfs(spark, path)
    return fs.exists(p)


def check_file(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"Required file not found: {path}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that executors look in the same store."""
    fs, p = hdfs(spark, path)
    return str(fs.makeQualified(p).toString())


def local_path(path: str) -> str | None:
    """The path of a local, or mounted, file; None in another store."""
    return unquote(re.sub("^file:/*", "/", path)) if path.startswith("file:") else None if "://" in path else path


def store(path: str):
    """pyarrow's file system for a qualified path, for workers, and the path in it."""
    import pyarrow.fs as pafs

    own = local_path(path)
    return (pafs.LocalFileSystem(), own) if own else pafs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- blocked files


def is_blocked(spark: SparkSession, path: str) -> bool:
    fs, p = hdfs(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return False
    stream = fs.open(p)
    try:
        head = bytes(x for x in (stream.read() for _ in range(18)) if x >= 0)
    finally:
        stream.close()
    return bgzf.size_at(head) > 0


def length_of(spark: SparkSession, path: str) -> int:
    fs, p = hdfs(spark, path)
    return fs.getFileStatus(p).getLen()


def tasks(spark: SparkSession, rows: list[tuple] | range, schema: str) -> DataFrame:
    """The rows, each a task of its own that reads much from a file.

    They come from an RDD, whose size Spark takes for unknown. Of a range or a list Spark knows the few bytes, takes what
    the tasks read for as little, and sends it whole to the driver and to each task for a join.
    """
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)).map(lambda x: x if isinstance(x, tuple) else (x,)), schema)


def _rows(runs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for run in runs:
        lines = run.split(b"\n")
        if not lines[-1]:
            lines.pop()
        yield pa.RecordBatch.from_arrays([pa.array([x[:-1] if x.endswith(b"\r") else x for x in lines], pa.binary()).cast(pa.string())], ["value"])


def blocked_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(value) of each line of a blocked gzip file, in its order; a task reads `split` bytes of it."""
    path, length = qualified(spark, path), length_of(spark, path)
    n = max(1, -(-length // split))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                fs, own = store(path)
                with fs.open_input_file(own) as f:
                    yield from _rows(bgzf.Blocks(f, length).lines(k * split, min((k + 1) * split, length)))

    return tasks(spark, range(n), "id long").mapInArrow(read, "value string")


def blocked_lines_between(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """(value) of the lines between pairs of virtual offsets, at each of which a line begins; a task for each pair."""
    path, length = qualified(spark, path), length_of(spark, path)
    if not ranges:
        return spark.createDataFrame([], "value string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in zip(*(batch.column(c).to_pylist() for c in ("begin", "end")), strict=True):
                fs, own = store(path)
                with fs.open_input_file(own) as f:
                    yield from _rows(iter([b"".join(bgzf.Blocks(f, length).between(begin, end))]))

    return tasks(spark, ranges, "begin long, end long").mapInArrow(read, "value string")


# ---------------------------------------------------------------- writing


PARTS = "part int, name string, size long, marks array<struct<chrom: string, first: long, last: long, begin: long, end: long>>"


class _Part:
    """One part of a file, as a task writes it: plain, or in blocks. place() is the virtual offset of the next byte."""

    def __init__(self, stream, blocked: bool):
        self.stream, self.blocked, self.size, self.held, self.n = stream, blocked, 0, [], 0

    def add(self, data: bytes) -> None:
        if not self.blocked:
            self._send(data)
            return
        while data:
            own, data = data[: bgzf.MOST - self.n], data[bgzf.MOST - self.n :]
            self.held.append(own)
            self.n += len(own)
            if self.n == bgzf.MOST:
                self.close()

    def place(self) -> int:
        return (self.size << 16) + self.n

    def close(self) -> None:
        if self.n:
            text, self.held, self.n = b"".join(self.held), [], 0
            self._send(bgzf.block(text))

    def _send(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)


def write_records(records: DataFrame, path: str, head: bytes = b"", blocked: bool = False, pack: Callable[[pa.RecordBatch], bytes] | None = None, line: Column | None = None) -> DataFrame | None:
    """One file of head and the rows' `data` (binary) in the order of `_ord`, a column or several (a struct).

    line or pack makes the data of ordered rows instead, a column or the bytes of a batch, so that it is made once, after
    the sort, and neither sorted nor made for the sample of its keys. pack is given the fields of `_ord` beside the other columns.

    Where rows have chrom, first and last (1-based, closed), returns where they are: (chrom, first, last, begin, end),
    ranges of positions with their virtual offsets, one for each run of rows of one 16 kb window.
    """
    spark = records.sparkSession
    target = qualified(spark, path)
    folder = f"{target}.parts-{uuid.uuid4().hex}"
    fs, p = hdfs(spark, folder)
    fs.mkdirs(p)
    placed = "chrom" in records.columns and pack is None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own = store(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # each attempt has its own; the finished one's counts
        marks: list[list] = []
        with out.open_output_stream(f"{own}/{name}") as stream:
            part = _Part(stream, blocked)
            for batch in batches:
                if not placed:
                    part.add(pack(batch) if pack else b"".join(batch.column("data").to_pylist()))
                    continue
                for data, chrom, first, last in zip(*(batch.column(c).to_pylist() for c in ("data", "chrom", "first", "last")), strict=True):
                    begin = part.place()
                    part.add(data)
                    if marks and marks[-1][0] == chrom and (marks[-1][1] - 1) >> 14 == (first - 1) >> 14 and (marks[-1][2] - 1) >> 14 == (last - 1) >> 14:
                        marks[-1][2], marks[-1][4] = max(marks[-1][2], last), part.place()
                    else:
                        marks.append([chrom, first, last, begin, part.place()])
            part.close()
        keys = ("chrom", "first", "last", "begin", "end")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([part.size], pa.int64()), pa.array([[dict(zip(keys, m, strict=True)) for m in marks]], pa.list_(pa.struct([("chrom", pa.string()), *((k, pa.int64()) for k in keys[1:])])))], ["part", "name", "size", "marks"])

    ordered = records.orderBy("_ord")
    ordered = ordered if line is None else ordered.withColumn("data", line)
    done = (ordered.select("_ord.*", *(c for c in records.columns if c != "_ord")) if pack else ordered.select("data", *(["chrom", "first", "last"] if placed else []))).mapInArrow(write, PARTS)
    if placed:
        done = written(done, "parts")  # the marks are read again
    parts = [("head", _small(spark, f"{folder}/head", b"".join(bgzf.block(head[i : i + bgzf.MOST]) for i in range(0, len(head), bgzf.MOST)) if blocked else head))]
    parts += [(r["name"], r["size"]) for r in sorted(done.select("part", "name", "size").collect(), key=lambda r: r["part"]) if r["size"]]  # a row for each task
    if blocked:
        parts.append(("tail", _small(spark, f"{folder}/tail", bgzf.END)))
    _join(spark, folder, parts, target)
    if not placed:
        return None
    at, starts = 0, []
    for name, size in parts:
        starts.append((name, at))
        at += size
    base = spark.createDataFrame(starts, "name string, base long")
    m = F.col("m")
    marks = done.join(F.broadcast(base), "name").select("base", F.explode("marks").alias("m"))  # a row of base for each task
    return written(marks.select(*(m[c].alias(c) for c in ("chrom", "first", "last")), *((m[c] + F.col("base") * 65536).alias(c) for c in ("begin", "end"))), "marks")


def _small(spark: SparkSession, path: str, data: bytes) -> int:
    """Writes a few bytes from the driver."""
    fs, p = hdfs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(data))
    stream.close()
    return len(data)


def _join(spark: SparkSession, folder: str, parts: list[tuple[str, int]], target: str) -> None:
    """Makes one file of the parts, in their order, and removes them."""
    fs, to = hdfs(spark, target)
    path = lambda name: hdfs(spark, f"{folder}/{name}")[1]
    whole, own = f"{folder}/whole", local_path(folder)
    sizes, at, places = dict(parts), 0, []
    for name, size in parts:
        places.append((name, at, size))
        at += size
    if own:

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "size")), strict=True):
                    with open(f"{own}/{name}", "rb") as source, open(f"{own}/whole", "r+b") as out:
                        for k in range(0, size, 8 << 20):
                            os.pwrite(out.fileno(), source.read(8 << 20), start + k)
                yield batch

        with open(f"{own}/whole", "wb") as f:
            f.truncate(at)
        rows = spark.createDataFrame(places, "name string, start long, size long").repartition(len(places))
        rows.mapInArrow(copy, rows.schema).write.format("noop").mode("overwrite").save()
    else:
        names = [name for name, size in parts if size]
        try:
            fs.rename(path(names[0]), path("whole"))
            rest = spark._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(names) - 1)
            for k, name in enumerate(names[1:]):
                rest[k] = path(name)
            if len(rest):
                fs.concat(path("whole"), rest)
        except Exception as e:  # Java's, by way of the gateway
            if "UnsupportedOperation" not in str(e):
                raise
            names[0] = "whole" if not fs.exists(path(names[0])) else names[0]

            def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                s, inner = store(folder)
                for batch in batches:
                    with s.open_output_stream(f"{inner}/all") as out:
                        for name in batch.column("names")[0].as_py():
                            with s.open_input_stream(f"{inner}/{name}") as source:
                                while data := source.read(8 << 20):
                                    out.write(data)
                    yield batch

            rows = spark.createDataFrame([(names,)], "names array<string>").coalesce(1)
            rows.mapInArrow(one, rows.schema).write.format("noop").mode("overwrite").save()
            whole = f"{folder}/all"
    if sum(sizes.values()) != length_of(spark, whole):
        raise OSError(f"{target}: the parts did not become one file")
    fs.delete(to, True)
    fs.mkdirs(to.getParent())
    fs.rename(hdfs(spark, whole)[1], to)
    fs.delete(hdfs(spark, folder)[1], True)


def write_lines(lines: DataFrame, path: str, head: list[str] = (), gzip: bool = False, line: Column | None = None) -> DataFrame | None:
    """One text file of head and the frame's column `line`, or one that is made of ordered rows, in the order of `_ord`; gzip: in blocks. Returns what write_records does."""
    text, top = F.concat(F.col("line") if line is None else line, F.lit("\n")).cast("binary"), "".join(f"{h}\n" for h in head).encode()
    if line is not None:
        return write_records(lines, path, top, gzip, line=text)
    more = [c for c in ("chrom", "first", "last") if c in lines.columns]
    return write_records(lines.select("_ord", text.alias("data"), *more), path, top, gzip)


# ---------------------------------------------------------------- reading text


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a text file, plain, gzip or blocked gzip; all but plain gzip by many tasks."""
    return blocked_lines(spark, path) if is_blocked(spark, path) else spark.read.text(path)


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    if not is_blocked(spark, path):
        return [r[0] for r in spark.read.text(path).take(n)]
    path, length, found = qualified(spark, path), length_of(spark, path), []
    fs, own = store(path)
    with fs.open_input_file(own) as f:
        for run in bgzf.Blocks(f, length).lines(0, length):
            found += [x.decode() for x in run.splitlines()]
            if len(found) >= n:
                break
    return found[:n]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, value) of a text file; numbers follow the file, whose splits are alike in each scan."""
    return counted_up(text_lines(spark, path), "_ord").select("_ord", "value")


def delimited(spark: SparkSession, path: str, sep: str, names: list[str] | None = None) -> DataFrame:
    """All-string table with `_ord`; empty and NA are null."""
    if names is None:
        names = first_lines(spark, path, 1)[0].split(sep)
        lines = numbered_lines(spark, path).filter("_ord > 1")
    else:
        lines = numbered_lines(spark, path)
    parts = F.split("value", f"\\{sep}" if sep == "|" else sep, -1)
    clean = lambda c: F.when(~c.isin("", "NA"), c)
    unquoted = lambda i: F.regexp_replace(F.get(parts, i), '^"(.*)"$', "$1")
    return lines.filter("value != ''").select("_ord", *(clean(unquoted(i)).alias(n.strip('"')) for i, n in enumerate(names)))
