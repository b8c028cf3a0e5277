"""Binary alignment files: read by ranges of bytes and written in blocks.

Records run across blocks without marks, so a task that begins inside of the file looks for the first place from which
a run of records can be read, by the constraints on their fields. The task before it reads up to that place, record by
record from its own start, and compares; the first task starts behind the header. So a wrong guess can't go unseen: it
is an error that asks for larger splits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.sources.bgzf import Blocks
from allelix.sources.files import SPLIT, check_file, length_of, qualified, store, tasks, write_records

OPS = "MIDNSHP=X"  # fixed order of the layout
ALONG, COVERING = np.isin(np.arange(16), (0, 2, 3, 7, 8)), np.isin(np.arange(16), (0, 7, 8))
FIXED = 36  # bytes of a record before its name
#: The fixed part of a record.
HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("width", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("length", "<i4")])
RECORD = "name string, flag int, chrom string, pos int, mapq int, cigar array<int>, starts array<int>, lengths array<int>"
RUN, AT_ONCE = 16, 4 << 20  # records that a guess must be followed by; bytes that are taken apart together


@dataclass(frozen=True)
class Bam:
    text: str
    contigs: list[tuple[str, int]]
    alignments: DataFrame


def _header(blocks: Blocks) -> tuple[str, list[tuple[str, int]], int, int]:
    """Header text, contigs with their lengths, and the block and place in it where records begin."""
    data, spans = b"", []
    texts = blocks.texts(0, blocks.length)

    def upto(n: int) -> None:
        nonlocal data
        while len(data) < n:
            at, text = next(texts, (None, None))
            if text is None:
                raise ValueError("the header is cut off")
            spans.append((len(data), at))
            data += text

    upto(8)
    if data[:4] != b"BAM\1":
        raise ValueError("this is no binary alignment file")
    (n,) = struct.unpack_from("<i", data, 4)
    upto(12 + n)
    text, (count,), at, contigs = data[8 : 8 + n].rstrip(b"\0").decode(), struct.unpack_from("<i", data, 8 + n), 12 + n, []
    for _ in range(count):
        upto(at + 4)
        (k,) = struct.unpack_from("<i", data, at)
        upto(at + 8 + k)
        contigs.append((data[at + 4 : at + 3 + k].decode(), *struct.unpack_from("<i", data, at + 4 + k)))
        at += 8 + k
    start, block = max((s for s in spans if s[0] <= at), default=(0, 0))
    return text, contigs, block, at - start


def _plausible(data: bytes, at: int, sizes: list[int]) -> int:
    """Where the record that begins here ends; 0 if none does."""
    if at + FIXED > len(data):
        return 0
    size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<3i2B3H4i", data, at)
    if not (-1 <= ref < len(sizes) and -1 <= mate < len(sizes) and name >= 1 and bases >= 0 and size >= 32 + name + 4 * ops + (bases + 1) // 2 + bases):
        return 0
    if not (-1 <= pos <= (sizes[ref] if ref >= 0 else pos) and -1 <= mate_pos <= (sizes[mate] if mate >= 0 else mate_pos)):
        return 0
    own = data[at + FIXED : at + FIXED + name]
    if len(own) == name and (own[-1] or any(not 33 <= c <= 126 for c in own[:-1])):
        return 0
    cigar = data[at + FIXED + name : at + FIXED + name + 4 * ops]
    return 0 if any(c & 15 > 8 for c in cigar[::4]) else at + 4 + size


def _guess(blocks: Blocks, start: int, sizes: list[int]) -> int | None:
    """The place, in the text from the first block at or after `start`, where a run of records begins; None if there is no text."""
    data, texts, at, more = b"", blocks.texts(blocks.first(start), blocks.length), 0, True

    def reach(n: int) -> bool:
        nonlocal data, more
        while more and len(data) < n:
            text = next(texts, (0, None))[1]
            more = text is not None
            data += text or b""
        return len(data) >= n

    while reach(at + 1):
        end, n = at, 0
        while n < RUN and reach(end + FIXED):
            after = _plausible(data, end, sizes)
            if not after:
                break
            end, n = after, n + 1
        if n == RUN or n and not reach(end + 1) and end == len(data):
            return at
        at += 1
    return len(data) if data else None


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _records(data: bytes, at: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Columns of the records that begin at these places."""
    raw = np.frombuffer(data, np.uint8)
    number = lambda k, kind: raw[(at + k)[:, None] + np.arange(np.dtype(kind).itemsize)].copy().view(kind)[:, 0].astype(np.int64)
    ref, pos, width, quality, ops, flag = (number(k, t) for k, t in ((4, "<i4"), (8, "<i4"), (12, "u1"), (13, "u1"), (16, "<u2"), (18, "<u2")))
    text = raw[_ragged(at + FIXED, width - 1)]
    name = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(width - 1))).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
    cigar = raw[_ragged(at + FIXED + width, 4 * ops)].copy().view("<u4").astype(np.int64)
    length, kind, of = cigar >> 4, cigar & 15, np.repeat(np.arange(len(at)), ops)
    along = np.where(ALONG[kind], length, 0)
    before = np.cumsum(along) - along
    first = np.concatenate(([0], np.cumsum(ops)))[:-1]
    begin = before - np.concatenate((before, [0]))[np.minimum(first, len(before))][of] + pos[of] + 1
    covers = COVERING[kind]
    n = np.bincount(of[covers], minlength=len(at))
    chrom = names.take(pa.array(np.where(ref >= 0, ref, len(names) - 1)))
    return pa.RecordBatch.from_arrays([name, pa.array(flag.astype(np.int32)), chrom, pa.array((pos + 1).astype(np.int32)), pa.array(quality.astype(np.int32)), _lists(cigar, ops), _lists(begin[covers], n), _lists(length[covers], n)], ["name", "flag", "chrom", "pos", "mapq", "cigar", "starts", "lengths"])


def _read_range(blocks: Blocks, start: int, end: int, within: int, sizes: list[int], names: pa.Array) -> Iterator[pa.RecordBatch]:
    """The records that begin in the blocks of a range; the first one at a place in its text."""
    first = blocks.first(start)
    rest, texts, parts, held = b"", blocks.texts(first, end), [], 0
    skip = within

    def whole(data: bytes) -> tuple[np.ndarray, int]:
        at, found = 0, []
        while at + 4 <= len(data):
            after = at + 4 + int.from_bytes(data[at : at + 4], "little")
            if after > len(data):
                break
            found.append(at)
            at = after
        return np.array(found, np.int64), at

    while True:
        _, text = next(texts, (0, None))
        if text is not None:
            drop, skip = min(skip, len(text)), max(0, skip - len(text))
            parts.append(text[drop:])
            held += len(text) - drop
        if held and (text is None or held >= AT_ONCE):
            data = b"".join((rest, *parts))
            at, done = whole(data)
            if len(at):
                yield _records(data, at, names)
            rest, parts, held = data[done:], [], 0
        if text is None:
            break
    used = skip  # of the text behind the range
    if rest:
        after = blocks.texts(blocks.first(end), blocks.length)
        while len(rest) < 4 or len(rest) < 4 + int.from_bytes(rest[:4], "little"):
            text = next(after, (0, None))[1]
            if text is None:
                raise ValueError("the last record is cut off")
            rest, used = rest + text, used + len(text)
        size = 4 + int.from_bytes(rest[:4], "little")
        used -= len(rest) - size
        yield _records(rest[:size], np.zeros(1, np.int64), names)
    if end < blocks.length:
        guess = _guess(blocks, end, sizes)
        if guess is not None and guess != used:
            raise ValueError(f"records can't be told apart at byte {end}: read the file with larger splits")


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> Bam:
    """Header, contigs and alignments: name, flag, chrom, pos (1-based; null and 0 where there is none), mapq, cigar (length << 4 | operation), and starts and lengths of the runs that it covers. Bases, qualities and tags are not read."""
    check_file(spark, path)
    path, length = qualified(spark, path), length_of(spark, path)
    fs, own = store(path)
    with fs.open_input_file(own) as f:
        text, contigs, block, within = _header(Blocks(f, length))
    split = max(split, block + 1)
    n, sizes = max(1, -(-length // split)), [size for _, size in contigs]
    names = pa.array([*(name for name, _ in contigs), None], pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                fs, own = store(path)
                with fs.open_input_file(own) as f:
                    blocks, start, end = Blocks(f, length), k * split if k else block, min((k + 1) * split, length)
                    if blocks.first(start) < end:
                        at = _guess(blocks, start, sizes) if k else within
                        yield from _read_range(blocks, start, end, at or 0, sizes, names)

    return Bam(text, contigs, tasks(spark, range(n), "id long").mapInArrow(read, RECORD))


def packed_cigar(text: Column) -> Column:
    """The operations of a cigar string as integers."""
    op = lambda x: F.position(F.right(x, F.lit(1)), F.lit(OPS)) - 1
    return F.transform(F.regexp_extract_all(text, F.lit(f"[0-9]+[{OPS}]"), F.lit(0)), lambda x: F.shiftleft(F.regexp_extract(x, "^[0-9]+", 0).cast("int"), 4).bitwiseOR(op(x)))


def cigar_text(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.transform(cigar, lambda c: F.concat(F.shiftright(c, 4).cast("string"), F.substring(F.lit(OPS), c.bitwiseAND(15) + 1, F.lit(1)))), ""), F.lit("")), F.lit("*"))


def _packed(name: pa.Array, flag: pa.Array, contig: pa.Array, pos: pa.Array, mapq: pa.Array, cigar: pa.Array) -> bytes:
    """The records of these columns, one behind the other."""
    if any(x.null_count for x in (name, flag, mapq, cigar)):
        raise ValueError("an alignment lacks its name, flag, quality or cigar")
    text, ops = name.cast(pa.binary()), np.asarray(pc.list_value_length(cigar), np.int64)
    width = np.asarray(pc.binary_length(text), np.int64) + 1
    fixed = np.zeros(len(name), HEAD)
    values = {"size": FIXED - 4 + width + 4 * ops, "ref": contig, "pos": np.asarray(pc.fill_null(pos, 0), np.int64) - 1, "width": width, "mapq": mapq, "ops": ops, "flag": flag, "mate": -1, "mate_pos": -1}
    for field, x in values.items():
        x = np.asarray(x, np.int64)
        if len(name) and not (np.iinfo(HEAD[field]).min <= x.min() and x.max() <= np.iinfo(HEAD[field]).max):
            raise ValueError(f"{field} of an alignment is out of its range")
        fixed[field] = x
    size = FIXED + width + 4 * ops
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at[:, None] + np.arange(FIXED)] = fixed.view(np.uint8).reshape(-1, FIXED)
    out[_ragged(at + FIXED, width - 1)] = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
    out[_ragged(at + FIXED + width, 4 * ops)] = np.asarray(cigar.flatten()).astype("<i4").view(np.uint8)
    return out.tobytes()


def write_bam(alignments: DataFrame, contigs: list[tuple[str, int]], path: str, text: str | None = None) -> None:
    """Alignments (name, flag, chrom, pos, mapq, cigar) sorted by contig and position, without bases."""
    lines = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs) if text is None else text
    head = [b"BAM\1", struct.pack("<i", len(lines.encode())), lines.encode(), struct.pack("<i", len(contigs))]
    head += [struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs]
    number = alignments.sparkSession.createDataFrame(list({n: i for i, (n, _) in enumerate(contigs)}.items()), "chrom string, contig int")

    def pack(batch: pa.RecordBatch) -> bytes:
        contig = batch.column("contig")
        known = pc.if_else(pc.less(contig, len(contigs)), contig, -1)
        return _packed(batch.column("name"), batch.column("flag"), known, *(batch.column(c) for c in ("pos", "mapq", "cigar")))

    # what is sorted by is in the rows once
    rows = alignments.select("name", F.col("flag").cast("int").alias("flag"), "chrom", F.col("pos").cast("int").alias("pos"), F.col("mapq").cast("int").alias("mapq"), "cigar").join(F.broadcast(number), "chrom", "left")  # as many rows as the header has contigs
    write_records(rows.select(F.struct(F.coalesce("contig", F.lit(len(contigs))).alias("contig"), "pos", "name").alias("_ord"), "flag", "mapq", "cigar"), path, b"".join(head), blocked=True, pack=pack)
