"""Indexes of sorted, blocked VCF files (the public TBI layout): which blocks hold the lines of a region.

The index is made from the marks that the writing tasks leave, one or two for each 16 kb window with lines, so its size
follows the genome and not the number of lines; so does what the driver holds of it.
"""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from allelix.sources import bgzf
from allelix.sources.files import SPLIT, _small, hdfs

WINDOW = 14  # bits
#: First bin of each level, whole contigs of up to 512 Mb first, and the bits of a position that a bin of it spans.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


def bin_of(first: int, last: int) -> int:
    """The smallest bin that holds 0-based positions first .. last."""
    return next(base + (first >> bits) for base, bits in reversed(LEVELS) if first >> bits == last >> bits)


def bins_of(first: int, last: int) -> list[int]:
    """All bins that can hold lines of these positions."""
    return [b for base, bits in LEVELS for b in range(base + (first >> bits), base + (last >> bits) + 1)]


@dataclass
class Contig:
    bins: dict[int, list[list[int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)

    def add(self, first: int, last: int, begin: int, end: int) -> None:
        """Lines within 0-based positions first .. last; in the order of the file."""
        chunks = self.bins.setdefault(bin_of(first, last), [])
        if chunks and begin <= chunks[-1][1]:
            chunks[-1][1] = max(chunks[-1][1], end)
        else:
            chunks.append([begin, end])
        while len(self.linear) <= last >> WINDOW:
            # a window without lines has the place of the one before, whose lines are too far left
            self.linear.append(begin if len(self.linear) >= first >> WINDOW or not self.linear else self.linear[-1])

    def chunks(self, first: int, last: int) -> list[list[int]]:
        if not self.linear:
            return []
        least = self.linear[min(first >> WINDOW, len(self.linear) - 1)]
        return [c for b in bins_of(first, last) for c in self.bins.get(b, ()) if c[1] > least]


def write_index(spark: SparkSession, path: str, marks: DataFrame) -> None:
    """The index of a file from its marks (chrom, first, last, begin, end)."""
    contigs: dict[str, Contig] = {}
    for r in marks.orderBy("begin").toLocalIterator():
        if r["last"] > 1 << LEVELS[0][1]:
            raise ValueError(f"{r['chrom']}:{r['last']} lies beyond what this kind of index reaches")
        contigs.setdefault(r["chrom"], Contig()).add(max(0, r["first"] - 1), max(0, r["last"] - 1), r["begin"], r["end"])
    names = b"".join(n.encode() + b"\0" for n in contigs)
    out = [b"TBI\1", struct.pack("<8i", len(contigs), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
    for c in contigs.values():
        out.append(struct.pack("<i", len(c.bins)))
        for b, chunks in sorted(c.bins.items()):
            out.append(struct.pack("<Ii", b, len(chunks)))
            out += [struct.pack("<2Q", *x) for x in chunks]
        out.append(struct.pack(f"<i{len(c.linear)}Q", len(c.linear), *c.linear))
    data = b"".join(out)
    _small(spark, f"{path}.tbi", b"".join(bgzf.block(data[i : i + bgzf.MOST]) for i in range(0, len(data), bgzf.MOST)) + bgzf.END)


def read_index(spark: SparkSession, path: str) -> dict[str, Contig]:
    fs, p = hdfs(spark, f"{path}.tbi")
    stream = fs.open(p)
    try:
        raw = bytes(stream.readAllBytes())
    finally:
        stream.close()
    data = gzip.decompress(raw)
    if data[:4] != b"TBI\1":
        raise ValueError(f"{path}.tbi is no index")
    n, *_, size = struct.unpack_from("<8i", data, 4)
    names, at = data[36 : 36 + size].decode().split("\0")[:n], 36 + size
    found = {}
    for name in names:
        c = found[name] = Contig()
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(bins):
            b, k = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            c.bins[b], at = [list(x) for x in zip(flat[::2], flat[1::2], strict=True)], at + 8 + 16 * k
        (k,) = struct.unpack_from("<i", data, at)
        c.linear, at = list(struct.unpack_from(f"<{k}Q", data, at + 4)), at + 4 + 8 * k
    return found


def ranges_of(index: dict[str, Contig], regions: list[tuple[str, int, int]], split: int = SPLIT) -> list[tuple[int, int]]:
    """Pairs of virtual offsets that hold all lines of regions (chrom, first, last; 1-based, closed), each once, of about `split` bytes at most."""
    chunks = sorted(tuple(c) for chrom, first, last in regions if chrom in index for c in index[chrom].chunks(max(0, first - 1), max(0, last - 1)))
    merged: list[list[int]] = []
    for begin, end in chunks:
        if merged and begin >> 16 <= merged[-1][1] >> 16:  # in one block
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    starts = sorted({x for c in index.values() for x in c.linear})  # lines begin there
    out, k = [], 0
    for begin, end in merged:
        while k < len(starts) and starts[k] < end:
            if begin < starts[k] and (starts[k] >> 16) - (begin >> 16) >= split:
                out.append((begin, starts[k]))
                begin = starts[k]
            k += 1
        out.append((begin, end))
    return out


def bytes_of(ranges: list[tuple[int, int]]) -> int:
    """The most bytes of the file that reading the ranges takes."""
    return sum((end >> 16) - (begin >> 16) + bgzf.WIDEST for begin, end in ranges)
