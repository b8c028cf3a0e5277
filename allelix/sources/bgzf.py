"""Blocked gzip files (BGZF): readers of byte ranges, so that many tasks read one file, and blocks for writers.

A file is a row of gzip members of up to 64 kB, each of which states its size in an extra field, so any gzip reader
reads it whole and this one reads it from any block on. A place in the text is a virtual offset: the block's first byte
in the file, shifted by 16 bits, and the place in the block's text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

MAGIC, MOST, WIDEST = b"\x1f\x8b\x08\x04", 0xFF00, 1 << 16
NEAR = 4 << 20  # bytes that are fetched at a time


def block(data: bytes, level: int = 6) -> bytes:
    """One block of up to MOST bytes of text."""
    for how in (level, 0):
        c = zlib.compressobj(how, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        if len(body) + 26 <= WIDEST:
            break
    return MAGIC + struct.pack("<I2BH2B2H", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


END = block(b"")


def size_at(data: bytes, at: int = 0) -> int:
    """The size of the block whose head is at this place; 0 if there is none."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return 0
    (extra,) = struct.unpack_from("<H", data, at + 10)
    i, stop = at + 12, min(at + 12 + extra, len(data))
    while i + 6 <= stop:
        a, b, n = struct.unpack_from("<2BH", data, i)
        if (a, b, n) == (66, 67, 2):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return 0


class Blocks:
    """The blocks of an open file of known length."""

    def __init__(self, file, length: int):
        self.file, self.length, self.at, self.held = file, length, 0, b""

    def _bytes(self, start: int, n: int) -> bytes:
        n = min(n, self.length - start)
        if not self.at <= start or start + n > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, bytes(self.file.read(min(max(n, NEAR), self.length - start)))
        return self.held[start - self.at : start - self.at + n]

    def first(self, start: int) -> int:
        """The first block at or after a byte: a head that another block, or the end, follows where it says."""
        while start < self.length:
            data = self._bytes(start, 2 * WIDEST + 64)
            i = data.find(MAGIC)
            while 0 <= i < WIDEST:
                n = size_at(data, i)
                if n and (start + i + n == self.length or size_at(data, i + n)):
                    return start + i
                i = data.find(MAGIC, i + 1)
            start += min(WIDEST, len(data))
        return self.length

    def text(self, start: int) -> tuple[bytes, int]:
        """The text of the block that begins at a byte, and where the next one begins."""
        n = size_at(self._bytes(start, 512))
        if not n:
            raise ValueError(f"no block begins at byte {start}")
        data = self._bytes(start, n)
        (extra,) = struct.unpack_from("<H", data, 10)
        out = zlib.decompress(data[12 + extra : -8], -15)
        if (zlib.crc32(out), len(out)) != struct.unpack("<2I", data[-8:]):
            raise ValueError(f"the block at byte {start} is damaged")
        return out, start + n

    def texts(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(first byte, text) of the blocks that begin in a range, the first of which begins a block."""
        while start < min(end, self.length):
            text, after = self.text(start)
            yield start, text
            start = after

    def lines(self, start: int, end: int) -> Iterator[bytes]:
        """Runs of whole lines of a range of bytes: all that follow the first line break in its blocks, up to the first break after it.

        A range from 0 has its first line too; so each line is in one range, wherever the ranges are cut.
        """
        at, skip, rest = self.first(start), start > 0, []
        if at >= end:
            return
        for at, text in self.texts(at, end):  # noqa: B020
            if skip:
                cut = text.find(b"\n") + 1
                if not cut:
                    continue
                text, skip = text[cut:], False
            cut = text.rfind(b"\n") + 1
            if cut:
                yield b"".join((*rest, text[:cut]))
                rest = []
            rest.append(text[cut:])
        if skip:
            return
        # the line that is open at the end of the range, or begins there
        for _, text in self.texts(at + size_at(self._bytes(at, 512)), self.length):
            cut = text.find(b"\n") + 1
            rest.append(text[:cut] if cut else text)
            if cut:
                break
        if any(rest):
            yield b"".join(rest)

    def between(self, begin: int, end: int) -> Iterator[bytes]:
        """The text between two virtual offsets."""
        within, last = begin & 0xFFFF, end >> 16
        for at, text in self.texts(begin >> 16, last + bool(end & 0xFFFF)):
            yield text[within : (end & 0xFFFF) if at == last else len(text)]
            within = 0
