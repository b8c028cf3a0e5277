"""Segmentation lattices over a fixed public piece vocabulary, for many units of text at once.

A unit is a run of space marks followed by characters other than space; no piece has a space mark behind another
character, so a text's lattice is the chain of its units' lattices. Sums over units longer than MOST characters are kept
as logarithms, as they may leave the range of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import CACHES, U64, ragged

MARK, MOST = "▁", 64
LITERAL_MARK = 0x10FFFF  # stands for a space-mark character that is in the text itself
_BASE = U64(0x9DDFEA08EB382D69)
SCALE = 2.5  # natural logarithm of a factor per character that keeps sums over segmentations near 1


@dataclass
class Lattice:
    """Node i + u is position i of all units' characters, in unit u; each unit has one node more than characters."""

    codes: np.ndarray
    root: np.ndarray  # first node of each unit
    stop: np.ndarray  # last node of each unit
    start: np.ndarray  # of each edge, ascending
    end: np.ndarray
    piece: np.ndarray  # id; -1 .. -4: that many byte pieces
    char: np.ndarray  # position of the edge's first character
    unit: np.ndarray  # of the edge


class Pieces:
    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.n = len(proto.pieces)
        self.byte_id, self.text = np.zeros(256, np.int64), [b""] * self.n
        known: dict[int, int] = {}
        base, cut = int(_BASE), (1 << 64) - 1
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.text[i] = i, bytes([value])
            elif p.type == p.NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"piece {i} has a space mark behind another character")
                self.text[i] = p.piece.replace(MARK, " ").encode()
                h = 0
                for c in p.piece:
                    h = (h * base + ord(c) + 1) & cut
                    known.setdefault(h, -1)
                known[h] = i
        self._place(np.fromiter(known, U64, len(known)), np.fromiter(known.values(), np.int64, len(known)))
        sizes = np.fromiter(map(len, self.text), np.int64, self.n)
        self.text_at, self.text_size, self.text_bytes = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.text), np.uint8)

    def _place(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        """An open-addressing table of the prefixes' hashes: a look-up touches one place nearly always."""
        self.bits = max(10, int(np.ceil(np.log2(len(hashes) + 1))) + 2)
        self.slots, self.id = np.zeros((1 << self.bits) + 64, U64), np.full((1 << self.bits) + 64, -1, np.int32)
        todo, at = np.arange(len(hashes)), self._slot(hashes)
        while len(todo):
            free = self.slots[at[todo]] == 0
            _, first = np.unique(at[todo[free]], return_index=True)  # one of those that want the same place gets it
            put = todo[free][first]
            self.slots[at[put]], self.id[at[put]] = hashes[put], ids[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] += self.slots[at[todo]] != 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and the numbers of the pieces of those (-1: of a prefix that is none)."""
        at = self._slot(h)
        there = self.slots[at]
        ok = there == h
        todo = np.flatnonzero(~ok & (there != 0))
        while len(todo):
            at[todo] += 1
            there = self.slots[at[todo]]
            ok[todo] = there == h[todo]
            todo = todo[(there != 0) & ~ok[todo]]
        return ok, self.id[at[ok]].astype(np.int64)

    def lattice(self, codes: np.ndarray, sizes: np.ndarray) -> Lattice:
        """Of units given by their code points, one after the other, and their sizes."""
        past = np.cumsum(sizes)
        unit, limit = np.repeat(np.arange(len(sizes)), sizes), np.repeat(past, sizes)
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), U64), []
        single = np.zeros(len(codes), bool)
        length = 0
        while len(at):
            h = h * _BASE + codes[at + length].astype(U64) + U64(1)
            length += 1
            ok, piece = self.find(h)
            at, h = at[ok], h[ok]
            some = piece >= 0
            found.append((at[some], length, piece[some]))
            if length == 1:
                single[at[some]] = True
            more = at + length < limit[at]
            at, h = at[more], h[more]
        odd = np.flatnonzero(~single)
        c = codes[odd]
        found.append((odd, 1, -(1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + ((c > 0xFFFF) & (c != LITERAL_MARK)))))
        # put the edges in order of their start
        count = np.zeros(len(codes), np.int64)
        for at, _, _ in found:
            count[at] += 1
        put = np.cumsum(count) - count
        start, size, piece = np.repeat(np.arange(len(codes)), count), np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        for at, length, ids in found:
            size[put[at]], piece[put[at]] = length, ids
            put[at] += 1
        u = unit[start]
        first = past - sizes
        return Lattice(codes, first + np.arange(len(sizes)), past + np.arange(len(sizes)), start + u, start + u + size, piece, start, u)


def edge_scores(lattice: Lattice, log_p: np.ndarray, log_byte: float) -> np.ndarray:
    """Each edge's log probability, scaled per character; log_p may have a column per model."""
    score = log_p[np.maximum(lattice.piece, 0)]
    low = lattice.piece < 0
    score = np.where(low.reshape(-1, *[1] * (score.ndim - 1)), (-lattice.piece * log_byte).reshape(-1, *[1] * (score.ndim - 1)), score)
    return score + SCALE * (lattice.end - lattice.start).reshape(-1, *[1] * (score.ndim - 1))


def edge_values(lattice: Lattice, log_p: np.ndarray, log_byte: float) -> np.ndarray:
    return np.exp(edge_scores(lattice, log_p, log_byte))


def _log_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp(x) over the runs that begin at `first`."""
    most = np.maximum.reduceat(x, first)
    return most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(first, len(x))), axis=0)), first))


def backward(lattice: Lattice, value: np.ndarray, logs: bool = False) -> np.ndarray:
    """For each node the sum over all segmentations of what follows it in its unit; `logs`: of scores, as logarithm."""
    n = int(lattice.stop[-1]) + 1 if len(lattice.stop) else 0
    total = np.full((n, *value.shape[1:]), -np.inf if logs else 0.0)
    total[lattice.stop] = 0 if logs else 1
    left = lattice.stop[lattice.unit] - lattice.start
    top = int(left.max()) if len(left) else 0
    left = left.astype(np.uint8 if top < 256 else np.int64)
    order = np.argsort(left, kind="stable")
    start, end, value, left = lattice.start[order], lattice.end[order], value[order], left[order]
    first = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1]))) if len(start) else start
    step = left[first]
    edges, groups = np.searchsorted(left, np.arange(1, top + 2)), np.searchsorted(step, np.arange(1, top + 2))
    for a, b, g, z in zip(edges, edges[1:], groups, groups[1:], strict=False):
        if b > a:
            total[start[first[g:z]]] = _log_sums(value[a:b] + total[end[a:b]], first[g:z] - a) if logs else np.add.reduceat(value[a:b] * total[end[a:b]], first[g:z] - a)
    return total


def forward(lattice: Lattice, value: np.ndarray, logs: bool = False) -> np.ndarray:
    """For each node the sum over all segmentations of what precedes it in its unit; `logs`: of scores, as logarithm."""
    n = int(lattice.stop[-1]) + 1 if len(lattice.stop) else 0
    total = np.full((n, *value.shape[1:]), -np.inf if logs else 0.0)
    total[lattice.root] = 0 if logs else 1
    depth = lattice.end - lattice.root[lattice.unit]
    top = int(depth.max()) if len(depth) else 0
    order = np.lexsort((lattice.end, depth))
    start, end, value, depth = lattice.start[order], lattice.end[order], value[order], depth[order]
    first = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1]))) if len(end) else end
    step = depth[first]
    edges, groups = np.searchsorted(depth, np.arange(1, top + 2)), np.searchsorted(step, np.arange(1, top + 2))
    for a, b, g, z in zip(edges, edges[1:], groups, groups[1:], strict=False):
        if b > a:
            total[end[first[g:z]]] = _log_sums(value[a:b] + total[start[a:b]], first[g:z] - a) if logs else np.add.reduceat(value[a:b] * total[start[a:b]], first[g:z] - a)
    return total


def zipf(n: int, skip: int = 259, shift: float = 10.0) -> np.ndarray:
    """Log probabilities of the pieces by their rank in the vocabulary; byte and control pieces come last."""
    rank = np.arange(n) - skip
    rank[rank < 0] += n
    p = 1 / (rank + shift)
    return np.log(p / p.sum())


def marked(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of words codes[start : start + size], each with a space mark before it: codes and sizes."""
    n = sizes + 1
    out = np.full(int(n.sum()), ord(MARK), np.uint32)
    head = np.cumsum(n) - n
    out[ragged(head + 1, sizes)] = codes[ragged(starts, sizes)]
    return out, n


_tables: dict[str, Pieces] = {}
CACHES["pieces"] = _tables


def table(model: str) -> Pieces:
    if model not in _tables:
        _tables[model] = Pieces(model)
    return _tables[model]
