"""SentencePiece encoding and decoding with Gumbel top-k segmentations, drawn without replacement.

A text's segmentations into pieces have probabilities proportional to the product of the pieces' weights (by default
1 / rank in the fixed vocabulary). Each is given an independent Gumbel perturbation of its log probability, and the k
largest are a sample without replacement. They are found without listing all segmentations by A-star search with
perturbed bounds: the search tree branches at each piece of a path; the exact maximum of the perturbed values below a
branch is a Gumbel variable truncated by the value of the node above it, so it is drawn for the branch as a whole and
only the branch with the largest value is opened, which gives the next segmentation at once.

Conditional probabilities along a path come from the sums over all continuations (backward recursion), rounded to whole
numbers of 2**-32, of one at least, so that every segmentation can be drawn. The public vocabulary's file has merge
ranks, not weights, and says nothing of probabilities, hence 1 / rank. Texts are taken as they are: the file's normaliser
is the identity but for the space put before the text, which decoding takes off. Units of text
(a run of space marks and a word) are distinct lattices, and all documents of a slice walk them together.

With the (k+1)-th largest value t as threshold, a sampled segmentation of log probability phi has inclusion probability
1 - exp(-exp(phi - t)); its logarithm is given. All draws are hashes of the row's key, the sample and the place.

Decoding joins the pieces' bytes and drops the first space; it gives the text back exactly, except that U+10FFFF comes
back as U+2581. Defined results: null and empty texts have one segmentation, without pieces; texts with fewer than k
segmentations give all they have, with inclusion 1; rows with equal keys and texts draw equal samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CACHES, U64, Grown, HashIndex, codes_of, grouped, in_slices, lean, mix, ragged, span_hash, sums, trim, utf8
from .pieces import LITERAL_MARK, MARK, MOST, backward, edge_scores, table, zipf

LOG_BYTE = -14.0
MOST_UNITS, MOST_EDGES = 60_000, 2_000_000  # units whose lattices a worker keeps, and edges of these
ONE = 1 << 32


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1), of hashed seeds."""
    return ((mix(seed) >> U64(11)).astype(float) + 0.5) / (1 << 53)


class Sampler:
    """Draws segmentations; keeps the lattices of a bounded number of units, told apart by a 64-bit hash."""

    def __init__(self, vocabulary: str, power: float = 1.0):
        self.pieces = table(vocabulary)
        self.log_p, self.log_byte = power * zipf(self.pieces.n), power * LOG_BYTE
        self.known = HashIndex()
        self.root, self.open = Grown(np.int64), Grown(np.int32)  # of units: first node; of nodes: first edge, which is the most probable
        # of edges: the node they lead to (-1: the unit ends there), their node, the first and last of their numbers, log probability
        self.end, self.start, self.low, self.last, self.share = Grown(np.int32), Grown(np.int32), Grown(np.uint32), Grown(np.uint32), Grown(float)
        self.id_at, self.id_n, self.ids = Grown(np.int32), Grown(np.int8), Grown(np.int32)

    def forget(self) -> None:
        """Begins anew, in the memory that the tables have."""
        self.known = HashIndex()
        for table_ in (self.root, self.open, self.end, self.start, self.low, self.last, self.share, self.id_at, self.id_n, self.ids):
            table_.n = 0

    def learn(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Adds units' lattices. A node's edges divide 0 .. 2**32 by probability."""
        x = self.pieces.lattice(codes, sizes)
        score = edge_scores(x, self.log_p, self.log_byte)
        if sizes.max() > MOST:
            after = backward(x, score, True)
            p = np.exp(score + after[x.end] - after[x.start])
        else:
            value = np.exp(score)
            after = backward(x, value)
            with np.errstate(invalid="ignore"):
                p = value * after[x.end] / after[x.start]
        start, end, piece = x.start, x.end.copy(), x.piece.copy()
        first = np.concatenate(([True], start[1:] != start[:-1]))
        opens = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        # every edge has a share of 1 of 2**32 at least, so no segmentation is out of reach; a node's largest edge has the rest
        wide = np.maximum(np.rint(np.nan_to_num(p) * ONE), 1).astype(np.int64)
        largest = np.flatnonzero(wide == np.maximum.reduceat(wide, opens)[group])
        largest = largest[np.concatenate(([True], group[largest[1:]] != group[largest[:-1]]))]
        wide[largest] += ONE - np.add.reduceat(wide, opens)
        for values in (end, piece, wide):  # the most probable edge comes first
            values[opens], values[largest] = values[largest], values[opens]
        total = np.cumsum(wide)
        low = total - wide - (total[opens] - wide[opens])[group]
        plain = piece >= 0
        count = np.where(plain, 1, -piece)
        id_at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        ids[id_at[plain]] = piece[plain]
        odd = np.flatnonzero(~plain)
        if len(odd):
            chars = x.codes[x.char[odd]]
            raw = np.where(chars == LITERAL_MARK, ord(MARK), chars).astype("<u4").tobytes().decode("utf-32-le").encode()
            ids[ragged(id_at[odd], count[odd])] = self.pieces.byte_id[np.frombuffer(raw, np.uint8)]
        base, edges = self.open.n, self.start.n
        nodes = int(x.stop[-1]) + 1
        at = np.zeros(nodes, np.int64)
        at[start[opens]] = edges + opens
        end += base
        end[end == (x.stop + base)[x.unit]] = -1
        self.root.add(x.root + base)
        self.open.add(at)
        for to, what in ((self.start, start + base), (self.end, end), (self.low, low), (self.last, low + wide - 1), (self.share, np.log(wide / ONE)), (self.id_at, self.ids.n + id_at), (self.id_n, count)):
            to.add(what)
        self.ids.add(ids)

    def units(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and how many each text has. No text may be empty."""
        codes, offsets = codes_of(column)
        n = len(offsets) - 1
        text = np.insert(np.where(codes == ord(MARK), LITERAL_MARK, np.where(codes == 32, ord(MARK), codes)).astype(np.uint32), offsets[:-1], ord(MARK))
        start = text == ord(MARK)
        start[1:] &= ~start[:-1]
        start[offsets[:-1] + np.arange(n)] = True  # a text may end in spaces
        begin = np.flatnonzero(start)
        past = np.append(begin[1:], len(text))
        h, first, number = grouped(span_hash(text, begin, past))
        if self.known.n > MOST_UNITS or self.start.n > MOST_EDGES:
            self.forget()
        found = self.known(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            long = (past - begin)[first[new]] > MOST
            new = np.concatenate((new[~long], new[long]))
            at, size = begin[first[new]], (past - begin)[first[new]]
            short = len(new) - int(long.sum())
            for i, j in ((i, min(i + 8000, z)) for a, z in ((0, short), (short, len(new))) for i in range(a, z, 8000)):
                self.learn(text[ragged(at[i:j], size[i:j])], size[i:j])
            found[new] = self.known.add(h[new])
        return found[number], np.diff(np.searchsorted(begin, offsets + np.arange(n + 1)))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of runs of piece ids."""
        p = self.pieces
        raw = p.text_bytes[ragged(p.text_at[ids], p.text_size[ids])].tobytes()
        past = np.cumsum(np.concatenate(([0], p.text_size[ids])))[np.concatenate(([0], np.cumsum(sizes)))]
        return [raw[a + 1 : b] for a, b in zip(past[:-1].tolist(), past[1:].tolist(), strict=True)]

    def walk(self, unit: np.ndarray, seed: np.ndarray, head: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path through each unit; those at `head` go on at `node` (-1: at their root, -2: they are over). Returns all edges, and how many each unit took."""
        now = self.root.data[unit]
        some = node != -1
        now[head[some]] = node[some]
        live = np.arange(len(unit))
        over = head[node == -2]
        if len(over):
            live = np.delete(live, over)
        now, out, step = now[live], [], 0
        last, end, opens = self.last.data, self.end.data, self.open.data
        count = np.zeros(len(unit), np.int64)
        while len(live):
            u = (mix(seed[live] + U64(step)) >> U64(32)).astype(np.uint32)
            e = opens[now]
            past = np.flatnonzero(u > last[e])
            while len(past):  # a node has few edges
                e[past] += 1
                past = past[u[past] > last[e[past]]]
            out.append((live, e))
            step += 1
            now = end[e]
            go = now >= 0
            count[live[~go]] = step
            live, now = live[go], now[go]
        at = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for k, (who, e) in enumerate(out):
            edges[at[who] + k] = e
        return edges, count

    def sample(self, column, seeds: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """For each rank: documents, numbers of ids, ids, log probabilities, perturbed values; and each document's (k+1)-th value.

        After a segmentation comes out, what is left of the tree below it is one region: the siblings that hang off its
        path from the branch at which it left its parent. A region's maximum is one truncated Gumbel draw; to open it,
        the decision at which the new path leaves is drawn by the siblings' masses, then the sibling.
        """
        unit, sizes = self.units(column)
        first = np.cumsum(sizes) - sizes
        n_docs = len(sizes)
        share, end = self.share.data, self.end.data
        place = ragged(np.zeros(n_docs, np.int64), sizes)
        unit_seed = np.repeat(seeds, sizes) + place.astype(U64) * U64(0x9E3779B97F4A7C15)

        def truncated(phi: np.ndarray, bound: np.ndarray, salt: int, doc: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                x = phi - np.log(np.exp(phi - bound) - np.log(_uniform(seeds[doc] + U64(salt))))
            return np.where(np.isfinite(phi), np.minimum(x, bound), -np.inf)

        def follow(rank: int, doc: np.ndarray, begin: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Paths of the documents from a unit on: edges, the unit of each, and how many each document has."""
            n = first[doc] + sizes[doc] - begin
            at = ragged(begin, n)
            edges, count = self.walk(unit[at], mix(unit_seed[at] + U64(rank + 1)), np.cumsum(n) - n, node)
            total = sums(count)
            past = np.concatenate(([0], np.cumsum(n)))
            return edges, np.repeat(at, count), np.diff(total[past])

        full: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # of ranks: edges and units of whole paths, where each document's begin (-1: none), how many
        own_at, own_n, pre, value, gone = [], [], [], [], []  # of regions: where in the path they begin, decisions, log probability before them, maximum, mass taken out
        cut: list[list[tuple[np.ndarray, ...]]] = []  # of regions: decision, edge and mass of each child taken out, per document
        docs = np.arange(n_docs)
        edges, units_of, n = follow(0, docs, first, np.full(n_docs, -1))
        doc, up, bound = docs, np.zeros(n_docs, np.int64), -np.log(-np.log(_uniform(seeds + U64(0x51ED))))
        base = np.zeros(n_docs)
        out = []
        for rank in range(k):
            # the new leaf's whole path is in edges, n; its own decisions begin at up, after log probability base
            at = np.cumsum(n) - n
            where = np.full(n_docs, -1)
            where[doc] = at
            length = np.zeros(n_docs, np.int64)
            length[doc] = n
            c = sums(share[edges])
            full.append((edges, units_of, where, length, c))
            tail = c[at + n] - c[at + up]
            final = base + tail
            ids, pieces = self._ids(edges)
            out.append((doc, np.add.reduceat(pieces, at, dtype=np.int64) if len(edges) else n, ids, final, bound))
            x = np.full(n_docs, -np.inf)
            with np.errstate(divide="ignore"):
                x[doc] = truncated(base + np.log(-np.expm1(tail)), bound, 0x77000 + rank, doc)
            for name, what in ((own_at, up), (pre, base)):
                y = np.zeros(n_docs, what.dtype)
                y[doc] = what
                name.append(y)
            value.append(x)
            gone.append(np.zeros(n_docs))
            cut.append([])
            best = np.argmax(np.stack(value), 0)
            top = np.stack(value)[best, docs]
            if rank == k - 1:
                return out, top
            doc = np.flatnonzero(np.isfinite(top))
            if not len(doc):
                return out, top
            bound = top[doc]
            leaf = best[doc]
            t, new, up, base = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc))
            u = _uniform(seeds[doc] + U64(0xABC00 + rank)), _uniform(seeds[doc] + U64(0xDEF00 + rank))
            mass = np.zeros(len(doc))
            for i, d in enumerate(doc.tolist()):
                j = int(leaf[i])
                e, _, w, m, c = full[j]
                a, b = int(w[d] + own_at[j][d]), int(w[d] + m[d])
                path, before = e[a:b], c[a : b + 1] - c[a]
                taken = [(int(s[d]), int(f[d]), float(g[d])) for s, f, g in cut[j] if s[d] >= 0]
                t[i], new[i], mass[i] = self._open(path, before, taken, float(u[0][i]), float(u[1][i]))
                up[i] = own_at[j][d] + t[i] + 1
                base[i] = pre[j][d] + before[t[i]] + share[new[i]]
            left = np.zeros(len(doc))
            for j in range(rank + 1):
                s = np.flatnonzero(leaf == j)
                if not len(s):
                    continue
                record = (np.full(n_docs, -1), np.zeros(n_docs, np.int64), np.zeros(n_docs))
                for r, y in zip(record, (t, new, mass), strict=True):
                    r[doc[s]] = y[s]
                cut[j].append(record)
                gone[j][doc[s]] += mass[s]
                _, _, w, m, c = full[j]
                whole = -np.expm1(c[w[doc[s]] + m[doc[s]]] - c[w[doc[s]] + own_at[j][doc[s]]])
                left[s] = np.maximum(whole - gone[j][doc[s]], 0)
                for i in s[left[s] < 1e-6 * whole].tolist():  # where rounding may count, whether anything is left is known from whole numbers
                    d = int(doc[i])
                    e, _, w, m, c = full[j]
                    a, b = int(w[d] + own_at[j][d]), int(w[d] + m[d])
                    left[i] = self._left(e[a:b], c[a:b] - c[a], [(int(t_[d]), int(f[d])) for t_, f, _ in cut[j] if t_[d] >= 0])
                with np.errstate(divide="ignore"):
                    value[j][doc[s]] = truncated(pre[j][doc[s]] + np.log(left[s]), bound[s], 0x99000 + rank, doc[s])
            # the parent's path up to the branch, the new edge, and a walk from there on
            begin = np.array([full[int(j)][1][full[int(j)][2][d] + p - 1] for j, d, p in zip(leaf, doc, up, strict=True)], np.int64)
            more, more_units, more_n = follow(rank + 1, doc, begin, np.where(end[new] < 0, -2, end[new]))
            n = up + more_n
            edges, units_of = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
            at = np.cumsum(n) - n
            for j in range(rank + 1):
                s = np.flatnonzero(leaf == j)
                source = ragged(full[j][2][doc[s]], up[s] - 1)
                to = ragged(at[s], up[s] - 1)
                edges[to], units_of[to] = full[j][0][source], full[j][1][source]
            edges[at + up - 1], units_of[at + up - 1] = new, begin
            to = ragged(at + up, more_n)
            edges[to], units_of[to] = more, more_units
        return out, top

    def _open(self, path: np.ndarray, before: np.ndarray, taken: list[tuple[int, int, float]], u: float, v: float) -> tuple[int, int, float]:
        """Of a region (a path's edges, log probabilities before them, children taken out of it) draws the decision and the sibling there, and gives the child's mass."""
        share, low = self.share.data, self.low.data
        by_place: dict[int, list[tuple[int, float]]] = {}
        for t, e, m in taken:
            by_place.setdefault(t, []).append((e, m))
        r = u * max(-math.expm1(before[-1]) - sum(m for _, _, m in taken), 0.0)
        for t in sorted(by_place):
            m = sum(m for _, m in by_place[t])
            if r >= -math.expm1(before[t + 1]) - m:
                r += m
        limit = math.log1p(-min(r, 1 - 1e-16))
        t = min(int(np.searchsorted(-before[1:], -limit, "right")), len(path) - 1)
        while True:  # steps back only where rounding has led to a decision without siblings left
            out = sorted([int(path[t]), *(e for e, _ in by_place.get(t, ()))])
            room = ONE - sum(map(self._width, out))
            if room > 0 or t == 0:
                break
            t -= 1
        if room <= 0:
            t = next(t for t in range(len(path)) if ONE > sum(map(self._width, [int(path[t]), *(e for e, _ in by_place.get(t, ()))])))
            out = sorted([int(path[t]), *(e for e, _ in by_place.get(t, ()))])
            room = ONE - sum(map(self._width, out))
        x = min(int(v * room), room - 1)
        for e in out:
            if x >= int(low[e]):
                x += self._width(e)
        e = int(self.open.data[self.start.data[path[t]]])
        while x > self.last.data[e]:
            e += 1
        return t, e, math.exp(before[t] + share[e])

    def _left(self, path: np.ndarray, before: np.ndarray, taken: list[tuple[int, int]]) -> float:
        """Mass of the siblings of a region's path that were not taken out; exactly 0 where there are none."""
        room = ONE - 1 - (self.last.data[path].astype(np.int64) - self.low.data[path])
        for t, e in taken:
            room[t] -= self._width(e)
        return float((np.exp(before) * (room / ONE)).sum())

    def _width(self, e: int) -> int:
        return int(self.last.data[e]) - int(self.low.data[e]) + 1

    def _ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids, and how many each edge has."""
        n, at = self.id_n.data[edges], self.id_at.data[edges]
        return self.ids.data[at if (n == 1).all() else ragged(at, n)], n


_samplers: dict[tuple, Sampler] = {}
CACHES["samplers"] = _samplers


def sampler(vocabulary: str, power: float = 1.0) -> Sampler:
    if (vocabulary, power) not in _samplers:
        _samplers[vocabulary, power] = Sampler(vocabulary, power)
    return _samplers[vocabulary, power]


SAMPLES = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean, ids binary"


def sample_pieces(df: DataFrame, vocabulary: str, k: int = 3, id_col: str = "doc_id", text_col: str = "text", power: float = 1.0, seed: int = 42) -> DataFrame:
    """Up to k rows per document, the sampled segmentations by descending perturbed log probability.

    ids holds the piece ids as little-endian 32-bit integers; round_trip says whether decoding them gave the text.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("seed"), F.col(text_col).alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(vocabulary, power)
        for batch in batches:
            for number, part in enumerate(in_slices(batch, "text", 1 << 19)):
                if number % 4 == 3:
                    trim()
                size = pc.binary_length(part.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
                blank = part.filter(pa.array(size == 0))
                n = blank.num_rows
                if n:
                    yield _rows(blank.column("id"), [0] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [True] * n, [b""] * n)
                part = part.filter(pa.array(size > 0))
                if not part.num_rows:
                    continue
                ids = part.column("id")
                data, offsets = utf8(part.column("text"))
                raw_text = data.tobytes()
                found, limit = s.sample(part.column("text"), mix(part.column("seed").to_numpy().view(U64)), k)
                for rank, (doc, count, tokens, phi, value) in enumerate(found):
                    with np.errstate(over="ignore", under="ignore", divide="ignore"):
                        x = phi - limit[doc]
                        inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
                    raw, past = tokens.astype("<u4").tobytes(), (4 * np.cumsum(np.concatenate(([0], count)))).tolist()
                    back = [a == raw_text[p:q] for a, p, q in zip(s.decode(tokens, count), offsets[doc].tolist(), offsets[doc + 1].tolist(), strict=True)]
                    yield _rows(ids.take(pa.array(doc)), [rank] * len(doc), count, phi, value, inclusion, back, [raw[a:b] for a, b in zip(past, past[1:], strict=False)])

    return texts.mapInArrow(lean(draw, "samplers", "pieces"), SAMPLES)


def _rows(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SAMPLES.split(", ")])


def decode_pieces(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`, the text of its piece ids."""
    kept = df.drop("decoded")
    schema = StructType([*kept.schema.fields]).add("decoded", "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(vocabulary)
        for batch in batches:
            tokens = [np.frombuffer(x or b"", "<u4") for x in batch.column(ids_col).to_pylist()]
            texts = s.decode(np.concatenate(tokens).astype(np.int64), np.array(list(map(len, tokens)))) if tokens else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(lean(decode, "samplers", "pieces"), schema)
