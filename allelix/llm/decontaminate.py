"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping segments of `size` bytes, one every `step`, so a passage of size + step bytes
holds a whole one wherever it begins. A segment occurs in a text if it can be aligned to a stretch of it with at most `size * rate` edits. An occurrence with e edits shares at least
m - q + 1 - q e of the segment's q-grams with the text, on diagonals that differ by at most e. So:

1. each text position whose q-gram belongs to any segment is marked; stretches as long as a segment and its budget that
   have fewer marks than the lemma asks for are passed over;
2. in the others the shared q-grams are counted in diagonal bands, 2 e + 2 wide and overlapping by half, so that any
   occurrence's diagonals fall into one band as a whole; bands with fewer distinct segment q-grams than the bound go;
3. each remaining region is verified by banded alignment.

Text and items are compared with ASCII letters lower-cased and white space as single bytes of space. Workers read the
items from the shared folder and index them. A benchmark over `most` bytes is dealt into blocks of about half as much,
each run against all texts, so that an index stays small; the items never come to the driver. Items shorter than q bytes can't be told from chance and are not searched.

Defined results: null and empty texts, and an empty benchmark, give no contamination; equal items are found under each
of their ids; an item without id is searched, and stands last in the list as null; each row of a table is judged by its text alone; other columns are kept and own names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from .common import filesystem, in_slices, lean, new_path, ragged, sums, utf8

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
BITS = 20
MOST_HITS = 1 << 18  # bands hit by text positions that are held at a time
MOST_RUN = 4096  # positions of a run of equal q-grams that are taken together


def qgrams(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams that begin at each byte but the last q - 1."""
    h, have, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while have < q:
        step = min(have, q - have)
        # a hash of `have` bytes and the `step` more that follow: shifted by the base's power
        up = np.uint64(pow(base, step, 1 << 64))
        tail = h[have:] if step == have else _short(data, step)[have:]
        h = h[: len(tail)] * up + tail
        have += step
    return h


def _short(data: np.ndarray, q: int) -> np.ndarray:
    h, base = np.zeros(max(len(data) - q + 1, 0), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(q):
        h = h * base + data[k : len(data) - q + 1 + k].astype(np.uint64) + np.uint64(1)
    return h


class SegmentIndex:
    def __init__(self, items: list[tuple[int | None, str]], q: int, size: int, rate: float, step: int):
        self.q, self.items, self.segments, self.budget, self.bound = q, [], [], [], []
        for item, text in items:
            raw = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
            cuts = [0] if len(raw) <= size else [*range(0, len(raw) - size, step), len(raw) - size]
            for at in cuts:
                s = raw[at : at + size]
                e = int(len(s) * rate)
                while e and len(s) - q + 1 - q * e < 1:
                    e -= 1
                if len(s) >= q:
                    self.items.append(item)
                    self.segments.append(s)
                    self.budget.append(e)
                    self.bound.append(len(s) - q + 1 - q * e)
        self.budget, self.bound, self.sizes = (np.array(x, np.int64) for x in (self.budget, self.bound, [len(s) for s in self.segments]))
        grams = [qgrams(s, q) for s in self.segments]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        where = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams)]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, first = np.unique(hashes[order], return_index=True)
        # runs of places of one q-gram in one segment
        where, place = where[order], place[order]
        new = np.ones(len(place), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (where[1:] != where[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        self.run_where, self.run_place, self.run_size = where[begin], place[begin], np.diff(np.append(begin, len(place)))
        self.run_first = np.searchsorted(begin, first)
        self.run_count = np.diff(np.append(self.run_first, len(begin)))
        self.longest_run, self.least_half = int(self.run_size.max(initial=1)), int(self.budget.min(initial=0)) + 1
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        longest = int((self.sizes + self.budget).max()) if len(self.sizes) else q
        self.reach, self.least = longest - q + 1, int(self.bound.min()) if len(self.bound) else 1

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Verified regions, one for each row and segment: row, segment, start and end byte in the row's text, fewest edits."""
        empty = (np.zeros(0, np.int64),) * 5
        if not len(self.items) or len(data) < self.q:
            return empty
        data = FOLD[data]
        h = qgrams(data, self.q)
        marks = self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        # marks in the stretch of `reach` q-grams from each position on; q-grams across rows only add
        c = sums(marks.astype(np.int32))
        dense = c[np.minimum(np.arange(len(h)) + self.reach, len(h))] - c[:-1] >= self.least
        if not dense.any():
            return empty
        # all marks within a dense stretch
        flag = np.zeros(len(h) + 1, np.int32)
        s = np.flatnonzero(dense)
        np.add.at(flag, s, 1)
        np.add.at(flag, np.minimum(s + self.reach, len(h)), -1)
        at = np.flatnonzero(marks & (np.cumsum(flag[:-1]) > 0))
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        at, k = at[hit], k[hit]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[row + 1]
        at, k, row = at[inside], k[inside], row[inside]
        return self._regions(data, offsets, at, k, row)

    def _regions(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, k: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of text positions with a known q-gram, in order: for each row and segment that is found, its first region and the fewest edits.

        Where a q-gram goes on for a run of positions, as in a line of dashes, and for a run of places in a segment, each
        diagonal band is hit in an interval of places, worked out at once. Runs are taken in lots of a bounded number of
        bands. What a band has so far is a bit for each q-gram of its segment; it is judged once positions have left it
        behind.
        """
        done = [(np.zeros(0, np.int64),) * 5]
        if not len(at):
            return done[0]
        goes_on = (at[1:] == at[:-1] + 1) & (k[1:] == k[:-1]) & (row[1:] == row[:-1])
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate(([True], ~goes_on)), np.arange(len(at)), 0))
        first = np.flatnonzero(since % MOST_RUN == 0)
        a, size, k, row = at[first], np.diff(np.append(first, len(at))), k[first], row[first]
        n = self.run_count[k]
        upto = np.cumsum(n * (2 + (size + self.longest_run) // self.least_half))
        words = 1 + max(0, int(self.sizes.max()) - self.q) // 64
        keys, bits = np.zeros((0, 3), np.int64), np.zeros((0, words), np.uint64)  # open bands: row, segment, band
        settled = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows with segments found without edits, and where
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MOST_HITS, "right")))
            p, of = ragged(self.run_first[k[i:j]], n[i:j]), np.repeat(np.arange(i, j), n[i:j])
            seg, low, high = self.run_where[p], self.run_place[p], self.run_place[p] + self.run_size[p] - 1
            half, begin, end = self.budget[seg] + 1, a[of], a[of] + size[of] - 1
            # band b has the diagonals from b * half to (b + 2) * half - 1, so each diagonal is in two bands
            lowest = np.floor_divide(begin - high, half) - 1
            bands = np.floor_divide(end - low, half) - lowest + 1
            band = ragged(lowest, bands)
            seg, low, high, half, begin, end, of = (np.repeat(x, bands) for x in (seg, low, high, half, begin, end, of))
            low, high = np.maximum(low, begin - (band + 2) * half + 1), np.minimum(high, end - band * half)
            keys, bits = self._joined(np.concatenate((keys, np.stack([row[of], seg, band], 1))), bits, low, high)
            left = (keys[:, 2] + 2) * (self.budget[keys[:, 1]] + 1) + self.sizes[keys[:, 1]] - self.q  # first position that adds nothing
            over = left <= a[j] if j < len(a) else np.ones(len(keys), bool)
            good = keys[over & (np.bitwise_count(bits).sum(1) >= self.bound[keys[:, 1]])]
            fresh = np.concatenate(([True], (good[1:, :2] != good[:-1, :2]).any(1))) if len(good) else np.zeros(0, bool)
            for some in (good[fresh], good[~fresh]):
                some = some[~self._beyond(some, offsets, *settled)]
                if len(some):
                    r, s, b = some.T
                    done.append(self._first(*self.verify(data, offsets, r, s, b * (self.budget[s] + 1))))
                    exact = done[-1][4] == 0
                    known, which = np.unique(np.concatenate((settled[0], (done[-1][0] * len(self.sizes) + done[-1][1])[exact])), return_index=True)
                    settled = known, np.concatenate((settled[1], done[-1][2][exact]))[which]
            keys, bits = keys[~over], bits[~over]
            i = j
        return self._first(*(np.concatenate(x) for x in zip(*done, strict=True)))

    def _beyond(self, keys: np.ndarray, offsets: np.ndarray, known: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bands that lie behind where their segment was found without edits, so that nothing in them is earlier or better."""
        if not len(known) or not len(keys):
            return np.zeros(len(keys), bool)
        row, seg, band = keys.T
        own = row * len(self.sizes) + seg
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        return (known[at] == own) & (band * (self.budget[seg] + 1) - 2 * self.budget[seg] - offsets[row] > starts[at])

    @staticmethod
    def _joined(keys: np.ndarray, bits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys with the bits they have had and, of the last ones, those of the places from low to high."""
        base = keys.min(0)
        span = keys.max(0) - base + 1
        if float(span[0]) * float(span[1]) * float(span[2]) < 2.0**62:
            x = keys - base
            order = np.argsort((x[:, 0] * span[1] + x[:, 1]) * span[2] + x[:, 2], kind="stable")
        else:
            order = np.lexsort(keys.T[::-1])
        s = keys[order]
        first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]).any(1))))
        out = np.empty((len(first), bits.shape[1]), np.uint64)
        under = lambda n: np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(n, 0, 63).astype(np.uint64)) - np.uint64(1))
        for w in range(bits.shape[1]):
            new = under(high + 1 - 64 * w) & ~under(low - 64 * w)
            out[:, w] = np.bitwise_or.reduceat(np.concatenate((bits[:, w], new))[order], first)
        return s[first], out

    @staticmethod
    def _first(row: np.ndarray, seg: np.ndarray, start: np.ndarray, end: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, ...]:
        """One region of each row and segment, its first, with the fewest edits of all of them."""
        if not len(row):
            return row, seg, start, end, edits
        order = np.lexsort((end, start, seg, row))
        row, seg, start, end, edits = (x[order] for x in (row, seg, start, end, edits))
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]))))
        return row[first], seg[first], start[first], end[first], np.minimum.reduceat(edits, first)

    def verify(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, seg: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
        """Banded alignment of each segment with the text on the diagonals of its band and a budget to both sides."""
        out = []
        for m, e in {(int(a), int(b)) for a, b in zip(self.sizes[seg], self.budget[seg], strict=True)}:
            some = np.flatnonzero((self.sizes[seg] == m) & (self.budget[seg] == e))
            for part in np.array_split(some, max(1, len(some) // 20_000)):
                begin, width = low[part] - e, 2 * (e + 1) + 2 * e
                pattern = np.stack([self.segments[s] for s in seg[part]])
                a, z = offsets[row[part]], offsets[row[part] + 1]
                cells = np.arange(width)
                # cell j of line i: the first i bytes of the segment against the text up to begin + i + j
                edge = begin[:, None] + cells
                cost = np.where((edge >= a[:, None]) & (edge <= z[:, None]), 0, 10_000).astype(np.int32)
                for i in range(m):
                    pos = edge + i
                    ok = (pos >= a[:, None]) & (pos < z[:, None])
                    differs = (data[np.clip(pos, 0, len(data) - 1)] != pattern[:, i : i + 1]) | ~ok
                    step = np.where(ok, cost + differs, 10_000)
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a segment byte without counterpart
                    cost = (np.minimum.accumulate(step - cells, 1) + cells).astype(np.int32)  # text bytes without counterpart
                best = cost.argmin(1)
                edits = cost[np.arange(len(part)), best]
                found = edits <= e
                end = (begin + m + best)[found]
                out.append((row[part][found], seg[part][found], np.maximum(end - m, a[found]) - a[found], np.minimum(end, z[found]) - a[found], edits[found]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


RESULT = (("contaminated", BooleanType()), ("n_regions", LongType()), ("items", ArrayType(LongType())), ("first_byte", LongType()), ("past_byte", LongType()), ("fewest_edits", LongType()))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[str]:
    """Folders that hold the benchmark's items, in blocks of about `most` / 2 bytes (a larger item is in a block of its own size)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return []
    n, path = 1 + 2 * total // most, new_path(benchmark.sparkSession, "benchmark")
    items.repartition(n, F.pmod(F.xxhash64("item", "text"), F.lit(n))).withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).write.partitionBy("block").parquet(path)
    from pyarrow.fs import FileSelector

    fs, root = filesystem(path)
    return sorted(f"{path}/{x.base_name}" for x in fs.get_file_info(FileSelector(root)) if x.base_name.startswith("block="))


def _items(folder: str) -> list[tuple[int | None, str]]:
    """A block's items, read by a worker."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, root = filesystem(folder)
    files = sorted(x.path for x in fs.get_file_info(FileSelector(root)) if x.path.endswith(".parquet"))
    found = [(r["item"], r["text"]) for f in files for r in pq.read_table(fs.open_input_file(f), columns=["item", "text"]).to_pylist()]
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def mark_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, size: int = 64, rate: float = 1 / 16, step: int = 16, most: int = 2 << 20) -> DataFrame:
    """df with contaminated, n_regions (segments found), items, the extent of the first region, and the fewest edits."""
    own = [name for name, _ in RESULT]
    out = df.drop(*own)
    for number, folder in enumerate(_blocks(benchmark, item_col, item_text_col, most) or [None]):
        out = _mark(out, folder, text_col, q, size, rate, step, number > 0)
    return out


def _in_order(items: set[int | None]) -> list[int | None]:
    return sorted(items, key=lambda i: (i is None, i or 0))


def _mark(df: DataFrame, folder: str | None, text_col: str, q: int, size: int, rate: float, step: int, more: bool) -> DataFrame:
    own = [name for name, _ in RESULT]
    schema = StructType([f for f in df.schema.fields if f.name not in own])
    for name, kind in RESULT:
        schema = schema.add(name, kind)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SegmentIndex(_items(folder) if folder else [], q, size, rate, step)
        for batch in batches:
            for part in in_slices(batch, text_col):
                n = part.num_rows
                row, seg, start, end, edits = index.find(*utf8(part.column(text_col)))
                found: list[dict | None] = [None] * n
                for r, s, a, z, e in zip(row.tolist(), seg.tolist(), start.tolist(), end.tolist(), edits.tolist(), strict=True):
                    f = found[r] = found[r] or {"segments": set(), "items": set(), "at": (a, z), "edits": e}
                    f["segments"].add(s)
                    f["items"].add(index.items[s])
                    f["at"], f["edits"] = min(f["at"], (a, z)), min(f["edits"], e)
                values = [[f is not None for f in found], [len(f["segments"]) if f else 0 for f in found], [_in_order(f["items"]) if f else [] for f in found], [f["at"][0] if f else None for f in found], [f["at"][1] if f else None for f in found], [f["edits"] if f else None for f in found]]
                if more:  # what earlier blocks found
                    old = [part.column(name).to_pylist() for name in own]
                    none = lambda x, y, f: y if x is None else x if y is None else f(x, y)
                    joined = [lambda x, y: x or y, lambda x, y: x + y, lambda x, y: _in_order({*x, *y}), lambda x, y: none(x, y, min), lambda x, y: none(x, y, min), lambda x, y: none(x, y, min)]
                    values = [[f(x, y) for x, y in zip(o, v, strict=True)] for f, o, v in zip(joined, old, values, strict=True)]
                kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
                kept = [(name, c) for name, c in zip(part.schema.names, part.columns, strict=True) if name not in own]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], [*(name for name, _ in kept), *own])

    return df.mapInArrow(lean(mark), schema)


def brute_force(texts: list[str | None], items: list[tuple[int, str]], size: int = 64, rate: float = 1 / 16, q: int = 10, step: int = 16) -> pd.DataFrame:
    """Contamination by full alignment of every segment with every text, for tests."""
    out = []
    for t in texts:
        raw, hit = FOLD[np.frombuffer((t or "").encode(), np.uint8)], set()
        for item, s in items:
            x = FOLD[np.frombuffer(s.encode(), np.uint8)]
            cuts = [0] if len(x) <= size else [*range(0, len(x) - size, step), len(x) - size]
            for at in cuts:
                p = x[at : at + size]
                e = int(len(p) * rate)
                while e and len(p) - q + 1 - q * e < 1:
                    e -= 1
                if len(p) < q:
                    continue
                cost = np.zeros(len(raw) + 1, np.int64)
                cells = np.arange(len(raw) + 1)
                for c in p:
                    line = cost + 1
                    line[1:] = np.minimum(line[1:], cost[:-1] + (raw != c))
                    cost = np.minimum.accumulate(line - cells) + cells
                if cost.min() <= e:
                    hit.add(item)
        out.append((bool(hit), sorted(hit)))
    return pd.DataFrame(out, columns=["contaminated", "items"])
