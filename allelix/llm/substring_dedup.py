"""Substring dedup by super-k-mer partitioning.

A window is `width` consecutive words of one document. Consecutive windows whose smallest `mer`-word hash (their
minimiser) is the same travel as one packed string to the bucket of that minimiser. There the windows are sorted by a
128-bit fingerprint of their words' 64-bit hashes, and each learns the smallest document that has it.

Equal windows have equal minimisers, so they meet in one bucket. Before the shuffle each slice of a task settles its
own repeats: of equal windows in it, only those of its smallest document travel, the others are known to be repeats.
So a passage that a third of all documents share sends one window per slice, not one per document.

Defined results: a null text has no words; a null id counts as the largest id there can be; rows with the same id and
text get the same result; windows are judged on the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, WORDS, WORDS2, in_slices, mix, ragged, run_hash, shuffle_parts, span_hash, utf8, word_spans, written

PACKED = "bucket int, ids binary, keys binary, at binary, sizes binary, packed binary, local boolean"
RANGES = "id long, key long, first int, past int"


def _minimisers(h: np.ndarray, windows: np.ndarray, width: int, mer: int) -> np.ndarray:
    """The smallest hash of `mer` words within each window."""
    g = run_hash(h, np.arange(len(h) - mer + 1), mer)
    n, have, low = width - mer + 1, 1, g
    while have < n:
        step = min(have, n - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low[windows]


def _fingerprints(h: np.ndarray, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return run_hash(h, windows, width), run_hash(mix(h), windows, width, WORDS2)


def _smallest(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the smallest id among the windows with the same fingerprint."""
    order = np.argsort(one)
    same = one[order[1:]] == one[order[:-1]]
    if (same & (two[order[1:]] != two[order[:-1]])).any():
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    new = np.flatnonzero(np.concatenate(([True], ~same)))
    low = np.minimum.reduceat(ids[order], new)
    out = np.empty(len(ids), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(new, len(order))))
    return out


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs; breaks[i]: a run begins at i."""
    first = np.flatnonzero(breaks)
    return first, np.diff(np.append(first, len(breaks)))


def _merged(doc: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of repeated windows, given in order: document, first word, word after the last."""
    if not len(at):
        return at, at, at
    first, n = _runs(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))))
    return doc[first], at[first], at[first + n - 1] + width


def _pack(batch: pa.RecordBatch, width: int, mer: int, buckets: int) -> Iterator[dict]:
    data, offsets = utf8(batch.column("text"))
    ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
    starts, ends, rows = word_spans(data, offsets)
    counts = np.maximum(np.diff(rows) - width + 1, 0)
    windows, doc = ragged(rows[:-1], counts), np.repeat(np.arange(len(counts)), counts)
    if not len(windows):
        return
    h = span_hash(data, starts, ends)
    low = _smallest(*_fingerprints(h, windows, width), ids[doc])
    travels = low == ids[doc]
    d, a, z = _merged(doc[~travels], (windows - rows[doc])[~travels], width)
    if len(d):
        yield {"bucket": int(keys[d[0]] % buckets), "ids": ids[d].tobytes(), "keys": keys[d].tobytes(), "at": a.astype(np.int32).tobytes(), "sizes": z.astype(np.int32).tobytes(), "packed": b"", "local": True}
    m = _minimisers(h, windows, width, mer)
    first, n = _runs(np.concatenate(([True], (doc[1:] != doc[:-1]) | (m[1:] != m[:-1]) | ~travels[1:] | ~travels[:-1])))
    keep = travels[first]
    first, n = first[keep], n[keep]
    bucket = (m[first] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, n, bucket = first[order], n[order], bucket[order]
    begin, size = starts[windows[first]], ends[windows[first] + n + width - 2] - starts[windows[first]]
    at = (windows - rows[doc])[first].astype(np.int32)
    press = zstandard.ZstdCompressor(level=1)
    for i, k in zip(*_runs(np.concatenate(([True], bucket[1:] != bucket[:-1]))), strict=True) if len(bucket) else ():
        s = slice(i, i + k)
        yield {"bucket": int(bucket[i]), "ids": ids[doc[first[s]]].tobytes(), "keys": keys[doc[first[s]]].tobytes(), "at": at[s].tobytes(), "sizes": size[s].astype(np.int32).tobytes(), "packed": press.compress(data[ragged(begin[s], size[s])].tobytes()), "local": False}


def _windows(rows: list[dict], width: int) -> tuple[np.ndarray, ...]:
    """Of packed rows: both fingerprints of each window, its super-k-mer, and its place in that."""
    unpress = zstandard.ZstdDecompressor()
    sizes = np.frombuffer(b"".join(r["sizes"] for r in rows), np.int32)
    data = np.frombuffer(b"".join(unpress.decompress(r["packed"]) for r in rows), np.uint8)
    starts, ends, runs = word_spans(data, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
    counts = np.diff(runs) - width + 1
    windows, run = ragged(runs[:-1], counts), np.repeat(np.arange(len(counts)), counts)
    return *_fingerprints(span_hash(data, starts, ends), windows, width), run, windows - runs[run]


def _count(rows: list[dict], width: int, most: int = 16 << 20) -> tuple[np.ndarray, ...]:
    """The repeated ranges among the super-k-mers of one bucket.

    A bucket of more than `most` bytes is gone through several times, each time for a share of the fingerprints, so that
    besides the packed rows no more than about `most` bytes are unpacked, and that much sorted, at a time.
    """
    ids, keys, at, sizes = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("ids", np.int64), ("keys", np.int64), ("at", np.int32), ("sizes", np.int32)))
    held = np.array([int(np.frombuffer(r["sizes"], np.int32).sum(dtype=np.int64)) for r in rows])
    shares = 1 + int(held.sum()) // most
    part = np.cumsum(held) // most if shares > 1 else np.zeros(len(rows), np.int64)
    runs, places = [], []
    for share in range(shares):
        seen = []
        before = 0
        for p in np.unique(part):
            some = [rows[i] for i in np.flatnonzero(part == p)]
            one, two, run, place = _windows(some, width)
            mine = np.flatnonzero(one % U64(shares) == share) if shares > 1 else slice(None)
            seen.append((one[mine], two[mine], run[mine] + before, place[mine]))
            before += sum(len(r["sizes"]) // 4 for r in some)
        one, two, run, place = (np.concatenate(x) for x in zip(*seen, strict=True))
        found = _smallest(one, two, ids[run]) < ids[run] if len(one) else np.zeros(0, bool)
        runs.append(run[found])
        places.append(place[found])
    run, place = np.concatenate(runs), np.concatenate(places)
    if shares > 1:
        order = np.lexsort((place, run))
        run, place = run[order], place[order]
    r, a, z = _merged(run, place, width)
    return ids[r], keys[r], at[r] + a, at[r] + z


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, mer: int = 4) -> DataFrame:
    """Word ranges (id, key, first, past) covered by a window that a document with a smaller id has too.

    key is a hash of the text; it keeps apart rows that share an id. The ranges of a document may overlap.
    """
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    buckets = 8 * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "keys", "at", "sizes", "packed")), ("local", pa.bool_())])
        for batch in batches:
            for part in in_slices(batch, "text"):
                rows = list(_pack(part, width, mer, buckets))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, keys, first, past):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, t)) for x, t in ((ids, np.int64), (keys, np.int64), (first, np.int32), (past, np.int32))], ["id", "key", "first", "past"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["local"]:
                    yield out(*(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("keys", np.int64), ("at", np.int32), ("sizes", np.int32))))
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield out(*_count(held, width))
                    held = []
                held.append(row)
        if held:
            yield out(*_count(held, width))

    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    packed = texts.mapInArrow(pack, PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(count, RANGES)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, mer: int = 4) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (its remaining words joined by one space).

    The ranges are written to the shared folder before they are joined to the texts, so the packed strings' shuffle
    files can go before the texts are shuffled.
    """
    ranges = written(repeated_ranges(df, id_col, text_col, width, mer), "ranges")
    ranges = ranges.groupBy("id", "key").agg(F.collect_list(F.struct("first", "past")).alias("ranges"))
    texts = df.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, cut in zip(*(batch.column(c).to_pylist() for c in ("own", "text", "ranges")), strict=True):
                words = (text or "").encode().split()
                gone = 0
                if cut:
                    stay = np.ones(len(words), bool)
                    for r in cut:
                        stay[r["first"] : r["past"]] = False
                    gone = len(words) - int(stay.sum())
                    kept = [words[i] for i in np.flatnonzero(stay)]
                else:
                    kept = words
                out.append((doc, len(words), gone, b" ".join(kept)))
            a = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return texts.join(ranges, ["id", "key"], "left").select("own", "text", "ranges").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


def brute_force(rows: list[tuple[int | None, str | None]], width: int = 13) -> pd.DataFrame:
    """The same by a dictionary of all windows, for tests."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in ((NULL_ID if i is None else i, w) for i, w in split):
        for k in range(len(w) - width + 1):
            least[tuple(w[k : k + width])] = min(i, least.get(tuple(w[k : k + width]), i))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < (NULL_ID if i is None else i) for j in range(k, k + width)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"])
