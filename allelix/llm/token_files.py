"""Token-id output: flat unsigned integer files with 64-bit document offsets, read by memory mapping.

A dataset is a folder of shards in ascending id order. Shard s has `s.bin` (token ids, little endian, of 16 bits
if the vocabulary and the end id fit in them, else of 32) and `s.idx`
(document ids, then the offsets of the documents and the shard's end, both 64-bit). The manifest has one row per shard:
its documents, how many of them, its last ones, have a null id, its tokens, and the number of tokens in all shards
before it, a prefix sum over shards.

A shard is written under a name of the attempt and renamed when complete, so a task that runs twice leaves one whole
file. Ids are cut into ranges by Spark's range partitioning; a task holds one shard's offsets and the tokens of one
Arrow batch.

Ids are those of the tokenizers library at its defaults with add_special_tokens=False. Encoding goes through it piece by
piece: texts are cut where the tokenizer's own pre-tokenizer always cuts, and each distinct piece is encoded once and
kept in a table of bounded size. Texts that hold the text of an added token are encoded whole.

Defined results: a null text counts as empty and has the end id alone; a null document id comes last; rows with equal
ids keep an order by text hash; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, Grown, HashIndex, filesystem, grouped, in_slices, new_path, ragged, shuffle_parts, span_hash, sums, utf8

MOST_PIECES = 1_500_000  # distinct pieces that a worker keeps, told apart by a 64-bit hash

_MARK = np.zeros(256, bool)  # ASCII punctuation other than the apostrophe
_MARK[[c for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if c != 39]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_PLAIN = re.compile(r" \S")


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of Unicode white space."""
    white = SPACE[data]
    if len(data) > 2:
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        a, b, c = data[:-2], data[1:-1], data[2:]
        lead = np.flatnonzero((a == 0xE1) | (a == 0xE2) | (a == 0xE3))
        a, b, c = a[lead], b[lead], c[lead]
        three = lead[((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
        for k, at in ((0, two), (1, two), (0, three), (1, three), (2, three)):
            white[at + k] = True
    return white


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where to cut texts so that encoding the parts is encoding the text.

    The pre-tokenizer always cuts before a run of white space, and between a letter and ASCII punctuation other than
    the apostrophe.
    """
    white = _white(data)
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = (white[1:] & ~white[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
    start[offsets] = True
    return np.flatnonzero(start[:-1])


class Encoder:
    """Encodes the texts of an Arrow column to ids, and gives how many each text has."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(names.values()) + 1, np.int64)  # a token's name has a character for each of its bytes
        self.top = max([len(self.width) - 1, *self.tokenizer.get_added_tokens_decoder()])
        self.width[list(names.values())] = [len(n) for n in names]
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.at, self.size = HashIndex(), Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces. Those that begin with one space are encoded many at a time, as the text they make in a row, and told apart by their tokens' bytes."""
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            plain = [k for k, p in enumerate(part) if _PLAIN.match(p)]
            groups = [plain[j : j + 1000] for j in range(0, len(plain), 1000)]
            rest = sorted({*range(len(part))}.difference(plain))
            found = self.tokenizer.encode_batch_fast([*("".join(part[k] for k in g) for g in groups), *(part[k] for k in rest)], add_special_tokens=False)
            order = np.array([*plain, *rest], np.int64)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64)
            past = np.cumsum([len(part[k].encode()) for k in order])
            bytes_ = np.cumsum(self.width[ids])
            to = np.searchsorted(bytes_, past) + 1
            if not (bytes_[to - 1] == past).all():
                raise RuntimeError("a token spans two pieces")
            size = np.empty(len(part), np.int64)
            size[order] = np.diff(np.concatenate(([0], to)))
            at = np.empty(len(part), np.int64)
            at[order] = self.ids.n + np.concatenate(([0], to[:-1]))
            self.at.add(at)
            self.size.add(size)
            self.ids.add(ids.astype(np.uint32))

    def with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold an added token's text. The library matches these before it cuts pieces."""
        raw, found = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    found.append(row)
                    at = int(offsets[row + 1]) - 1
                at = raw.find(token, at + 1)
        return np.unique(np.array(found, np.int64))

    def mixed(self, column, whole: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As __call__, with the rows of `whole` encoded by the library as they stand."""
        n, is_whole = len(column), np.zeros(len(column), bool)
        is_whole[whole] = True
        texts = column.take(pa.array(whole)).to_pylist()
        runs = {int(r): np.append(np.array(e.ids, np.uint32), np.uint32(end_id)) for r, e in zip(whole, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        rest = np.flatnonzero(~is_whole)
        ids, sizes = self(column.take(pa.array(rest)), end_id) if len(rest) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        runs |= dict(zip(rest.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True)) if len(rest) else {}
        return np.concatenate([runs[k] for k in range(n)]), np.array([len(runs[k]) for k in range(n)], np.int64)

    def __call__(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id; and their numbers."""
        data, offsets = utf8(column)
        whole = self.with_added(data, offsets)
        if len(whole):
            return self.mixed(column, whole, end_id)
        starts = piece_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        h, first, number = grouped(span_hash(data, starts, ends))
        if self.known.n > MOST_PIECES:
            self.forget()
        found = self.known(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, at = data.tobytes(), first[new]
            self.learn([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[new] = self.known.add(h[new])
        piece = found[number]
        sizes = self.size.data[piece]
        rows = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
        total = sums(sizes)
        out = np.full(int(total[-1]) + len(offsets) - 1, end_id, np.uint32)
        out[ragged(total[:-1] + doc, sizes)] = self.ids.data[ragged(self.at.data[piece], sizes)]
        return out, np.diff(total[rows]) + 1


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if vocabulary not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


SHARD = "shard string, part int, n_docs long, n_null long, n_tokens long, first_id long"


def write_tokens(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Writes the dataset to path, and its manifest as a table there; returns the manifest with bases."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    dtype = "<u2" if max(encoder(vocabulary).top, end_id) < 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        fs, root = filesystem(path)
        part = TaskContext.get().partitionId()
        own, name = f"{root}/.attempt-{uuid.uuid4().hex}", f"shard-{part:06d}"
        encode, ids, sizes, out, n_null = encoder(vocabulary), [], [np.zeros(1, np.int64)], None, 0
        for batch in batches:
            for some in in_slices(batch, "text"):
                if out is None:
                    fs.create_dir(own, recursive=True)
                    out = fs.open_output_stream(f"{own}/bin")
                ids.append(some.column("id").to_numpy())
                n_null += some.column("no_id").true_count
                tokens, n = encode(some.column("text"), end_id)
                out.write(tokens.astype(dtype).tobytes())
                sizes.append(n)
        if out is None:
            return
        out.close()
        every, offsets = np.concatenate(ids).astype("<i8"), np.cumsum(np.concatenate(sizes))
        with fs.open_output_stream(f"{own}/idx") as f:
            f.write(every.tobytes() + offsets.astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{own}/{kind}", f"{root}/{name}.{kind}")
        fs.delete_dir(own)
        yield pa.RecordBatch.from_pylist([{"shard": name, "part": part, "n_docs": len(every), "n_null": n_null, "n_tokens": int(offsets[-1]), "first_id": int(every[0])}], pa.schema([("shard", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64())]))

    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    # rows without id share one place in the order, and are dealt by their texts
    ordered = texts.repartitionByRange(shards or shuffle_parts(spark), "no_id", "id", "key").sortWithinPartitions("no_id", "id", "key")
    rows = sorted(ordered.mapInArrow(write, SHARD).collect(), key=lambda r: r["part"])  # one row for each shard
    base, manifest = 0, []
    for r in rows:
        manifest.append({**r.asDict(), "base": base})
        base += r["n_tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "n_tokens": base, "shards": manifest}).encode())
    return spark.createDataFrame(manifest, SHARD + ", base long")


class Shard:
    """A shard's ids, offsets and tokens; local files are memory-mapped, others read by ranges."""

    def __init__(self, path: str, name: str, n_docs: int, dtype: str):
        fs, root = filesystem(path)
        self.n_docs, self.dtype, self.tokens = n_docs, np.dtype(dtype), None
        if isinstance(fs, pafs.LocalFileSystem):
            self.index, self.tokens = np.memmap(f"{root}/{name}.idx", "<i8", "r"), np.memmap(f"{root}/{name}.bin", dtype, "r")
        else:
            self.index, self.file = np.frombuffer(fs.open_input_file(f"{root}/{name}.idx").read(), "<i8"), fs.open_input_file(f"{root}/{name}.bin")
        self.ids, self.offsets = self.index[:n_docs], self.index[n_docs:]

    def run(self, first: int, past: int) -> list[np.ndarray]:
        """The tokens of documents first .. past - 1."""
        a, z = int(self.offsets[first]), int(self.offsets[past])
        size = self.dtype.itemsize
        tokens = self.tokens[a:z] if self.tokens is not None else np.frombuffer(self.file.read_at((z - a) * size, a * size), self.dtype)
        return [tokens[p - a : q - a] for p, q in zip(self.offsets[first:past].tolist(), self.offsets[first + 1 : past + 1].tolist(), strict=True)]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in file order: doc_id, start, n_tokens, tokens (end id included, as 32-bit little-endian integers)."""
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    shards = spark.createDataFrame([(s["shard"], s["n_docs"], s["n_docs"] - s["n_null"], s["base"]) for s in manifest["shards"]], "shard string, n_docs long, n_ids long, base long").repartition(max(1, len(manifest["shards"])), "shard")
    dtype = manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(path, row["shard"], row["n_docs"], dtype)
                for i in range(0, row["n_docs"], 500):
                    k = range(i, min(i + 500, row["n_docs"]))
                    ids = s.ids[k.start : k.stop]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.arange(k.start, k.stop) >= row["n_ids"]), pa.array(row["base"] + s.offsets[k.start : k.stop]), pa.array(np.diff(s.offsets[k.start : k.stop + 1])), pa.array([x.astype("<u4").tobytes() for x in s.run(k.start, k.stop)], pa.binary())], ["doc_id", "start", "n_tokens", "tokens"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, tokens binary")


def brute_force(rows: list[tuple[int, str | None]], vocabulary: str, end_id: int = 0) -> list[tuple[int, int, int, int]]:
    """Digest rows by encoding each whole text at once, for tests."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(vocabulary), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def token_dataset(df: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Writes df's tokens to a new folder in the shared folder and reads them back."""
    path = new_path(df.sparkSession, "tokens")
    write_tokens(df, path, vocabulary, **how)
    return read_tokens(df.sparkSession, path)
