"""Near-duplicate detection by DartMinHash over word shingles.

Darts fall on the plane of weight and time as a Poisson process of its own for each element, hashed from the element, so
every document that has the element sees the same darts. An element of weight w owns the region below w; weights are cut
at powers of two into boxes, and a box that a document's element does not reach is never drawn. A document throws the
darts of its elements up to a time at which about t (ln t + 5) fall into its regions, files each by a hashed coordinate
of t, and keeps the earliest of each; documents with an empty coordinate go on to twice the time. Two documents agree on
a coordinate with probability equal to their weighted Jaccard similarity, at a cost of elements + t log t per document.

Signatures are cut into bands. Texts that are equal are one class from the start, by their hash; each class enters the
bands once, as a node that is a 64-bit hash of its text, and ids count only when the components are known. In each band
bucket every member is compared with the bucket's smallest member, its hub; the shingle sets are compared exactly. What
is linked then forms components, and a bucket of many copies costs one comparison each. Members of a bucket that are
still in different components are compared with each other only where a bound on their similarity, from how each departs
from the hub, leaves a link possible (see _apart), so no link between different texts that share a bucket is lost.

Defined results: words are runs of characters other than ASCII white space, unchanged; a text of fewer words than a
shingle has one shingle of all its words; texts without words are alike only when equal; null texts equal each other and
are apart from empty ones; a null id counts as larger than every other id; rows with the same id and text get the same
class, and different texts are apart unless linked, also where their ids are null or repeated; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Powers, components, grouped, in_slices, lean, mix, ragged, run_hash, shuffle_parts, span_hash, utf8, word_spans, written

SHINGLES = Powers(0x8EBC6AF09C88C6E3)
SLOT = 300_000  # shingles that are sorted at a time
BLOCKS = 16  # stretches of a hub's text in which lost shingles are counted


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all rows, repeats included, and how many each row has."""
    starts, ends, rows = word_spans(data, offsets)
    h = span_hash(data, starts, ends)
    words = np.diff(rows)
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    at = ragged(rows[:-1], n)
    size = np.repeat(np.minimum(words, width), n)
    return run_hash(h, at, size, SHINGLES), n


def counted(elements: np.ndarray, n: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct elements of each row: elements, rows, counts; and where each comes first in its row."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (r[1:] != r[:-1])))) if len(e) else np.zeros(0, np.int64)
    out = e[new], r[new], np.diff(np.append(new, len(e)))
    return (*out, order[new] - (np.cumsum(n) - n)[r[new]]) if places else out


def dart_minhash(elements: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, t: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows x t) of weighted sets given as parallel arrays, elements distinct in each row; and which rows have one.

    A coordinate holds the earliest dart's time in its high 32 bits and the dart's hash in the low ones.
    """
    out = np.full((rows, t), np.uint64(0xFFFFFFFFFFFFFFFF))
    total = np.bincount(row, weight, rows)
    has = total > 0
    todo, until = np.flatnonzero(has), t * (np.log(t) + 5)
    # boxes of weight: [0, 1), [1, 2), [2, 4), ...
    while len(todo):
        flat = out[todo].reshape(-1)
        place = np.full(rows, -1)
        place[todo] = np.arange(len(todo))
        mine = place[row] >= 0
        e, r, w = elements[mine], place[row[mine]], weight[mine]
        limit = (until / total[todo])[r]
        box, low, high = 0, 0.0, 1.0
        while len(e):
            now, at, k = np.zeros(len(e)), np.arange(len(e)), 0
            base = mix(e + U64(seed * 1_000_003 + box * 7919))
            while len(at):
                h = mix(base[at] + U64(k))
                now = now - np.log(((h >> U64(11)).astype(float) + 0.5) / (1 << 53)) / (high - low)
                go = now <= limit[at]
                at, now, h = at[go], now[go], mix(h[go])
                inside = low + (high - low) * ((h >> U64(40)).astype(float) / (1 << 24)) < w[at] if box or (w < 1).any() else slice(None)
                key = (now[inside].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (h[inside] & U64(0xFFFFFFFF))
                where = r[at[inside]] * t + ((mix(h[inside]) >> U64(33)) % U64(t)).astype(np.int64)
                np.minimum.at(flat, where, key)
                k += 1
            reach = w > high
            e, r, w, limit = e[reach], r[reach], w[reach], limit[reach]
            box, low, high = box + 1, high, high * 2
        flat = flat.reshape(-1, t)
        out[todo] = flat
        todo = todo[(flat == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)]
        until *= 2
    return out, has


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each row."""
    per = signatures.shape[1] // bands
    x = signatures[:, : per * bands].reshape(len(signatures), bands, per)
    h = np.zeros(x.shape[:2], U64) + np.arange(bands, dtype=U64)
    for k in range(per):
        h = mix(h ^ x[:, :, k])
    return h


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, bands: int, per_band: int, weighted: bool) -> DataFrame:
    """id, copy (the text's hash), bands (null without words)."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.md5(text_col), F.lit("null")).alias("copy"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                found, n = shingles(*utf8(part.column("text")), width)
                e, r, c = counted(found, n)
                s, has = dart_minhash(e, r, c.astype(float) if weighted else np.ones(len(e)), part.num_rows, bands * per_band)
                keys = band_keys(s, bands).view(np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copy"), column], ["id", "copy", "bands"])

    return texts.mapInArrow(lean(sign), "id long, copy string, bands array<long>")


def _scored(pairs: DataFrame, texts: DataFrame, width: int, weighted: bool) -> DataFrame:
    """The pairs (a, b) of nodes with the exact Jaccard similarity of their shingles, and how b's departs from a's.

    base: shingles of a; lost: those of them that b lacks, by BLOCKS stretches of a's text; more: shingles of b that a lacks.
    The texts travel, as they compress better than shingle hashes.
    """
    both = pairs.hint("merge").join(texts.withColumnsRenamed({"node": "a", "text": "left"}), "a").hint("merge").join(texts.withColumnsRenamed({"node": "b", "text": "right"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "left"):
                n = part.num_rows
                found, many = shingles(*utf8(part.column("left")), width)
                le, lr, lc, place = counted(found, many, places=True)
                re_, rr, rc = counted(*shingles(*utf8(part.column("right")), width))
                if not weighted:
                    lc, rc = np.ones(len(le), np.int64), np.ones(len(re_), np.int64)
                e, r, c, side = np.concatenate((le, re_)), np.concatenate((lr, rr)), np.concatenate((lc, rc)), np.repeat((0, 1), (len(le), len(re_)))
                order = np.lexsort((side, e, r))
                e, r = e[order], r[order]
                twin = np.flatnonzero((e[1:] == e[:-1]) & (r[1:] == r[:-1]))
                common = np.minimum(c[order[twin]], c[order[twin + 1]])
                shared = np.bincount(r[twin], common, n)
                mine, others = np.bincount(lr, lc, n), np.bincount(rr, rc, n)
                lost = lc.copy()
                lost[order[twin]] -= common
                blocks = np.bincount(lr * BLOCKS + place * BLOCKS // np.maximum(many, 1)[lr], lost, n * BLOCKS).astype(np.int32)
                score = shared / np.maximum(mine + others - shared, 1)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BLOCKS + 1, BLOCKS, dtype=np.int32)), pa.array(blocks))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(score), pa.array(mine.astype(np.int64)), column, pa.array((others - shared).astype(np.int64))], ["a", "b", "score", "base", "lost", "more"])

    return both.select("a", "b", "left", "right").mapInArrow(lean(compare), "a long, b long, score double, base long, lost array<int>, more long")


def _alone(texts: DataFrame, width: int, weighted: bool, slots: int) -> DataFrame:
    """(node, alone): how many of each text's shingles no other of the texts has.

    Shingles travel packed, by a slot of their hash; one that a slice of texts has twice travels once, as shared. A task
    holds one slot at a time.
    """
    parts = shuffle_parts(texts.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                nodes = part.column("node").to_numpy()
                e, r, c = counted(*shingles(*utf8(part.column("text")), width))
                seen, first, number = grouped(e)
                owner = np.where(np.bincount(number, minlength=len(seen)) == 1, r[first], -1)
                slot = (seen % U64(slots)).astype(np.int32)
                order = np.argsort(slot, kind="stable")
                begin = np.flatnonzero(np.concatenate(([True], np.diff(slot[order]) != 0))) if len(order) else order
                rows = []
                for take in np.split(order, begin[1:]) if len(order) else ():
                    whose = owner[take]
                    rows.append({"slot": int(slot[take[0]]), "grams": seen[take].tobytes(), "nodes": np.where(whose >= 0, nodes[whose], 0).tobytes(), "counts": np.where(whose >= 0, c[first[take]] if weighted else 1, 0).astype(np.int32).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("slot", pa.int32()), ("grams", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary())]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            grams, nodes, counts = (np.frombuffer(b"".join(x[c] for x in rows), t) for c, t in (("grams", U64), ("nodes", np.int64), ("counts", np.int32)))
            _, first, number = grouped(grams)
            once = first[np.bincount(number) == 1]
            once = once[counts[once] > 0]
            who, at = np.unique(nodes[once], return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.bincount(at, counts[once], len(who)).astype(np.int64))], ["node", "alone"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["slot"] != row["slot"]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    packed = texts.select("node", "text").mapInArrow(lean(pack), "slot int, grams binary, nodes binary, counts binary").repartition(parts, "slot").sortWithinPartitions("slot")
    return packed.mapInArrow(lean(settle), "node long, alone long").groupBy("node").agg(F.sum("alone").alias("alone"))


def _facing(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A hub's texts outside of its largest component, in blocks, and all its texts, once for each block."""
    left = met.filter("outside").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    return left, met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def _apart(scores: DataFrame, parts: DataFrame, texts: DataFrame, width: int, least: float, weighted: bool, block: int = 2000) -> DataFrame:
    """Pairs (a, b) of texts that met the same hub, are in different components and may still be a link.

    Let x and y depart from a hub of `base` shingles by what they lost and what they have more. Then

        |x & y| = base - lost(x) - lost(y) + |lost(x) & lost(y)| + |more(x) & more(y)|,

    and J(x, y) >= least asks for |x & y| >= share (|x| + |y|) with share = least / (1 + least). Shingles that no other
    text has are in no intersection, and what two texts lost in a stretch of the hub is at most the lesser of the two
    numbers. That bounds the right side from above; pairs it rules out are no links, so none is lost. A pair is judged
    under the first hub that both have met (by the number of texts that met the hub), since one bound is enough.

    Of two texts in different components one at least is outside of the hub's largest component. So those outside are
    on one side and all of the hub's texts on the other: for one outlier among n copies n rows meet one.
    """
    share = least / (1 + least)
    placed = scores.join(parts.withColumnsRenamed({"node": "b", "component": "part"}), "b", "left")
    placed = placed.withColumn("part", F.coalesce("part", "b"))
    sizes = placed.groupBy("a", "part").agg(F.count("*").alias("size"))
    hubs = sizes.groupBy("a").agg(F.sum("size").alias("n"), F.max(F.struct("size", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    hubs = hubs.select("a", (-F.col("n")).alias("rank"), F.col("largest.part").alias("largest"), F.ceil((F.col("n") - F.col("largest.size")) / block).cast("int").alias("blocks"))
    met = written(placed.join(hubs, "a").select("a", "b", "rank", "blocks", "part", (F.col("part") != F.col("largest")).alias("outside"), "base", "lost", "more"), "met")
    nodes = met.select(F.col("b").alias("node")).union(met.select("a")).distinct()
    slots = 1 + (met.agg(F.sum("base")).first()[0] or 0) // SLOT
    alone = _alone(texts.hint("merge").join(nodes.hint("merge"), "node", "left_semi"), width, weighted, slots)
    by_node = met.groupBy("b").agg(F.collect_set(F.struct("rank", "a")).alias("hubs")).hint("merge").join(alone.withColumnRenamed("node", "b").hint("merge"), "b", "left")  # a text meets a hub in each band at most
    met = met.hint("merge").join(by_node.hint("merge"), "b")
    some = F.col("more") - F.least(F.coalesce("alone", F.lit(0)), "more")
    gone = F.aggregate("lost", F.lit(0), lambda s, x: s + x)
    # base * (1 - 2 share) - c(x) - c(y) + shared >= 0 with c = (1 - share) lost + share more
    met = met.withColumns({"cost": (1 - share) * gone + share * F.col("more"), "some": some, "room": F.col("base") * (1 - 2 * share), **{f"l{i}": F.col("lost")[i] for i in range(BLOCKS)}}).drop("lost", "more", "alone", "base")
    met = written(met, "departures")
    left, right = _facing(met)
    one, two = left.alias("x"), right.drop("room", "rank").alias("y")
    shared = F.least("x.some", "y.some")
    for i in range(BLOCKS):
        shared = shared + F.least(f"x.l{i}", f"y.l{i}")
    first = F.array_min(F.array_intersect("x.hubs", "y.hubs"))["a"]
    may = (~F.col("y.outside") | (F.col("x.b") < F.col("y.b"))) & (F.col("x.part") != F.col("y.part")) & (F.col("x.room") - F.col("x.cost") - F.col("y.cost") + shared >= -1e-6) & (first == F.col("x.a"))
    pairs = one.hint("merge").join(two, (F.col("x.a") == F.col("y.a")) & (F.col("x.block") == F.col("y.block")) & may)
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, bands: int = 32, per_band: int = 6, weighted: bool = True) -> DataFrame:
    """One row per row of df: doc_id, copy (hash of its text), class_id, the smallest id of the documents tied to it by links,
    and root, the copy of the text that stands for the class: of those with that id the one whose hash sorts first.

    A link is a weighted Jaccard similarity of `least` or more, a shingle of `width` words weighing as often as the text
    has it (not `weighted`: 1, so sets are compared). With 32 bands of 6 a pair at 0.8 shares no bucket with probability 6e-5.
    """
    signed = written(signatures(df, id_col, text_col, width, bands, per_band, weighted), "signatures")
    no_id = F.col("id").isNull().alias("no_id")  # a null id comes after every other id
    classes = signed.groupBy("copy").agg(F.min(F.struct(no_id, "id"))["id"].alias("id"), F.first("bands").alias("bands")).withColumn("node", F.xxhash64("copy"))
    rows = written(classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key")), "bands")
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    candidates = written(rows.join(hubs, "key").filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "candidates")
    near = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    own = F.coalesce("id", F.lit(0)).alias("own")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.md5(text_col).alias("copy"), F.col(text_col).alias("text")).select(no_id, own, "copy", "text")
    # of rows with equal texts, one with the smallest id
    chosen = classes.select("node", "id", "copy").join(near.hint("merge"), "node", "left_semi").select(no_id, own, "copy")
    texts = texts.join(chosen.hint("merge"), ["no_id", "own", "copy"], "left_semi").dropDuplicates(["no_id", "own", "copy"]).select(F.xxhash64("copy").alias("node"), "text")
    texts = written(texts, "texts")
    scores = written(_scored(candidates, texts, width, weighted), "scores")
    links = scores.filter(F.col("score") >= least - 1e-12).select("a", "b")
    parts = components(links)
    more = written(_apart(scores, parts, texts, width, least, weighted).join(candidates, ["a", "b"], "left_anti"), "pairs")
    more = written(_scored(more, texts, width, weighted).filter(F.col("score") >= least - 1e-12).select("a", "b"), "links")
    found = components(links.unionAll(more))
    tied = classes.select("node", "id", "copy").join(found, "node", "left").select("id", "copy", F.coalesce("component", "node").alias("part"))
    first = tied.groupBy("part").agg(F.min(F.struct(no_id, "id", "copy")).alias("first"))
    roots = tied.join(first.hint("merge"), "part").select("copy", F.col("first.id").alias("class_id"), F.col("first.copy").alias("root"))
    out = signed.select("id", "copy").join(roots.hint("merge"), "copy")
    return out.select(F.col("id").alias("doc_id"), "copy", "class_id", "root")


def brute_force(rows: list[tuple[int, str | None]], width: int = 5, least: float = 0.8, weighted: bool = True) -> dict[int, int]:
    """Class of each id by comparing all pairs that share a shingle, for tests."""

    def bag(t: str | None) -> Counter:
        w = (t or "").encode().split()
        found = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or Counter([tuple(w)] if w else [])
        return found if weighted else Counter(found.keys())

    s, root = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    text = dict(rows)
    where: dict[tuple, list[int]] = {}
    for i, x in s.items():
        for g in x:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b} | {(a, b) for a in s for b in s if a < b and text[a] == text[b]}
    for a, b in pairs:
        if text[a] == text[b] or s[a] and (s[a] & s[b]).total() >= least * (s[a] | s[b]).total() - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in s}
