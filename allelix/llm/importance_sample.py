"""Target-distribution importance resampling: documents drawn by how much more their word runs look like a target's.

Features are runs of one to three words, hashed to a bounded number of buckets. One pass counts the buckets of all
documents, another those of the target; the gain of a bucket is the logarithm of the ratio of its smoothed shares, in
thousandths, rounded down. A second pass over the documents adds up gains, looked up in an array that is as long as
there are buckets. Gumbel noise from a hash of the id makes the highest scores a sample without replacement.

Scores are integers, so ranks come from a histogram of them that is exact: equal scores are counted, cut into ranges of
score, the ranges' sums give each range its rank, and the range that holds the last rank its cut-off score. Only rows at
that score or above are ranked: by the suffix sum of the counts of higher scores, then by id within a score.

Defined results: a null text has no words; a null id hashes as an empty one and comes after all others; rows with equal
id, score, weight and number of features are interchangeable, each has a rank of its own; other columns are ignored; an
empty table gives an empty result, an empty target the gains of one without features.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, lean, repeated, shuffle_parts, utf8, word_spans, written

BUCKETS, LONGEST, SCALE, SEED = 10_000, 3, 1000, 42
MOST_STEPS = 64  # bytes of a word that all words go through together
WORDS_AT_ONCE = 1 << 18

#: Bytes that part words: ASCII other than digits and, once lower-cased, letters.
GAPS = np.ones(256, bool)
GAPS[0x30:0x3A] = GAPS[0x61:0x7B] = GAPS[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC, ALL = _crc_table(), np.uint32(0xFFFFFFFF)


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The states of a crc32 after one more word each."""
    order = np.argsort(-sizes, kind="stable")
    s, at, size = state[order], starts[order], sizes[order]
    for k in range(min(MOST_STEPS, int(size[0]) if len(size) else 0)):
        m = int(np.searchsorted(-size, -k, "left"))  # words that have a byte k
        s[:m] = CRC[(s[:m] ^ data[at[:m] + k]) & 255] ^ (s[:m] >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -MOST_STEPS, "left"))):
        s[i] = zlib.crc32(data[at[i] + MOST_STEPS : at[i] + size[i]], int(s[i] ^ ALL)) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def buckets_of(column, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of a text column, in runs of a bounded number of words."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, GAPS)
    for a in range(0, len(starts), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(starts))
        s, n = starts[a : b + LONGEST - 1], (ends - starts)[a : b + LONGEST - 1]
        row = np.searchsorted(first, np.arange(a, a + len(s)), "right") - 1
        i = np.arange(len(s))  # first words of the runs
        state = _fed(np.full(len(s), ALL, np.uint32), data, s, n)
        for k in range(LONGEST):
            if k:
                go = (i + k < len(s)) & (row[np.minimum(i + k, len(s) - 1)] == row[i])
                i, state = i[go], state[go]
                state = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
                state = _fed(state, data, s[i + k], n[i + k])
            own = i < b - a
            yield row[i[own]], ((state[own] ^ ALL) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; a task sends its buckets' counts, which are added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in in_slices(batch, "text"):
                for _, bucket in buckets_of(part.column("text"), buckets):
                    n += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(column).alias("text")).mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths: the logarithm of its share in the target over that in the source, both smoothed by one."""
    k = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                n, weight, words = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for k, (row, bucket) in enumerate(buckets_of(part.column("text"), len(gains))):
                    found = np.bincount(row, minlength=part.num_rows)
                    n += found
                    words += found if k % LONGEST == 0 else 0
                    np.add.at(weight, row, gains[bucket])
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, (words, n, weight))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(add), f"id {kind}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def ranked(rows: DataFrame, among: Column, percent: int = 5, ranges: int | None = None) -> DataFrame:
    """rows (id, score and further columns) with rank: 1, 2, 3 ... by descending score, then id, of the first percent of those among; else null."""
    ranges, names = ranges or min(512, shuffle_parts(rows.sparkSession)), rows.columns
    hist = written(rows.filter(among).groupBy("score").agg(F.count("*").alias("n")), "scores")
    total = hist.agg(F.sum("n")).first()[0] or 0
    draw = percent * total // 100
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return none
    cuts = hist.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("score")))
    placed = hist.withColumn("range", at)
    sums = sorted(((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect()), reverse=True)  # a row for each range
    before, above = {}, 0
    for k, n in sums:
        if above < draw:
            before[k] = above
        above += n
    start = F.element_at(F.create_map(*(F.lit(x) for k, n in before.items() for x in (k, n))), F.col("range"))
    down = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    higher = placed.filter(F.col("range").isin(list(before))).withColumn("higher", start + F.coalesce(F.sum("n").over(down), F.lit(0)))
    # the scores that have a rank, with the number of rows above each
    scores = written(higher.filter(F.col("higher") < draw).select("score", "higher"), "surviving")
    cutoff = scores.agg(F.min("score")).first()[0]
    in_play = among & (F.col("score") >= cutoff)
    alike = rows.filter(in_play).groupBy(*names).agg(F.count("*").alias("times")).join(scores, "score")
    upto = F.sum("times").over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), *(n for n in names if n not in ("id", "score"))))
    each = repeated(alike.withColumn("first", F.col("higher") + upto - F.col("times")), "times", "number")
    rank = F.col("first") + F.col("number")
    return none.filter(~F.coalesce(in_play, F.lit(False))).unionAll(each.select(*names, F.when(rank <= draw, rank).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: its id, n_features, weight, score and rank, null where it is not drawn.

    Drawn are percent of the documents with least_words words or more. The texts are read twice, and what is weighed is
    written once, as both the histogram and the ranking read it.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = written(weigh(docs, gains, id_col, text_col, seed), "weighed")
    out = ranked(rows, F.col("n_words") >= least_words, percent)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB SQL of the registered query. crc32 is spelled out, by a table of 256 made from its polynomial, for each distinct feature."""
    return f"""with recursive crc as (
  select list(c order by i) as t from (select i, list_reduce([i] || range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(0, 256))::bigint as i))),
texts as (select 'd' as side, row_number() over () as n, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark),
worded as (select side, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
runs as (select side, n, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f from worded),
hashed as (select f, xor(list_reduce([4294967295::bigint] || list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::bigint), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} as bucket from (select distinct f from runs), crc),
counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from runs join hashed using (f) group by 1),
gains as (select bucket, floor({SCALE} * ln((t + 1)::double * ((select sum(s) from counts) + {BUCKETS})::double / ((s + 1)::double * ((select sum(t) from counts) + {BUCKETS})::double)))::bigint as gain from counts),
weights as (select n, count(*) as n_features, sum(gain)::bigint as weight from runs join hashed using (f) join gains using (bucket) where side = 'd' group by 1),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-{SCALE} * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score from worded left join weights using (n) where side = 'd'),
numbered as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as r, count(*) filter (n_words >= 20) over () as total from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * total // 100 then r end as rank from numbered"""


def brute_force(rows: list[tuple[int | None, str | None]], target: list[str | None], percent: int = 5, least_words: int = 20) -> list[tuple]:
    """The same one by one, for tests: (id, n_features, weight, score, rank), sorted."""

    def features(text: str | None) -> list[str]:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    def counted(texts) -> Counter:
        return Counter(zlib.crc32(f.encode()) % BUCKETS for t in texts for f in features(t))

    s, t = counted(x for _, x in rows), counted(target)
    big_s, big_t = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    out = []
    for k, text in rows:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in (zlib.crc32(f.encode()) % BUCKETS for f in found))
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), sum(" " not in f for f in found) >= least_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)
