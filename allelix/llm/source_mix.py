"""Mixing sources to target weights: copies of documents by pivotal dependent rounding over a reduction tree.

Each source has a target size: shares by weight, none above a stated multiple of what the source has, the excess shared
again among the others. Its documents are to be taken target / size times each: a whole number of copies, and one more
with a probability. Pivotal rounding makes that one more a draw which keeps the source's taken size: of two documents
with open probabilities, size moves from one to the other, as much as makes one probability zero or one, in the
direction that a coin says whose odds keep both expectations. What is settled is settled; the other one goes on.

Blocks of a source's documents are reduced first, each to one open document; these are dealt to blocks of blocks, and so
on up to one open document by source, whose chance is rounded to the nearer of zero and one. So a block never holds more than its share of rows,
whatever a source's size, and a source's taken size differs from its target by half a document at most. Large documents
are settled first, so that the last one tends to be small. Coins come from the place in the tree, so reruns agree.

Rows of equal id, source and size are interchangeable and reduced as one row with a count: what they are to be taken
together is a whole number and a rest, and only the rest enters the tree.

Defined results: a null text has size 0 and is taken 0 words; null sources are one source, the last; null ids are ids
like others, last; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.model import numbered

from .common import in_slices, lean, repeated, utf8, with_totals, word_spans, written

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 1000, 11


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size) of each row; size is the number of words."""
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                _, _, first = word_spans(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), pa.array(np.diff(first))], ["id", "source", "size"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(count), f"id {kinds[id_col]}, source {kinds[source_col]}, size long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size, ...) with number, 0-based by code point and null last, and target.

    All targets that are not stopped are weight x level. A level too high for a source stops it at most times its size,
    and what is left makes the next level of the others, so levels rise until no more sources stop; each is two sums.
    """
    rows = written(numbered(sources, by=F.col("source").asc_nulls_last()).withColumn("number", F.col("_ord") - 1).drop("_ord"), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    whole = lambda c: c.cast("decimal(38,0)")
    rows = rows.withColumn("weight", weight)
    first = rows.agg(F.sum(whole(F.col("source_size"))).alias("total"), F.sum("weight").alias("weights")).first()
    total, level, stopped = int(first["total"] or 0), Fraction(int(first["total"] or 0), first["weights"] or 1), -1
    while True:
        stops = whole(F.col("source_size")) * F.lit(most * level.denominator).cast("decimal(18,0)") <= whole(F.col("weight")) * F.lit(level.numerator).cast("decimal(19,0)")
        r = rows.agg(F.count_if(stops).alias("n"), F.sum(F.when(stops, whole(F.col("source_size")))).alias("held"), F.sum(F.when(~stops, F.col("weight"))).alias("weights")).first()
        if r["n"] == stopped or not r["weights"]:
            break
        stopped, level = r["n"], Fraction(total - most * int(r["held"] or 0), r["weights"])
    open_target = F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return rows.withColumn("target", F.when(stops, (F.col("source_size") * most).cast("double")).otherwise(open_target)).drop("weight")


def settle(size: np.ndarray, chance: np.ndarray, coins: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Of documents with open chances: those settled as 0 or 1 (-1: the one that is left), which is left, its chance.

    From the largest on, the open one meets the next. The sum of size x chance stays.
    """
    out, open_at, p = np.full(len(size), -1), 0, float(chance[0])
    sizes_, chances, coins_ = size.tolist(), chance.tolist(), coins.tolist()
    for j in range(1, len(sizes_)):
        if open_at < 0:
            open_at, p = j, chances[j]
            continue
        a, b, q = sizes_[open_at], sizes_[j], chances[j]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # size that can go to the open one, and from it
        if coins_[j] * (up + down) < down:
            p, q = (1.0 if (1 - p) * a <= q * b else p + up / a), (0.0 if q * b <= (1 - p) * a else q - up / b)
        else:
            p, q = (0.0 if p * a <= (1 - q) * b else p - down / a), (1.0 if (1 - q) * b <= p * a else q + down / b)
        if 0 < p < 1:
            out[j] = q
        elif 0 < q < 1:
            out[open_at], open_at, p = p, j, q
        else:
            out[open_at], out[j], open_at = p, q, -1
    return out, open_at, p


OPEN = "number long, block long, first_block long, id_text string, size long, chance double, extra int"


def _level(rows: DataFrame, depth: int, last: bool, seed: int) -> DataFrame:
    """One level of the tree: rows (number, block, ...) with extra set for all but one open row of each block, and for that one too if last."""

    def reduce(group: pa.Table) -> pa.Table:
        # a total order of the rows, whatever order they came in
        group = group.sort_by([("size", "descending"), ("id_text", "ascending"), ("first_block", "ascending")])
        size, chance = group.column("size").to_numpy(), group.column("chance").to_numpy()
        coins = np.random.default_rng([seed, depth, group.column("number")[0].as_py(), group.column("block")[0].as_py()]).random(len(size))
        found, left, p = settle(size, chance, coins)
        chance = chance.copy()
        if left >= 0:
            chance[left] = p
            if last:
                found[left] = int(p >= 0.5)
        extra = pa.array(found, pa.int32(), mask=found < 0)
        return group.set_column(group.schema.get_field_index("chance"), "chance", pa.array(chance)).set_column(group.schema.get_field_index("extra"), "extra", extra)

    return rows.groupBy("number", "block").applyInArrow(reduce, rows.schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: its id, size, source_size, target (its source's), copies, taken = copies x size."""
    alike = written(sizes(docs, id_col, text_col, source_col).groupBy("id", "source", "size").agg(F.count("*").alias("times")), "sizes")
    per_source = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("rows"))
    goal = written(targets(per_source, weights, most), "targets")
    rows = with_totals(alike, goal, "source", "rows").withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0))
    base, rest = F.floor("rate"), (F.col("rate") - F.floor("rate")) * F.col("times")
    rows = rows.withColumns({"base": base, "sure": F.floor(rest), "chance": F.when(F.col("size") > 0, rest - F.floor(rest)).otherwise(0.0)})
    blocks = F.ceil(F.col("rows") / block)
    rows = rows.withColumns({"id_text": F.coalesce(F.col("id").cast("string"), F.lit("")), "block": F.pmod(F.xxhash64("id", "size"), blocks).cast("long"), "first_block": F.lit(0).cast("long"), "extra": F.when(F.col("chance") <= 0, F.lit(0)).cast("int")})
    widest = -(-(goal.agg(F.max("rows")).first()[0] or 0) // block)
    keep = [c for c in rows.columns if c not in ("rows", "rate")]
    closed = rows.filter("extra is not null").select(keep)
    opened = rows.filter("extra is null").select(keep)
    level = written(_level(opened, 0, widest <= 1, seed), "level")
    leaves, found, depth = level, [], 0
    while widest > 1:
        # the open row of each block goes on, among those of `block` blocks
        up = level.filter("extra is null").select("number", F.floor(F.col("block") / block).cast("long").alias("block"), (F.col("block") if depth == 0 else F.col("first_block")).alias("first_block"), "id_text", "size", "chance", "extra")
        widest, depth = -(-widest // block), depth + 1
        level = written(_level(up, depth, widest <= 1, seed), "level")
        found.append(level.filter("extra is not null").select("number", F.col("first_block").alias("block"), F.col("extra").alias("later")))
    done = leaves.filter("extra is not null")
    if found:
        later = found[0]
        for more in found[1:]:
            later = later.unionAll(more)
        # a row for each block that had one left
        done = done.unionAll(leaves.filter("extra is null").join(later, ["number", "block"]).withColumn("extra", F.col("later")).select(leaves.columns))
    each = repeated(closed.unionAll(done), "times", "copy_no")
    copies = F.col("base") + (F.col("copy_no") <= F.col("sure") + F.col("extra")).cast("long")
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
