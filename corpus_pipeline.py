"""The corpus pipeline: stages over the documents table, each written as Parquet and read again before the next.

Every stage works on all that the stage before it kept, for any rows: null and empty texts, very long ones, repeated
rows, empty tables and further columns, whatever their names. Further columns stay with their documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import drop, new_path, written  # noqa: F401
from allelix.llm.decontaminate import mark_contaminated
from allelix.llm.language_id import fit_language_id, identify
from allelix.llm.near_dedup import near_duplicates
from allelix.llm.pii import sanitise
from allelix.llm.queries import held_out, vocabulary
from allelix.llm.sampled_pieces import sample_pieces
from allelix.tables import scratch, stored

PIECES = "piece_bpe_32k.model"


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(stage):
    """The stage with all further columns of docs renamed, so that no name of theirs meets one that the stage uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"further_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(names).toDF(*docs.columns)

    return run


@_aside
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or null, and those whose language is not more likely than all others together."""
    known = docs.filter(~F.coalesce(held_out(), F.lit(True)))
    if known.filter("text is not null and lang is not null").isEmpty():
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, fit_language_id(known, vocabulary(PIECES))).filter("lang_pred != 'und' and score >= 0.5")


@_aside
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class; of rows that repeat it, one."""
    key = (F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("own_id"))
    kept = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("root"))).select(*key, "copy").distinct()
    keyed = docs.select("*", *key, F.coalesce(F.md5("text"), F.lit("null")).alias("copy"))
    return keyed.join(kept, ["no_id", "own_id", "copy"], "left_semi").dropDuplicates(["no_id", "own_id", "copy"])


@_aside
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~F.col("contaminated"))


@_aside
def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the text."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text as sampled segmentations, each decoded again to check it."""
    return sample_pieces(docs, vocabulary(PIECES))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", clean_of_benchmark),
    ("private_data", without_private_data),
    ("sampled_pieces", as_pieces),
]
#: The language model, the sampled segmentations and the signatures can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stored goes once the next has been, and tables within a stage at its end."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, before = stored(stage(spark, docs, sf_dir), new_path(spark, name)), old
        if before is not None:
            drop(before)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
