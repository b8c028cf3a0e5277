"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .decontaminate import mark_contaminated
from .importance_sample import oracle as importance_oracle
from .importance_sample import resample
from .language_id import LanguageModel, fit_language_id, identify
from .near_dedup import near_duplicates
from .pii import KINDS, as_text, find_private
from .sampled_pieces import sample_pieces
from .shards import ShardStore
from .source_mix import mix
from .substring_dedup import dedup_substrings
from .token_files import token_dataset
from .url_filter import filter_urls
from .url_filter import oracle as url_oracle
from .vector_codes import compress
from .vector_codes import oracle as codes_oracle
from .vector_dedup import near_vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_pieces(_read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contaminated(texts, _read(spark, sf_dir, "benchmark")).drop("text")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("root"))).alias("kept"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_dataset(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return out.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("private")
    base = F.filter(spans, lambda s: s["kind"] < len(KINDS))
    count = lambda i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(spans).alias("spans"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals by source, compacted as they come; every document as the last version's shards have it."""
    docs = _read(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append_each(docs, F.pmod(F.xxhash64("source"), F.lit(8)))
    return store.read().select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


def held_out() -> Column:
    """The rows on which language ID is not fitted."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    known = _read(spark, sf_dir, "documents").filter(~F.coalesce(held_out(), F.lit(True)))
    return fit_language_id(known, vocabulary("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(texts, language_model(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_read(spark, sf_dir, "embeddings"))


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_sampled_pieces": op1_sampled_pieces,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_private": op6_private,
    "op7_language_id": op7_language_id,
    "op8_shards": op8_shards,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_source_mix": op11_source_mix,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_sample": op13_importance_sample,
}
ORACLES: dict[str, str] = {
    "op4_url_filter": url_oracle(),
    "op8_shards": "select doc_id, md5(text) as text_md5, lang, source, n_chars from documents",
    "op12_vector_codes": codes_oracle(),
    "op13_importance_sample": importance_oracle(),
}
