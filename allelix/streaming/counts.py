"""Group sums kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "snp_id string, cell_id string, ref_count long, alt_count long, oth_count long"


def running_group_counts(spark: SparkSession, folder: str, cells: DataFrame, group_by: str) -> DataFrame:
    """A streaming frame of sums per (snp_id, group) over the count files that arrive in a folder; write it in update or complete mode."""
    arriving = spark.readStream.schema(SCHEMA).parquet(folder)
    groups = cells.select("cell_id", F.col(group_by).cast("string").alias(group_by)).filter(F.col(group_by).isNotNull())
    return arriving.join(groups, "cell_id").groupBy("snp_id", group_by).agg(F.sum("ref_count").alias("ref_count"), F.sum("alt_count").alias("alt_count"))
