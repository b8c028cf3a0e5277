"""Tables in the folder that driver and executors share, and rows numbered in order."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder, once for each application; on a cluster it is an error,
    as no folder of this machine reaches the executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="allelix-shared-")
            spark.sparkContext.setCheckpointDir(_own[app])
        path = _own[app]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage with files every executor can reach."""
    path = new_path(df.sparkSession, name)
    if (mine := _scratch.get()) is not None:
        mine.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df by keys in all partitions that the session has for shuffles.

    Adaptive execution joins partitions by their compressed size; what is added up or looked up afterwards is held in memory, where it takes over ten times that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = hdfs(df.sparkSession, path)
        fs.delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes within it go at its end, so what depends on them must have been stored elsewhere by then."""
    mine: list[str] = []
    before = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in mine:
            fs, p = hdfs(spark, path)
            fs.delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to a path of the caller's own, which no scratch scope removes, and reads it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hdfs(spark: SparkSession, path: str):
    """Hadoop's file system for the path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def counted_up(df: DataFrame, name: str) -> DataFrame:
    """df, whose partitions must come out alike each time, with a column of 1-based row numbers in their order."""
    marked = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    before, total = {}, 0
    for r in marked.groupBy("_part").count().orderBy("_part").collect():  # one number for each partition
        before[r["_part"]], total = total, total + r["count"]
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return marked.join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_at", "_before")
