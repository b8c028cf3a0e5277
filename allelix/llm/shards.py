"""Sharding by size-tiered compaction with an atomically committed, versioned manifest. DataFrame functions only.

Arrivals are appended as small immutable shards (Parquet files). Shards of similar size form a tier: tier k holds sizes
from unit * fan_in ** k on. When a tier below the target has `fan_in` shards, all of it is merged into target-sized files,
so a document is rewritten once per tier at most. A version of the manifest lists its shards with their bytes and rows;
it is made by claiming the next number, which only one writer can create, and renaming a complete file to it. Readers
see the last complete version. A writer that dies with a claim blocks its number for `patience` seconds; then others may
claim it anew, and a writer whose claim was passed on gives up. vacuum() removes files of shards that no kept version
lists, and what lost writers have left once it is `age` seconds old.

The driver handles one entry per shard; rows stay in Spark jobs, which write new files and never change old ones.

Defined results: empty arrivals add a version but no shard; rows, nulls and repeats are kept as they are; all arrivals
have the columns of the first; a writer that finds its number taken raises Conflict and may append again.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hdfs


class Conflict(RuntimeError):
    pass


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = 128 << 20, fan_in: int = 4, unit: int = 64 << 10, patience: float = 600):
        self.spark, self.path, self.target, self.fan_in, self.unit, self.patience = spark, path.rstrip("/"), target, fan_in, unit, patience
        self.fs, _ = hdfs(spark, self.path)
        self.at = spark._jvm.org.apache.hadoop.fs.Path

    # -- manifest

    def _list(self, folder: str) -> list[tuple[str, int, bool]]:
        p = self.at(folder)
        return [(str(s.getPath()), s.getLen(), s.isDirectory()) for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def _read(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def versions(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _, _ in self._list(f"{self.path}/manifest")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "shards": []}
        return json.loads(self._read(f"{self.path}/manifest/v{found[-1] if version is None else version:08d}.json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _age(self, path) -> float:
        return time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000

    def _claim(self, version: int) -> int:
        """Which claim of the version's number this writer holds; a later one replaces those that have expired."""
        number = 0
        while not self.fs.createNewFile(self._claim_path(version, number)):
            if self._age(self._claim_path(version, number)) < self.patience:
                raise Conflict(f"version {version} is taken")
            number += 1
        return number

    def _claim_path(self, version: int, number: int):
        return self.at(f"{self.path}/manifest/v{version:08d}.claim-{number:04d}")

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        version = base + 1
        final = self.at(f"{self.path}/manifest/v{version:08d}.json")
        if self.fs.exists(final):
            raise Conflict(f"version {version} is taken")
        number = self._claim(version)
        draft = self.at(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        if self.fs.exists(self._claim_path(version, number + 1)) or self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {version} could not be put in place")
        return version

    # -- data

    def _shards_in(self, folder: str) -> list[Shard]:
        files = {p: n for p, n, is_folder in self._list(folder) if not is_folder and p.endswith(".parquet")}
        if not files:
            return []
        rows = {r["name"].rsplit("/", 1)[1]: r["n"] for r in self.spark.read.parquet(*files).select(F.input_file_name().alias("name")).groupBy("name").agg(F.count("*").alias("n")).collect()}  # a row for each file
        return [Shard(p, n, rows.get(p.rsplit("/", 1)[1], 0)) for p, n in sorted(files.items()) if rows.get(p.rsplit("/", 1)[1], 0)]

    def append(self, df: DataFrame) -> int:
        """Adds one arrival."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        old = self.manifest()
        return self.commit(old["version"], [*map(lambda s: Shard(**s), old["shards"]), *self._shards_in(folder)], old["schema"] or df.schema.json())

    def append_each(self, df: DataFrame, arrival: F.Column, compact: bool = True, keep: int = 2) -> int:
        """Adds the arrivals that an expression tells apart, written in one pass and committed one by one; the last `keep` versions stay readable."""
        name = "arrival"
        while name in df.columns:
            name += "_"
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn(name, arrival).write.partitionBy(name).parquet(folder)
        for part, _, is_folder in sorted(self._list(folder)):
            if is_folder:
                old = self.manifest()
                self.commit(old["version"], [*map(lambda s: Shard(**s), old["shards"]), *self._shards_in(part)], old["schema"] or df.schema.json())
                if compact:
                    self.compact()
                    self.vacuum(keep)
        if not self.versions():
            self.commit(0, [], df.schema.json())
        return self.versions()[-1]

    def tier(self, s: Shard) -> int:
        return int(math.log(max(s.bytes / self.unit, 1), self.fan_in))

    def compact(self) -> int:
        """Merges full tiers, lowest first, until none is left; returns the version."""
        while True:
            now = self.manifest()
            shards = [Shard(**s) for s in now["shards"]]
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                if s.bytes < self.target // 2:
                    tiers.setdefault(self.tier(s), []).append(s)
            full = [k for k, v in tiers.items() if len(v) >= self.fan_in]
            if not full:
                return now["version"]
            run = tiers[min(full)]
            files = max(1, round(sum(s.bytes for s in run) / self.target))
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(*(s.path for s in run)).coalesce(files).write.parquet(folder)
            merged, gone = self._shards_in(folder), set(run)
            if sum(s.rows for s in merged) != sum(s.rows for s in run):
                raise RuntimeError(f"{folder} does not hold the rows of its run")
            if len(merged) >= len(run):
                self.fs.delete(self.at(folder), True)
                return now["version"]
            self.commit(now["version"], [*(s for s in shards if s not in gone), *merged], now["schema"])

    def vacuum(self, keep: int = 2, age: float = 86_400) -> None:
        """Removes versions but the last `keep`, files that only they list, and what no version lists once it is `age` seconds old."""
        versions = self.versions()
        bare = lambda path: path.split(":", 1)[-1].lstrip("/")
        used = {bare(s.path) for v in versions[-keep:] for s in self.shards(v)}
        for s in {s for v in versions[:-keep] for s in self.shards(v)}:
            if bare(s.path) not in used:
                self.fs.delete(self.at(s.path), False)
        for v in versions[:-keep]:
            self.fs.delete(self.at(f"{self.path}/manifest/v{v:08d}.json"), False)
        for path, _, is_folder in self._list(f"{self.path}/manifest"):
            name = path.rsplit("/", 1)[1]
            lost = name.startswith(".draft-") or ".claim-" in name and versions and int(name[1:9]) <= versions[-1]
            if not is_folder and lost and self._age(self.at(path)) >= age:
                self.fs.delete(self.at(path), False)
        for folder, _, _ in self._list(f"{self.path}/data"):
            files, todo = [], [folder]
            while todo:
                for path, _, is_folder in self._list(todo.pop()):
                    (todo if is_folder else files).append(path)
            if not any(bare(f) in used for f in files) and all(self._age(self.at(f)) >= age for f in files) and self._age(self.at(folder)) >= age:
                self.fs.delete(self.at(folder), True)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was committed yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        paths = [s["path"] for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
