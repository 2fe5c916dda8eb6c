"""Operator 8: size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder with `data/` (Parquet shards, never changed) and `manifest/` (one JSON file a
version, listing the live shards). append() writes arrivals as small shards, a file a task, and
commits a manifest with them. compact() puts shards into tiers by size (factor FAN_IN); as soon as
a tier below TARGET holds FAN_IN shards, runs of them that reach the next tier, TARGET at most,
are merged. Each merge reads its few files in one task and writes one file, so nothing is
shuffled and memory holds a batch of rows.

A version is committed by creating its manifest file, which the file system does for one writer
only; the loser finds the version taken, and merges again from the new one. Readers see a whole
version or none, and can go on with it while others are made: compaction removes nothing. vacuum()
removes the files that none of the newest KEEP versions names. A loser's merged files go at once.
Commits need a file system whose rename refuses an existing target (HDFS, local disks).

Manifests list files, not rows: a few hundred bytes for each TARGET bytes of data.

Defined cases: all columns, nulls, repeated rows and empty texts are kept as they are; a version's columns are those of all its arrivals,
null where a shard lacks one; an arrival whose column has another type or another case than before is refused; an empty
arrival commits a version without new shards; a store without versions can't be read.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

TARGET = 64 << 20
FAN_IN = 4
SMALLEST = 1 << 20
WAVE = 64
KEEP = 10


def merged_schema(held: str | None, new: StructType) -> str:
    """The columns held so far and those that are new, as JSON; all may be null."""
    fields = {f.name: StructField(f.name, f.dataType) for f in StructType.fromJson(json.loads(held)).fields} if held else {}
    cases = {name.lower(): name for name in fields}
    for f in new.fields:
        known = cases.setdefault(f.name.lower(), f.name)
        if known != f.name or (f.name in fields and fields[f.name].dataType != f.dataType):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} doesn't fit {known} {fields[known].dataType.simpleString()}")
        fields.setdefault(f.name, StructField(f.name, f.dataType))
    return StructType(list(fields.values())).json()


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    # manifest

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return max((int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        data = self._fs.open(self._path(f"{self.path}/manifest/v{version:010d}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        data.close()
        return json.loads(text)

    def _commit(self, base: int, schema: str | None, shards: list[dict]) -> bool:
        """Create version base + 1; False if another writer has."""
        version = base + 1
        place = self._path(f"{self.path}/manifest/v{version:010d}.json")
        draft = self._path(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode()))
        out.close()
        try:
            if self._fs.exists(place):
                return False
            return bool(self._fs.rename(draft, place))
        finally:
            self._fs.delete(draft, False)

    # shards

    def _write(self, df: DataFrame, run: str) -> list[dict]:
        """Write df as new shards, one a task; their names and sizes."""
        folder = f"data/{run}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        files = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        return [{"file": f"{folder}/{f.getPath().getName()}", "bytes": f.getLen()} for f in files if f.getPath().getName().startswith("part-")]

    def _run_name(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def append(self, arrivals: DataFrame) -> int:
        """Commit arrivals as small shards; the new version."""
        merged_schema(self.manifest()["schema"], arrivals.schema)  # refused before anything is written
        run = self._run_name("arrival")
        new = self._write(arrivals, run)
        while True:
            at = self.manifest()
            try:
                schema = merged_schema(at["schema"], arrivals.schema)
            except ValueError:  # another writer's columns came first
                self._fs.delete(self._path(f"{self.path}/data/{run}"), True)
                raise
            if self._commit(at["version"], schema, at["shards"] + new):
                return at["version"] + 1

    def tier(self, size: int) -> int:
        t, edge = 0, SMALLEST
        while size >= edge:
            t, edge = t + 1, edge * FAN_IN
        return t

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: within a tier, up to TARGET bytes each; only full runs."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = []
        for t in sorted(tiers):
            run, size = [], 0
            for s in sorted(tiers[t], key=lambda s: (-s["bytes"], s["file"])):
                if run and size + s["bytes"] > self.target:
                    if len(run) > 1:
                        runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) >= FAN_IN:
                runs.append(run)
        return runs

    def compact(self) -> int:
        """Merge until no tier has a full run; the new version."""
        while True:
            at = self.manifest()
            runs = self.plan(at["shards"])[:WAVE]
            if not runs:
                return at["version"]
            schema = StructType.fromJson(json.loads(at["schema"]))
            read = lambda run: self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['file']}" for s in run)).coalesce(1)  # noqa: B023, E731
            run = self._run_name("merge")
            new = self._write(reduce(DataFrame.unionAll, [read(r) for r in runs]), run)
            gone = {s["file"] for r in runs for s in r}
            if not self._commit(at["version"], at["schema"], [s for s in at["shards"] if s["file"] not in gone] + new):
                self._fs.delete(self._path(f"{self.path}/data/{run}"), True)

    def vacuum(self, keep: int = KEEP) -> int:
        """Remove what the newest versions don't name, but shards younger than the oldest of them stay; how many files went."""
        last = self.version()
        oldest = max(1, last - keep + 1)
        live = {s["file"] for v in range(oldest, last + 1) for s in self.manifest(v)["shards"]}
        # files named by older versions only: those of writers at work are in no version yet and stay
        old = {s["file"] for v in range(1, oldest) if self._fs.exists(self._path(self._place(v))) for s in self.manifest(v)["shards"]} - live
        for f in old:
            self._fs.delete(self._path(f"{self.path}/{f}"), False)
        for v in range(1, oldest):
            self._fs.delete(self._path(self._place(v)), False)
        return len(old)

    def _place(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:010d}.json"

    def read(self, version: int | None = None) -> DataFrame:
        at = self.manifest(version)
        if not at["schema"]:
            raise ValueError(f"{self.path} has no version")
        schema = StructType.fromJson(json.loads(at["schema"]))
        if not at["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['file']}" for s in at["shards"]))


def ingest(documents: DataFrame, path: str, arrivals: int = 4, target: int = TARGET) -> ShardStore:
    """Append documents in several arrivals (by hash of doc_id), compacting after each."""
    from pyspark.sql import functions as F

    store = ShardStore(documents.sparkSession, path, target)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(documents.where(part == i))
        store.compact()
    return store
