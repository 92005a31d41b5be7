"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of immutable Parquet shards, of immutable parts of the list of shards, and
of manifests `manifest-<version>.json` that name the parts of a version. A part tells path, rows,
bytes and tier of up to PART shards. A commit writes parts for new shards only, and again those
parts that lose shards, so a manifest stays a few lines and an append costs what it brings.
Arrivals are appended as small immutable shards, one for each task that reads them, so their
number follows the bytes that arrive. Compaction takes, in each size tier that has enough of
them, the shards of that tier and merges them into files of about the target size; a tier is a
power of FANOUT of the byte size, so shards are only merged with others of similar size and a row
is rewritten once per tier. Merging needs no shuffle: Spark reads the shards of a tier and
coalesces to as many tasks as there are target files. The driver holds a line per live shard
(about 200 bytes for each 128 MB at rest).

Arrivals may differ in their columns: every shard names its schema, kept in a file of its own, and
only shards of one schema are merged, so no column is lost and none changes its type at rest. A
read gives the columns of all shards, null where a shard lacks one; columns that changed their
type come as the type that Spark's union finds for both, and a read fails where there is none.

Commit: new shards and parts are written first, then the manifest with the next version is
written to a temporary name and renamed, which fails if that version exists. Readers use the
highest version, so they see either all of a commit or nothing; a lost race is reported and
leaves only files that no manifest lists. On stores without such a rename, give the Store a
`publish` function with a conditional put.

Defined results: rows are kept whole and unchanged with all columns and nulls; an empty
arrival adds no shard; texts of any length stay in one row; repeated rows are kept; shards of
equal size stay in the order of their paths; columns of rows may have any names, those of the
result included, and may come, go or change their type from one arrival to the next.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch_path

#: Bytes of a full shard and of the smallest tier; shards a tier needs before it is merged.
TARGET, SMALLEST, FANOUT = 128 << 20, 1 << 20, 4
#: Shards listed in one part of a manifest.
PART = 10_000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int
    schema: str = ""  # digest that names the file of its schema
    part: str = ""


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """One store of shards."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, publish: Callable[[str, bytes], bool] | None = None) -> None:
        """publish(path, data) writes a file that must not exist yet, all or nothing, and tells whether it did."""
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self.publish = publish or self._rename
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.root))

    def tier(self, size: int) -> int:
        """Tier of a shard; full shards have the highest and are never merged again."""
        if size >= self.target // 2:
            return 99
        t = 0
        while size >= SMALLEST * FANOUT ** (t + 1):
            t += 1
        return t

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path(self.root)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """Live shards of a version (the latest if none is given)."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return []
        parts = json.loads(self._get(f"manifest-{version:010d}.json"))["parts"]
        return [Shard(*(x + [""])[:5], part) for part in parts for x in json.loads(self._get(part))]

    def _parts(self, version: int) -> list[str]:
        return json.loads(self._get(f"manifest-{version:010d}.json"))["parts"] if version else []

    def _keep_schema(self, schema: StructType) -> str:
        """Write a schema once, under its digest."""
        text = schema.json()
        name = hashlib.sha256(text.encode()).hexdigest()[:16]
        if not self.fs.exists(self._path(f"{self.root}/schema-{name}.json")):
            self._rename(f"{self.root}/schema-{name}.json", text.encode())
        return name

    def _get(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, data: bytes) -> None:
        out = self.fs.create(self._path(path), False)
        out.write(bytearray(data))
        out.close()

    def _rename(self, path: str, data: bytes) -> bool:
        """Publish by a rename that does not replace; what it could not publish is deleted."""
        part = f"{self.root}/.{uuid.uuid4().hex}.tmp"
        self._put(part, data)
        if not self.fs.exists(self._path(path)) and self.fs.rename(self._path(part), self._path(path)):
            return True
        self.fs.delete(self._path(part), False)
        return False

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Publish a list of live shards as version base + 1; parts of version base that are still whole are used again."""
        before, now = defaultdict(set), defaultdict(set)
        for s in self.manifest(base):
            before[s.part].add(s.path)
        for s in shards:
            now[s.part].add(s.path)
        parts = [p for p in before if before[p] == now[p]]
        return self._publish(base, parts, [s for s in shards if s.part not in parts])

    def _publish(self, base: int, parts: list[str], fresh: list[Shard]) -> int:
        """Version base + 1: the shards of these parts, and fresh ones."""
        parts = list(parts)
        for at in range(0, len(fresh), PART):
            parts.append(f"part-{uuid.uuid4().hex}.json")
            self._put(f"{self.root}/{parts[-1]}", json.dumps([[s.path, s.bytes, s.rows, s.tier, s.schema] for s in fresh[at : at + PART]]).encode())
        if not self.publish(f"{self.root}/manifest-{base + 1:010d}.json", json.dumps({"version": base + 1, "parts": parts}).encode()):
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1

    def _write(self, rows: DataFrame) -> list[Shard]:
        """Write rows, one shard per task that has any; their rows are counted from the files' own footers."""
        folder = f"{self.root}/shards-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        files = {}
        for s in self.fs.listStatus(self._path(folder)):
            if s.getPath().getName().startswith("part-"):
                files[s.getPath().getName()] = (s.getPath().toString(), s.getLen())
        found = self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        schema = self._keep_schema(rows.schema)
        return [Shard(*files[r["f"]], r["count"], self.tier(files[r["f"]][1]), schema) for r in sorted(found, key=lambda r: r["f"])]

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small immutable shards, one for each task that reads it; the parts of the list so far are named again, not read."""
        base = (self.versions() or [0])[-1]
        return self._publish(base, self._parts(base), self._write(rows))

    def compact(self) -> int:
        """Merge every tier that has FANOUT shards or more of one schema, until none has; one commit per round."""
        base = (self.versions() or [0])[-1]
        while True:
            live = self.manifest(base)
            tiers = defaultdict(list)
            for s in live:
                tiers[s.tier, s.schema].append(s)
            runs = [v for (t, _), v in sorted(tiers.items()) if t < 99 and len(v) >= FANOUT]
            if not runs:
                return base
            merged, gone = [], set()
            for run in runs:
                files = max(1, round(sum(s.bytes for s in run) / self.target))
                merged += self._write(self._read(run).coalesce(files))
                gone |= {s.path for s in run}
            base = self.commit(base, [s for s in live if s.path not in gone] + merged)

    def _read(self, shards: list[Shard]) -> DataFrame:
        """Rows of shards with the columns of all of them: each schema is read as it was written, columns that it lacks are null."""
        by_schema: dict[str, list[str]] = defaultdict(list)
        for s in shards:
            by_schema[s.schema].append(s.path)
        out = None
        for name, paths in by_schema.items():
            reader = self.spark.read
            reader = reader.schema(StructType.fromJson(json.loads(self._get(f"schema-{name}.json")))) if name else reader.option("mergeSchema", "true")
            rows = reader.parquet(*paths)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None for a store without rows."""
        live = self.manifest(version)
        return self._read(live) if live else None

    def vacuum(self) -> None:
        """Delete shard folders and parts that no manifest lists."""
        listed = [s for v in self.versions() for s in self.manifest(v)]
        used = {s.path.rsplit("/", 1)[0] for s in listed} | {self.fs.makeQualified(self._path(f"{self.root}/{s.part}")).toString() for s in listed}
        for s in self.fs.listStatus(self._path(self.root)):
            if s.getPath().getName().startswith(("shards-", "part-")) and s.getPath().toString() not in used:
                self.fs.delete(s.getPath(), True)


def shard_documents(docs: DataFrame, key: str = "doc_id", target: int = TARGET) -> DataFrame:
    """Append docs to a new store, compact it, and tell where every row is: key, shard, shard_rows, tier, version."""
    spark = docs.sparkSession
    store = Store(spark, scratch_path(spark, "store"), target)
    store.append(docs)
    version = store.compact()
    live = store.manifest(version)
    if not live:
        return docs.limit(0).select(key, F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).alias("tier"), F.lit(version).alias("version"))
    facts = spark.createDataFrame([(s.path.rsplit("/", 1)[1], s.rows, s.tier) for s in live], "shard string, shard_rows long, tier int")
    where = store.read(version).select(F.col(key), F.col("_metadata.file_name").alias("shard"))
    return where.join(facts, "shard").select(key, "shard", "shard_rows", "tier", F.lit(version).alias("version"))
