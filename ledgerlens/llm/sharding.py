"""Operator 7, sharding: size-tiered compaction with an atomically committed, versioned manifest.

A store is a folder of immutable Parquet files and a folder of manifests, v000001.json and up.  append() writes arrivals
as small files straight from the input tasks, without a shuffle.  compact() puts runs (files) of similar size in tiers,
a factor of FAN apart; a tier of FAN runs or more is merged, in the order of its names, into files of about the target
size: each merged file is the work of one task that reads its own inputs.  Every change is a new manifest, written
under a temporary name and renamed; a version that another writer has committed first is never replaced.  Readers
see the files of one manifest only, so a lost executor or a failed job leaves nothing but unnamed files, which vacuum()
removes.

Only file names and sizes reach the driver, a few dozen bytes for each run, as in any table format.

Defined results: rows are written as they are, nulls, empty and long texts and repeated rows included; an empty table
gives a store without runs; columns are kept under their own names, whatever they are.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import delete

FAN = 4
#: Merged files written by one Spark job.
AT_ONCE = 64


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def _list(self, path: str) -> list:
        return list(self._fs.listStatus(self._path(path))) if self._fs.exists(self._path(path)) else []

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def versions(self) -> list[int]:
        """All versions that can be read."""
        names = [re.fullmatch(r"v(\d+)\.json", f.getPath().getName()) for f in self._list(f"{self.root}/manifest")]
        return sorted(int(n[1]) for n in names if n)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "runs": [{"name", "bytes"}]} of a version, the last by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:06d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: int, runs: list[dict], schema: str) -> int:
        """Commit runs as version base + 1: written aside, then renamed; fails if that version exists."""
        target, aside = self._path(f"{self.root}/manifest/v{base + 1:06d}.json"), self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "runs": runs}, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise Conflict(f"version {base + 1} was committed by another writer") from error
            raise
        return base + 1

    def _runs(self, folder: str) -> list[dict]:
        files = [(f.getPath().getName(), f.getLen()) for f in self._list(f"{self.root}/{folder}")]
        return [{"name": f"{folder}/{n}", "bytes": int(size)} for n, size in sorted(files) if n.startswith("part-")]

    def append(self, rows: DataFrame, rows_a_shard: int) -> int:
        """Add rows as small immutable shards of at most rows_a_shard rows."""
        now = self.manifest()
        folder = f"data/{now['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("maxRecordsPerFile", rows_a_shard).parquet(f"{self.root}/{folder}")
        return self.commit(now["version"], now["runs"] + self._runs(folder), rows.schema.json())

    def compact(self, target: int, keep: int = 2) -> int:
        """Merge tiers until none holds FAN runs below the target size; files that none of the last keep versions names go.

        With two versions or more, readers of the version before keep their files while a merge commits.
        """
        while True:
            now = self.manifest()
            merges, runs = plan(now["runs"], target)
            if not merges:
                self.vacuum(keep)
                return now["version"]
            for at in range(0, len(merges), AT_ONCE):
                folder = f"data/{now['version'] + 1:06d}-{at:06d}-{uuid.uuid4().hex[:8]}"
                self._write(merges[at : at + AT_ONCE], folder, now["schema"])
                runs += self._runs(folder)
            self.commit(now["version"], sorted(runs, key=lambda r: r["name"]), now["schema"])
            self.vacuum(keep)

    def _write(self, merges: list[list[dict]], folder: str, schema: str) -> None:
        """One file for each merge, each written by one task from its own inputs."""
        parts = [self._read([r["name"] for r in m], schema).coalesce(1) for m in merges]
        while len(parts) > 1:  # a balanced tree of unions keeps the plan shallow
            parts = [parts[i].unionAll(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        parts[0].write.parquet(f"{self.root}/{folder}")

    def _read(self, names: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        found = self.manifest(version)
        return self._read([r["name"] for r in found["runs"]], found["schema"])

    def vacuum(self, keep: int = 2) -> None:
        """Delete files that none of the last keep versions names, and older manifests; one look at each folder and file."""
        have = self.versions()
        named: dict[str, set[str]] = {}
        for v in have[-keep:]:
            for r in self.manifest(v)["runs"]:
                folder, name = r["name"].rsplit("/", 1)
                named.setdefault(folder, set()).add(name)
        for folder in self._list(f"{self.root}/data"):
            base = f"data/{folder.getPath().getName()}"
            if base not in named:
                delete(self.spark, f"{self.root}/{base}")
                continue
            for f in self._list(f"{self.root}/{base}"):
                if f.getPath().getName().startswith("part-") and f.getPath().getName() not in named[base]:
                    self._fs.delete(f.getPath(), False)
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:06d}.json"), False)


def tier_of(size: int, target: int) -> int:
    """Tiers a factor of FAN apart below the target: 0 holds (target / FAN, target), 1 the next smaller, ..."""
    tier = 0
    while size * FAN ** (tier + 1) <= target and tier < 30:
        tier += 1
    return tier


def plan(runs: list[dict], target: int) -> tuple[list[list[dict]], list[dict]]:
    """(merges, runs left alone): full runs stay; the smallest tier with FAN runs or more is cut into merges of about
    the target size, each of two runs or more."""
    tiers: dict[int, list[dict]] = {}
    for r in runs:
        if r["bytes"] < target / 2:
            tiers.setdefault(tier_of(r["bytes"], target), []).append(r)
    for tier in sorted(tiers, reverse=True):
        own = sorted(tiers[tier], key=lambda r: r["name"])
        if len(own) < FAN:
            continue
        merges, size = [[]], 0
        for r in own:
            if merges[-1] and size + r["bytes"] > target:
                merges.append([])
                size = 0
            merges[-1].append(r)
            size += r["bytes"]
        if len(merges) > 1 and len(merges[-1]) == 1:  # no run is rewritten alone
            last = merges.pop()
            merges[-1] += last
        used = {r["name"] for m in merges for r in m}
        return merges, [r for r in runs if r["name"] not in used]
    return [], runs


def shard_rows(store: ShardStore, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, shard (file of the last version) and shard_bytes of every row."""
    found = store.manifest()
    rows = store.read()
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1)
    return rows.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), name.alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"), F.lit(found["version"]).alias("version"),
    )


def compacted(docs: DataFrame, root: str, rows_a_shard: int = 1000, target: int = 128 << 20) -> ShardStore:
    """A store of docs: appended as small shards, then compacted to files of about the target size."""
    store = ShardStore(docs.sparkSession, root)
    store.append(docs, rows_a_shard)
    store.compact(target)
    return store
