"""Operator 4: a sharded table with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards. Shards of similar size (within a factor of FANOUT)
form tiers; where a tier has FANOUT shards or more, they are merged into shards of up to the target size: one
job a tier, whose tasks each read some whole shards and write one, without a shuffle. Every change is a new
manifest, one JSON file that lists the live shards (path, bytes, level). It is created by an atomic rename that
fails if the version exists, so readers see the old state or the new one, and of two writers one must start
anew: append() and compact() then try again on the new version, as what they wrote is still good. Tasks that are
lost are run again and write files of their own attempt.

No commit deletes anything: versions before a compaction stay readable until vacuum() removes what only versions
before the last `keep` name. A shard that no manifest names may belong to a writer that has not committed
yet, and is removed only on request, by age.

All file work goes through Hadoop's file systems and Spark's readers, so the folder may lie in any store. The
driver holds the list of shards (an entry for each TARGET_BYTES of the table), as table formats do. Rows are
kept as they are: nulls, empty and long texts, repeated rows and all columns, whatever their names. Where
arrivals differ in columns, the table has all of them, null where a row's arrival lacked one. An empty arrival
commits a version without new shards, and keeps its columns for reading; a table without any arrival has none.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalendry.llm.common import quoted

TARGET_BYTES, FANOUT, ROWS_PER_ARRIVAL = 128 << 20, 4, 2000
#: How often a writer that lost a race tries again.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    level: int  # merges that its rows went through


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    schema: str = '{"type":"struct","fields":[]}'  # of all arrivals, also those without rows


def _wider(schema: str, other: T.StructType) -> str:
    """The columns of schema and those that other has besides, all nullable."""
    old = T.StructType.fromJson(json.loads(schema))
    names = {f.name for f in old}
    return T.StructType([*old, *(T.StructField(f.name, f.dataType) for f in other if f.name not in names)]).json()


class ShardedTable:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.folder, self.target, self.fanout = spark, folder.rstrip("/"), target_bytes, fanout
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(self._path("versions")) if s.getPath().getName().endswith(".json"))

    def current(self) -> Manifest:
        found = self.versions()
        return self.manifest(found[-1]) if found else Manifest(0, ())

    def manifest(self, version: int) -> Manifest:
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/versions/{version:012d}.json").collect())
        spec = json.loads(text)
        return Manifest(spec["version"], tuple(Shard(**s) for s in spec["shards"]), spec["schema"])

    def commit(self, base: Manifest, shards: tuple[Shard, ...], schema: str | None = None) -> Manifest:
        """Makes the next version of base, or raises Conflict if there is one already."""
        new = Manifest(base.version + 1, tuple(sorted(shards, key=lambda s: s.path)), schema or base.schema)
        temporary, final = self._path(f"tmp-{uuid.uuid4().hex}"), self._path(f"versions/{new.version:012d}.json")
        out = self.fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps({"version": new.version, "schema": new.schema, "shards": [vars(s) for s in new.shards]}).encode()))
        finally:
            out.close()
        # a rename never replaces a file; where a store would, the check before it is the last guard
        if self.fs.exists(final) or not self.fs.rename(temporary, final):
            self.fs.delete(temporary, False)
            raise Conflict(f"version {new.version} exists")
        return new

    def _written(self, folder: str, level: int) -> tuple[Shard, ...]:
        found = self.fs.listStatus(self._hadoop.Path(folder))
        return tuple(Shard(s.getPath().toString(), s.getLen(), level) for s in found if s.getPath().getName().startswith("part-"))

    def _changed(self, change) -> Manifest:
        """Commits change(current manifest) -> (shards, schema), on the newest version if another writer was first."""
        for _ in range(ATTEMPTS):
            base = self.current()
            if (new := change(base)) is None:
                return base
            try:
                return self.commit(base, *new)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other versions came first")

    def append(self, rows: DataFrame, rows_per_shard: int = ROWS_PER_ARRIVAL) -> Manifest:
        """Adds rows as small shards and commits them."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        fresh = self._written(folder, 0)
        if len(fresh) <= 1 and self.spark.read.schema(rows.schema).parquet(folder).isEmpty():
            fresh = ()
        return self._changed(lambda base: (base.shards + fresh, _wider(base.schema, rows.schema)))

    def _count(self, shards: list[Shard]) -> int:
        """Into how many shards these are to be merged."""
        return -(-sum(s.bytes for s in shards) // self.target)

    def _merge(self, shards: list[Shard], schema: T.StructType) -> list[Shard]:
        """Rewrites shards as fewer and larger ones; coalesce() deals whole partitions to tasks, without a shuffle."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows = self.spark.read.schema(schema).parquet(*[s.path for s in shards])
        rows.coalesce(self._count(shards)).write.parquet(folder)
        return list(self._written(folder, 1 + max(s.level for s in shards)))

    def tier(self, size: int) -> int:
        """How often the size can grow by the fanout before it reaches the target."""
        steps = 0
        while size * self.fanout <= self.target:
            size, steps = size * self.fanout, steps + 1
        return -steps

    def _due(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Tiers with enough shards, if merging makes them fewer."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < 0.75 * self.target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        due = [own for own in tiers.values() if len(own) >= self.fanout and self._count(own) < len(own)]
        return [sorted(own, key=lambda s: s.path) for own in due]

    def compact(self) -> Manifest:
        """Merges tiers until none has enough shards; each tier is one commit. The shards merged are left for vacuum()."""
        while tiers := self._due((now := self.current()).shards):
            for own in tiers:
                fresh = tuple(self._merge(own, T.StructType.fromJson(json.loads(now.schema))))
                gone = {s.path for s in own}

                def change(base: Manifest, gone=gone, fresh=fresh):
                    if not gone <= {s.path for s in base.shards}:
                        return None  # another compaction merged some of them: this one's work is dropped
                    return tuple(s for s in base.shards if s.path not in gone) + fresh, None

                self._changed(change)
        return now

    def vacuum(self, keep: int = 2, unknown_after: float | None = None) -> int:
        """Removes shards that older manifests name but none of the last `keep`; returns how many.

        Shards that no manifest names are removed if they are older than `unknown_after` seconds, if that is given.
        """
        versions = self.versions()
        named = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        known = {s.path for v in versions[:-keep] for s in self.manifest(v).shards}
        gone = 0
        for folder in self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else []:
            for s in self.fs.listStatus(folder.getPath()):
                path = s.getPath().toString()
                if not s.getPath().getName().startswith("part-") or path in named:
                    continue
                if path in known or (unknown_after is not None and s.getModificationTime() / 1000 < time.time() - unknown_after):
                    gone += bool(self.fs.delete(s.getPath(), False))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        m = self.current() if version is None else self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in m.shards])


def shard_report(table: ShardedTable) -> DataFrame:
    """One row for each live shard, counted from its rows: shard, version, level, bytes, n_rows, n_ids, checksum.

    n_ids counts rows with a doc_id, if the table has that column.
    """
    m = table.current()
    rows = [(s.path.rsplit("/", 1)[1], m.version, s.level, s.bytes) for s in m.shards]
    entries = table.spark.createDataFrame(rows, "shard string, version long, level int, bytes long")
    if not m.shards:
        return entries.selectExpr("*", "0L n_rows", "0L n_ids", "0L checksum")
    rows = table.read()
    names = [F.col(quoted(c)) for c in rows.columns]
    ids = F.col("doc_id") if "doc_id" in rows.columns else F.lit(None)
    own = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"), ids.alias("id"), F.xxhash64(*names).alias("h"))
    counted = own.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.count("id").alias("n_ids"), F.bit_xor("h").alias("checksum"))
    return entries.join(counted, "shard")
