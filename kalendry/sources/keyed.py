"""A keyed table of buckets: a merge rewrites the buckets its keys fall in and no others, by staged files and one commit.

A version is one small file that names the folder of every bucket; it is created exclusively, so of two writers one
fails with Conflict and starts again from what the other left. Files of a merge that never committed are named by no
version. Each version also carries the number of the last batch that it holds: a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class KeyedTable:
    """folder is in storage that all executors share; schema is the rows' (a DDL string); key names their columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.folder}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def version(self) -> tuple[int, dict]:
        """The newest version that is complete: (number, {"batch": n, "buckets": {bucket: folder}})."""
        for n in reversed(self._versions()):
            stream = self._fs.open(self._path(f"{self.folder}/versions/{n}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return n, json.loads(text)
            except ValueError:  # still being written
                continue
        return 0, {"batch": -1, "buckets": {}}

    def _commit(self, number: int, content: dict) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.folder}/versions/{number}"), False)
        except Exception as e:
            raise Conflict(f"version {number} of {self.folder} is there already") from e
        stream.write(bytearray(json.dumps(content), "utf-8"))
        stream.close()

    def repair(self) -> None:
        """Removes a newest version that its writer left unfinished; only when no writer is at work."""
        found = self._versions()
        if found and found[-1] != self.version()[0]:
            self._fs.delete(self._path(f"{self.folder}/versions/{found[-1]}"), False)

    def _of(self, content: dict, buckets: list[int] | None = None) -> DataFrame:
        places = [p for b, p in content["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(self.version()[1])

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> bool:
        """Replaces the touched buckets by how(their rows, rows); False if the batch is in already.

        how gives all rows that the touched buckets then hold, and may only keep, change or add keys of these buckets.
        """
        number, content = self.version()
        if batch is not None and batch <= content["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = [r.bucket for r in rows.select(bucket).distinct().collect()]  # at most as many as there are buckets
        stage = f"{self.folder}/data/{number + 1}-{uuid.uuid4().hex}"
        merged = how(self._of(content, touched), rows.select(*self.schema.names)).select(*self.schema.names, bucket)
        if touched:
            merged.repartition("bucket").write.partitionBy("bucket").parquet(stage)
        now = {int(b): p for b, p in content["buckets"].items() if int(b) not in touched}
        for b in touched:
            place = f"{stage}/bucket={b}"
            if self._fs.exists(self._path(place)):
                now[b] = place
        self._commit(number + 1, {"batch": content["batch"] if batch is None else batch, "buckets": {str(b): p for b, p in now.items()}})
        return True


def latest(order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of each key (all columns of the table's key) the row with the greatest `order`; for KeyedTable.merge via upsert()."""

    def how(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
        both = old.unionByName(new)
        return both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(order, F.xxhash64(*both.columns))).alias("r")).select("r.*")

    return how


def upsert(table: KeyedTable, rows: DataFrame, order: str, batch: int | None = None) -> bool:
    return table.merge(rows, lambda old, new: latest(order)(old, new, table.key), batch)


def add_new(table: KeyedTable, rows: DataFrame, batch: int | None = None) -> bool:
    """Adds rows whose key is not there yet, one for each key; rows that are there stay as they are."""

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.join(old.select(*table.key), table.key, "left_anti")
        one = fresh.groupBy(*table.key).agg(F.min(F.struct(*fresh.columns)).alias("r")).select("r.*")
        return old.unionByName(one)

    return table.merge(rows, how, batch)
