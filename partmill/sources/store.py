"""Snapshots, run history and content hashes as tables under one root folder."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.functions.keys import domain_key

HISTORY = "id string, timestamp string, source string, kind string, mode string, parts long, platform string, data_source string, cache_hit boolean, stopped_early boolean"


def content_hash(content: Column) -> Column:
    """SHA-256 of the content, as hex."""
    return F.sha2(content, 256)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", content_hash(F.col("content")).alias("sha256"))


@dataclass
class Store:
    """Versioned snapshots: each is written to a new folder and then named by a pointer, so a reader of the old one and
    a writer of the new one don't meet."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _key(self, key: str) -> str:
        return self.spark.range(1).select(domain_key(F.lit(key)).alias("k")).first().k

    def _pointer(self, kind: str, key: str) -> str:
        return f"{self.root}/{kind}/{self._key(key)}/current"

    def read(self, kind: str, key: str) -> tuple[DataFrame, dict] | None:
        """(rows, metadata) of the current snapshot; None if there is none."""
        fs, pointer = self._fs(self._pointer(kind, key))
        if not fs.exists(pointer):
            return None
        meta = json.loads("\n".join(r.value for r in self.spark.read.text(self._pointer(kind, key)).collect()))
        return self.spark.read.parquet(meta["path"]), meta

    def write(self, kind: str, key: str, rows: DataFrame, **meta) -> dict:
        """Writes a snapshot and makes it the current one."""
        path = f"{self.root}/{kind}/{self._key(key)}/v{time.time_ns()}"
        rows.write.parquet(path)
        meta = {**meta, "path": path}
        fs, pointer = self._fs(self._pointer(kind, key))
        stream = fs.create(pointer, True)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        return meta

    def record_run(self, **run) -> str:
        """Appends a run to the history; id and time are the store's, whatever the caller gives."""
        run = {k: v for k, v in run.items() if k not in ("id", "timestamp")}
        values = self.spark.createDataFrame([run], ", ".join(f for f in HISTORY.split(", ") if f.split()[0] in run)) if run else self.spark.range(1).select()
        row = values.withColumns({"id": F.replace(F.uuid(), F.lit("-"), F.lit("")), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")}).collect()[0]
        self.spark.createDataFrame([row.asDict()], ", ".join(f for f in HISTORY.split(", ") if f.split()[0] in row.asDict())).coalesce(1).write.mode("append").json(f"{self.root}/runs")
        return row["id"]

    def runs(self) -> DataFrame:
        """All runs, oldest first."""
        fs, path = self._fs(f"{self.root}/runs")
        if not fs.exists(path):
            return self.spark.createDataFrame([], HISTORY)
        return self.spark.read.schema(HISTORY).json(f"{self.root}/runs").orderBy("timestamp", "id")
