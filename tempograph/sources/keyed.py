"""A keyed table for batches and streams: read, modify, write, in versions that are published at once.

Rows lie in hash buckets of their key. An upsert reads and rewrites only the
buckets that its batch touches; a manifest names the folder of every bucket, and
a version exists once its manifest has its final name. Two writers that start
from one version cannot both publish the next: the loser reads the winner's
manifest and merges again. Readers see one version or another, never a mixture.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempograph.operators.store import keep_last, upsert

#: Tries of a writer that is overtaken, and batch ids that a manifest remembers.
TRIES, REMEMBERED = 10, 1000


class Conflict(RuntimeError):
    """Other writers published first, each time."""


class KeyedTable:
    """Table below ``path`` (on storage that executors share) with unique ``keys``; ``buckets`` holds for a new table."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Published versions in order."""
        fs, folder = self._fs(), self._at("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (default: the last) consists of; version 0 is the empty table."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if not version:
            return {"version": 0, "buckets": {}, "count": self.buckets, "batches": [], "schema": None}
        stream = self._fs().open(self._at(f"manifests/{version:09}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> bool:
        """Give a manifest its final name; False if another writer has that version."""
        own = json.dumps(manifest | {"writer": uuid.uuid4().hex})
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"manifests/{manifest['version']:09}")
        fs = self._fs()
        out = fs.create(draft, True)
        out.write(bytearray(own, "utf-8"))
        out.close()
        fs.mkdirs(final.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), plain)  # fails if the name is taken
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        names = [f for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (default: the last), None before the first."""
        return self._read(self.manifest(version))

    def upsert(self, batch: DataFrame, order: list[str], batch_id: str | int | None = None) -> int:
        """Rows of ``batch`` replace those of equal keys (of several the last by ``order``); the version that holds them.

        A batch whose id was published before changes nothing, so a rerun is
        harmless; a writer that is lost leaves files that no manifest names.
        Columns follow the table's; missing ones become null, further ones
        raise. Null keys are one key. An empty batch publishes nothing on a
        table that exists.
        """
        last = self.manifest()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(last["count"])).cast("int")
        staged = f"staged/{uuid.uuid4().hex}"
        keep_last(batch, self.keys, order).withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.path}/{staged}")
        schema = batch.schema
        new = self.spark.read.schema(StructType([*schema.fields]).add("__bucket", "integer")).parquet(f"{self.path}/{staged}")
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # as many as there are buckets
        try:
            for _ in range(TRIES):
                now = self.manifest()
                if batch_id is not None and str(batch_id) in now["batches"] or (not touched and now["version"]):
                    return now["version"]
                old = self._read(now, touched)
                rows = new.drop("__bucket")
                if old is not None:
                    if extra := [c for c in rows.columns if c not in old.columns]:
                        raise ValueError(f"column {extra[0]} is not in the table")
                    rows = upsert_null_safe(old, rows, self.keys)
                folder = f"data/{uuid.uuid4().hex}"
                rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
                made = {
                    "version": now["version"] + 1, "count": now["count"], "schema": now["schema"] or json.loads(schema.json()),
                    "buckets": now["buckets"] | {str(b): f"{folder}/__bucket={b}" for b in touched}, "batches": ([*now["batches"], str(batch_id)] if batch_id is not None else now["batches"])[-REMEMBERED:],
                }
                if self.publish(made):
                    return made["version"]
                self._fs().delete(self._at(folder), True)
            raise Conflict(f"{TRIES} times another writer was first")
        finally:
            self._fs().delete(self._at(staged), True)

    def vacuum(self, keep: int = 2, older_seconds: float = 86_400) -> list[str]:
        """Delete data folders that none of the last ``keep`` versions names and that are older than a running writer could be."""
        fs, folder = self._fs(), self._at("data")
        named = {f.split("/")[1] for v in self.versions()[-keep:] for f in self.manifest(v)["buckets"].values()}
        gone = []
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - older_seconds:
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return gone


def upsert_null_safe(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``upsert`` in which null keys meet; missing columns of ``new`` become null."""
    safe = [F.struct(F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    name = "__key"
    merged = upsert(old.withColumn(name, F.struct(*safe)), new.withColumn(name, F.struct(*safe)).select(name, *[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]).select(*old.columns, name), [name])
    return merged.drop(name)
