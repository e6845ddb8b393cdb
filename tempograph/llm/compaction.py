"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as runs of small Parquet shards. Runs whose sizes fall
into the same tier (a power of ``fan_in``) are merged once ``fan_in`` of them
have gathered: Spark reads their files and writes files of the target size.
Every change is one new manifest file, made complete under a temporary name and
renamed to the next version; the rename fails if another writer has that
version, so commits are atomic, and the writer tries the next version. Readers
follow the newest manifest and never see half a merge. A writer names its run
under ``pending`` until it is committed; ``vacuum`` removes what neither a kept
manifest nor a pending name holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import free_name, no_clash, scratch

TARGET_BYTES = 32 << 20
FAN_IN = 4
ARRIVALS = 8
#: Most shards whose numbers are broadcast (about 100 bytes each); beyond, a shuffled join adds them.
BROADCAST_SHARDS = 100_000
#: Commits tried before a writer gives up to others.
TRIES = 50
#: After so long a pending name counts as left by a lost writer.
STALE_SECONDS = 7 * 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Run:
    """Shards written together; ``tier`` follows from their size."""

    name: str
    level: int
    shards: tuple[Shard, ...]

    @property
    def bytes(self) -> int:
        return sum(s.bytes for s in self.shards)


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


class MergedError(RuntimeError):
    """Another writer merged a run first; what was written instead is left to ``vacuum``."""


class ShardStore:
    """Runs of shards below ``path``, on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        jvm = spark.sparkContext._jvm
        self._P = jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in ("manifests", "pending"):
            self._fs.mkdirs(self._P(f"{self.path}/{d}"))

    def _files(self, path: str) -> list[Shard]:
        found = self._fs.listStatus(self._P(path)) if self._fs.exists(self._P(path)) else []
        return sorted((Shard(str(s.getPath().toString()), int(s.getLen())) for s in found if s.getPath().getName().endswith(".parquet")), key=lambda s: s.path)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._P(f"{self.path}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """A version's runs; the newest by default, version 0 is empty."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version == 0:
            return 0, []
        stream = self._fs.open(self._P(f"{self.path}/manifests/{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Run(r["name"], r["level"], tuple(Shard(**s) for s in r["shards"])) for r in json.loads(text)["runs"]]

    def commit(self, base: int, runs: list[Run]) -> int:
        """Make ``runs`` version ``base + 1``; raises ConflictError if that exists."""
        version = base + 1
        body = json.dumps({"version": version, "runs": [{"name": r.name, "level": r.level, "shards": [s.__dict__ for s in r.shards]} for r in runs]})
        temp, final = self._P(f"{self.path}/manifests/.{version:08d}-{uuid.uuid4().hex}"), self._P(f"{self.path}/manifests/{version:08d}.json")
        out = self._fs.create(temp, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            self._rename(temp, final)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if not self._fs.exists(final):
                raise
            raise ConflictError(f"version {version} exists") from e
        return version

    def _rename(self, a, b) -> None:
        """Rename that fails if the target exists, atomically where the file system can."""
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), sc._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(a), self._fs.makeQualified(b), options)

    @contextmanager
    def _pending(self, name: str) -> Iterator[None]:
        """Holds ``name`` against ``vacuum`` of other writers until it is committed."""
        mark = self._P(f"{self.path}/pending/{name}")
        self._fs.create(mark, False).close()
        try:
            yield
        finally:
            self._fs.delete(mark, False)

    def _commit_next(self, change: Callable[[list[Run]], list[Run]]) -> int:
        """Commit ``change`` of the newest runs, again if another writer was first."""
        for _ in range(TRIES):
            base, runs = self.manifest()
            try:
                return self.commit(base, change(runs))
            except ConflictError:
                continue
        raise ConflictError(f"no commit in {TRIES} tries")

    def append(self, df: DataFrame) -> int:
        """One arrival: write ``df`` as a run in the partitions it has and commit it."""
        name = f"run-{uuid.uuid4().hex}"
        with self._pending(name):
            df.write.parquet(f"{self.path}/{name}")
            run = Run(name, 0, tuple(self._files(f"{self.path}/{name}")))
            return self._commit_next(lambda runs: [*runs, run])

    def append_many(self, df: DataFrame, arrival_col: str) -> int:
        """One arrival for each value of ``arrival_col``, written in one job, committed one by one."""
        name = f"in-{uuid.uuid4().hex}"
        version = self.manifest()[0]
        with self._pending(name):
            df.write.partitionBy(arrival_col).parquet(f"{self.path}/{name}")
            for d in sorted(str(s.getPath().toString()) for s in self._fs.listStatus(self._P(f"{self.path}/{name}")) if s.isDirectory()):
                run = Run(f"{name}/{d.rsplit('/', 1)[1]}", 0, tuple(self._files(d)))
                version = self._commit_next(lambda runs, run=run: [*runs, run])
        return version

    def tier(self, run: Run) -> int:
        """Runs of one tier differ in size by less than ``fan_in``."""
        t, size = 0, max(1, run.bytes)
        while size >= self.target // self.fan_in * self.fan_in**t:
            t += 1
        return t

    def due(self, runs: list[Run]) -> list[Run]:
        """The smallest tier's runs, oldest first, if enough have gathered; else none."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(self.tier(r), []).append(r)
        return next((tiers[t][: self.fan_in] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def merge(self, runs: list[Run]) -> int:
        """Rewrite runs as one run of target-sized files, without a shuffle, and commit.

        Raises MergedError if another writer has merged one of them meanwhile.
        """
        name = f"run-{uuid.uuid4().hex}"
        files = [s.path for r in runs for s in r.shards]
        gone = {r.name for r in runs}

        def change(now: list[Run]) -> list[Run]:
            if not gone <= {r.name for r in now}:
                raise MergedError("a run was merged by another writer")
            return [*(r for r in now if r.name not in gone), merged]

        with self._pending(name):
            if files:
                n = max(1, -(-sum(r.bytes for r in runs) // self.target))
                self.spark.read.parquet(*files).coalesce(n).write.parquet(f"{self.path}/{name}")
            merged = Run(name, 1 + max(r.level for r in runs), tuple(self._files(f"{self.path}/{name}")))
            return self._commit_next(change)

    def compact(self, vacuum: bool = False) -> int:
        """Merge until no tier is due; returns the version then current. ``vacuum``: earlier versions need not stay readable."""
        while due := self.due(self.manifest()[1]):
            try:
                self.merge(due)
            except MergedError:
                continue  # look at the newest runs again
            if vacuum:
                self.vacuum(1)
        return self.manifest()[0]

    def vacuum(self, keep_versions: int = 2) -> None:
        """Remove shards that none of the newest ``keep_versions`` manifests names and no writer is about to commit."""
        # The order matters: a run written after the listing is not in it, one committed after it is in the manifests.
        found = [s for s in self._fs.listStatus(self._P(self.path)) if s.isDirectory() and s.getPath().getName() not in ("manifests", "pending")]
        now = int(self.spark.sparkContext._jvm.System.currentTimeMillis())
        pending = {s.getPath().getName() for s in self._fs.listStatus(self._P(f"{self.path}/pending")) if now - s.getModificationTime() < 1000 * STALE_SECONDS}
        kept = {s.path.rsplit("/", 1)[0] for v in self.versions()[-keep_versions:] for r in self.manifest(v)[1] for s in r.shards}
        for s in found:
            if s.getPath().getName() in pending:
                continue
            inner = [str(x.getPath().toString()) for x in self._fs.listStatus(s.getPath()) if x.isDirectory()]
            for d in inner or [str(s.getPath().toString())]:
                if d not in kept:
                    self._fs.delete(self._P(d), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it names no shard."""
        files = [s.path for r in self.manifest(version)[1] for s in r.shards]
        return self.spark.read.parquet(*files) if files else None


def compact_documents(docs: DataFrame, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Append the documents as ``arrivals`` arrivals, compact, and read the last version back.

    Adds shard (its number in the manifest), level (merges behind its run) and
    version (of the manifest). An arrival is the id modulo ``arrivals``, 0 for
    null. All rows and columns come back unchanged, repeated rows, nulls and long
    texts included; an empty table gives no rows. The added names must not be
    columns. Equal sizes are merged in the order of their commits.
    """
    no_clash(docs, ["shard", "level", "version"])
    spark = docs.sparkSession
    arrival = free_name(docs, "__arrival")
    store = ShardStore(spark, scratch(spark, "shards"), target_bytes, fan_in)
    store.append_many(docs.withColumn(arrival, F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0))), arrival)
    version = store.compact(vacuum=True)
    _, runs = store.manifest()
    place = [(s.path.rsplit("/", 2)[-2] + "/" + s.path.rsplit("/", 1)[-1], r.level) for r in runs for s in r.shards]
    rows = store.read()
    if rows is None:
        return docs.limit(0).select("*", F.lit(0).alias("shard"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("version"))
    table = spark.createDataFrame([(p, i, lv) for i, (p, lv) in enumerate(place)], "__file string, shard int, level int")
    if len(place) <= BROADCAST_SHARDS:
        table = F.broadcast(table)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)
    return rows.select(*docs.columns, F.url_decode(name).alias("__file")).join(table, "__file").select(*docs.columns, "shard", "level", F.lit(version).cast("long").alias("version"))
