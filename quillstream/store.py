"""Versioned tables in any file system that Spark reaches: publish, compare and swap, recover.

A version is a directory of Parquet tables that is never changed. A pointer file names the
current one; publishing writes all tables of a version first and moves the pointer last, by a
rename. A crash before that leaves the former version in force, and ``recover`` removes what
was left. ``expected`` makes publishing conditional on the version that was read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


class Conflict(RuntimeError):
    """Somebody else has published since."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def current(self) -> str | None:
        """Name of the version in force."""
        pointer = self._path(f"{self.root}/{POINTER}")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode().strip() or None
        finally:
            stream.close()

    def read(self, table: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"nothing published in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{version}/{table}")

    def _lock(self):
        """One publisher at a time: creation of the lock file is atomic."""
        lock = self._path(f"{self.root}/_lock")
        if not self._fs.createNewFile(lock):
            raise Conflict("another publication is under way")
        return lock

    def publish(self, tables: dict[str, DataFrame], expected: str | None | type(...) = ...) -> str:
        """Publishes all the tables or none; with ``expected``, only over that version."""
        version = f"v{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        lock = self._lock()
        try:
            if expected is not ... and self.current() != expected:
                self._fs.delete(self._path(f"{self.root}/{version}"), True)
                raise Conflict(f"the current version is no longer {expected}")
            fresh = self._path(f"{self.root}/_pointer-{version}")
            stream = self._fs.create(fresh)
            stream.write(version.encode())
            stream.close()
            self._move(fresh)
        finally:
            self._fs.delete(lock, False)
        return version

    def _move(self, fresh) -> None:
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._path(f"{self.root}/{POINTER}")), options)

    def roll_back(self, version: str) -> None:
        """Makes an earlier version the current one."""
        if not self._fs.exists(self._path(f"{self.root}/{version}")):
            raise FileNotFoundError(version)
        fresh = self._path(f"{self.root}/_pointer-{version}")
        stream = self._fs.create(fresh, True)
        stream.write(version.encode())
        stream.close()
        self._move(fresh)

    def versions(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())

    def recover(self, keep: int = 3, grace: float = 3_600.0) -> list[str]:
        """Removes the locks and pointers of crashed publications, and all but the latest versions.

        Only what is older than ``grace`` seconds goes: a lock that a publisher still holds and a version
        that it is writing are younger, as long as ``grace`` is more than a publication takes.
        """
        jvm = self.spark.sparkContext._jvm
        before = jvm.System.currentTimeMillis() - grace * 1000
        listed = [(s.getModificationTime(), s.getPath().getName(), s.isDirectory(), s.getPath()) for s in self._fs.listStatus(self._path(self.root))]
        for at, name, _, path in listed:
            if name.startswith(("_lock", "_pointer-")) and at <= before:
                self._fs.delete(path, False)
        now = self.current()
        dated = sorted((at, name) for at, name, folder, _ in listed if folder)
        gone = [name for at, name in dated[: max(0, len(dated) - keep)] if name != now and at <= before]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone

    @contextmanager
    def exporting(self):
        """Holds the export lock and gives the version to export: one export at a time, while edits go on.

        The lock of publications is another, taken after this one and only while a version is published;
        an export reads its version to the end whatever is published meanwhile.
        """
        lock = self._path(f"{self.root}/_lock-export")
        if not self._fs.createNewFile(lock):
            raise Conflict("another export is under way")
        try:
            yield self.current()
        finally:
            self._fs.delete(lock, False)


def migrate(store: Store, table: str, to: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> str | None:
    """Brings a table to schema version ``to``, a step at a time, and publishes it; the version before stays as backup.

    The table has a column schema_version. steps: from each version, the table of the next. Nothing is
    published if all rows are at ``to``; a table with rows of a later version is left alone, as an error.
    """
    before = store.current()
    now = store.read(table, before)
    found = sorted(r[0] for r in now.select("schema_version").distinct().collect())
    if found and found[-1] > to:
        raise ValueError(f"{table} has schema version {found[-1]}, later than {to}")
    if all(v == to for v in found):
        return None
    for v in range(found[0], to):
        older, rest = now.filter(F.col("schema_version") == v), now.filter(F.col("schema_version") != v)
        now = steps[v](older).withColumn("schema_version", F.lit(v + 1)).unionByName(rest, allowMissingColumns=True)
    return store.publish({table: now}, expected=before)


def current_edits(log: DataFrame) -> DataFrame:
    """unit_id, source_hash, history of an append-only log (unit_id, source_hash, text, at, undone)."""
    live = log.groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "source_hash", "text", "undone"))).alias("e"),
    )
    start = F.expr("cast(array() as array<struct<source_hash: string, text: string>>)")

    def step(s, x):
        return F.when(x["undone"], F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(
            F.concat(s, F.array(F.struct(x["source_hash"].alias("source_hash"), x["text"].alias("text"))))
        )

    folded = live.select("unit_id", F.aggregate("e", start, step).alias("h"))
    last = F.call_function("try_element_at", F.col("h"), F.lit(-1))["source_hash"]
    return folded.select("unit_id", last.alias("source_hash"), F.transform("h", lambda x: x["text"]).alias("history"))
