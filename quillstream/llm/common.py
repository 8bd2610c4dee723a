"""What the operators of this subpackage share: input columns, folds, written tables, joins of hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of texts that go to Python at once, where the session has Spark's own bound (64 MB).
TEXT_BATCH, ARROW_BYTES, DEFAULT_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def _bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes: ten thousand rows of texts are too much for a worker."""
    if spark.conf.get(ARROW_BYTES, f"{DEFAULT_BYTES}b").rstrip("b") == str(DEFAULT_BYTES):
        spark.conf.set(ARROW_BYTES, f"{TEXT_BATCH}b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, through Spark's reader only."""
    _bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    In a local session a temporary folder takes its place where the setting is absent; on a
    cluster its absence is an error, as no folder of one machine would do.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks that were running there, not what
    stands above. ``parts`` are columns to partition the files by. Tables that lazily evaluated
    results read outlive the call; ``forget`` deletes one that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path) if parts else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table that ``written`` made."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Arrow types of the columns that operators add.
_ARROW = {
    "string": pa.string(),
    "double": pa.float64(),
    "int": pa.int32(),
    "long": pa.int64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def per_text(rows: DataFrame, added: dict[str, str], compute: Callable[[list[str | None]], Iterator[tuple[int, int, list]]]) -> DataFrame:
    """The columns of ``rows`` but ``text``, and for each row what ``compute`` makes of its text.

    compute: from the texts of a batch, portions (first row, row after the last, the added
    columns, as lists or Arrow arrays). All other columns pass through as Arrow arrays: an id keeps its 64 bits, and
    null, whatever stands beside it.
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept] + list(added)
    types = [_ARROW[t] for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for start, end, made in compute(texts):
                own = [b.column(f.name).slice(start, end - start) for f in kept]
                own += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(own, names=names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in added.items()])
    return rows.mapInArrow(run, schema)


def whole(compute: Callable[[list[str | None]], list]) -> Callable[[list[str | None]], Iterator[tuple[int, int, list]]]:
    """``compute`` of all texts of a batch at once, for ``per_text``."""
    return lambda texts: iter([(0, len(texts), compute(texts))] if texts else [])


_RESIDENT: list[tuple[Any, Any]] = []
M_ARENA_MAX = -8


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` makes, kept in the worker process until another key is asked for.

    Workers are used again for later tasks, of other operators too: so what one operator remembers lasts
    over its tasks, and doesn't add to what the next one does.
    """
    if not _RESIDENT or _RESIDENT[0][0] != key:
        _RESIDENT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL(None)  # glibc: one arena for all threads, and what was freed goes back to the system
            libc.mallopt(M_ARENA_MAX, 1)
            libc.malloc_trim(0)
        _RESIDENT.append((key, make()))
    return _RESIDENT[0][1]


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (long), the further columns, text (string)."""
    _bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))


def held_out(parts: int, held: int) -> Column:
    """held_out: whether the fold of the id is ``held`` (no id: false)."""
    return F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out")


#: Up to so many ids (8 bytes each) are broadcast; beyond it the rows are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``ids`` (doc_id). Rows without an id stay."""
    ids = written(ids.select("doc_id").filter("doc_id is not null").distinct(), "dropped_ids")
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(*docs.columns)


#: A key is hot if more than one row in HOT_SHARE has it: fewer than HOT_SHARE keys are.
HOT_SHARE = 2_000


def attached(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``table`` (one row for each key) on ``key``.

    ``n`` is the column of ``table`` with the number of ``rows`` of the key, ``total`` their
    number in all. The rows of hot keys, fewer than ``HOT_SHARE`` keys by their definition, are
    joined by broadcast where they are; only the others are dealt out by key. So no key's rows
    meet in one task.
    """
    hot = F.col(n) * HOT_SHARE > total
    few = table.filter(hot)
    here = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.filter(~hot), key)
    return here.unionByName(rest)
