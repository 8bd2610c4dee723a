"""Exact deduplication: two passes of a Bloom filter, so that only possible repeats shuffle.

Pass 1 gives every text hash one slot of a filter and counts the hits of a slot with map-side
partial sums (one row of two numbers moves for each slot and task); a bitmap keeps the slots
that were hit twice or more. Pass 2 tests every hash against the bitmap: a hash whose slot one row hit
is unique and passes straight through where it is; the rest (repeats and a few false
positives) is grouped by the full SHA-256. Texts never shuffle for the digests, and
``deduplicated`` moves those of possible repeats alone. The rows of a large group meet its
result by broadcast (``attached``), so no group's rows come together in one task.

The bitmap is the one thing sent to all tasks: ``SLOTS_PER_ROW`` bits for each row, rounded up
to a power of two, at most ``MAX_SLOTS`` (2**28 bits: 32 MB). It keeps false positives below 6 % up
to 16 million rows. Beyond that it fills up, and the share of unique rows that take the grouped
way rises with the rows for each slot; results stay the same.

Edge cases: a null text counts as empty; an empty table gives an empty result; rows without an
id group by text like others, and a null id never wins over a real one. Of rows that repeat
the id and the text, ``exact_dedup`` marks all as kept, being one and the same document;
``deduplicated`` lets one of them stay, the least by its other columns. Further columns of the
input are ignored by the digests and pass through ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attached, written

MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 28
SLOTS_PER_ROW = 16
#: 64-bit words of the bitmap in one row of its table.
CHUNK = 1024


def text_sha256() -> Column:
    """SHA-256 of the text with white-space runs as one space."""
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(spaced.cast("binary"), 256)


def _slots(count: int) -> int:
    wanted = max(MIN_SLOTS, count * SLOTS_PER_ROW)
    return min(MAX_SLOTS, 1 << (wanted - 1).bit_length())


def _slot(slots: int, sha: str = "text_sha256") -> Column:
    """The slot of a hash."""
    return F.xxhash64(sha).bitwiseAND(F.lit(slots - 1))


def repeated_bitmap(hashes: DataFrame, slots: int) -> DataFrame:
    """One row: array of slots / 64 words whose bits are the slots hit twice or more."""
    spark = hashes.sparkSession
    hits = hashes.groupBy(_slot(slots).alias("slot")).agg(F.count("*").alias("n"))
    words = (
        hits.filter("n > 1")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    every = spark.range(slots // 64).withColumnRenamed("id", "word")
    dense = every.join(words, "word", "left").select(
        F.expr(f"word div {CHUNK}").alias("chunk"),
        F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"),
    )
    rows = dense.groupBy("chunk").agg(F.expr("transform(array_sort(collect_list(w)), x -> x.bits)").alias("bits"))
    return rows.agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(chunk, bits))), x -> x.bits))").alias("bitmap")
    )


def _maybe(bitmap: Column, slots: int, sha: str = "text_sha256") -> Column:
    """Whether the slot of the hash was hit twice or more."""
    place = _slot(slots, sha)
    word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return word.bitwiseAND(bit) != F.lit(0)


class _Passes:
    """Both passes over a table of digests (doc_id, text_sha256)."""

    def __init__(self, digests: DataFrame) -> None:
        self.hashes = written(digests, "text_hashes")
        self.count = self.hashes.count()
        self.slots = _slots(self.count)
        # A scalar subquery: computed once, bounded by MAX_SLOTS, no join.
        self.bitmap = written(repeated_bitmap(self.hashes, self.slots), "repeated_bitmap").scalar()
        maybe = _maybe(self.bitmap, self.slots)
        self.alone = self.hashes.filter(~maybe)
        self.maybe = self.hashes.filter(maybe)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    passes = _Passes(docs.select("doc_id", text_sha256().alias("text_sha256")))
    alone = passes.alone.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    agg = (F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(passes.maybe.groupBy("text_sha256").agg(*agg), "text_groups")
    grouped = attached(passes.maybe, groups, "text_sha256", "group_size", passes.count).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionAll(grouped)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, that with the smallest id.

    Rows that the filter lets through are not moved. Of the others those stay that have the hash
    and the id of a winner; hash and id together are no hot key. Only where an id repeats with
    its text are whole rows compared.
    """
    passes = _Passes(docs.select("doc_id", text_sha256().alias("text_sha256")))
    same = passes.maybe.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    least = F.min_by(F.struct("doc_id", "n"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    wins = same.groupBy("text_sha256").agg(least.alias("w")).select(F.col("text_sha256").alias("__sha"), F.col("w.doc_id").alias("__id"), F.col("w.n").alias("__n"))
    wins = written(wins, "text_winners")
    hashed = docs.withColumn("__text_sha256", text_sha256())
    maybe = _maybe(passes.bitmap, passes.slots, "__text_sha256")

    def winners(of: DataFrame) -> DataFrame:
        return hashed.filter(maybe).join(of, (F.col("__text_sha256") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    out = hashed.filter(~maybe).unionByName(winners(wins.filter("__n = 1")))
    repeated = wins.filter("__n > 1")
    if not repeated.isEmpty():
        one = winners(repeated).groupBy("__text_sha256").agg(F.min(F.struct(*docs.columns)).alias("row"))
        out = out.unionByName(one.select("row.*", "__text_sha256"))
    return out.select(*docs.columns)


ORACLE = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""
