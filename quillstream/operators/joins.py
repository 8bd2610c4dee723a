"""Joins with guards: overlays, uniqueness, priority, nearest following row, positional alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Rows of equal key and position, only for keys whose sides have as many rows."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    equal = count(left, "_l").join(count(right, "_r"), keys).filter("_l = _r").select(*keys)
    return left.join(right, [*keys, pos]).join(equal, keys, "left_semi")


def overlay(units: DataFrame, edits: DataFrame, key: str, source_hash: Column, text: str) -> DataFrame:
    """Adds ``effective``: the last edit if it was made on the same source, else ``text``."""
    kept = edits.select(key, F.col("source_hash").alias("_hash"), F.col("history").alias("_history"))
    valid = (F.col("_hash") == source_hash) & (F.size("_history") > 0)
    last = F.call_function("try_element_at", F.col("_history"), F.lit(-1))
    return units.join(kept, key, "left").withColumn("effective", F.when(valid, last).otherwise(F.col(text))).drop("_hash", "_history")


def guarded_location(units: DataFrame, places: DataFrame, key: str, unit_order: str, place_order: str) -> DataFrame:
    """Units with the place of the same key, where that is unambiguous.

    A key with one place gives it to all its units; one with as many places as units pairs
    them in order; others give nothing. Keys are judged by their counts first (partial sums), so
    that no pair is made and thrown away: units of single places meet one row each, and only keys
    of equal counts are numbered, on both sides, and joined by key and number.
    """
    n = units.groupBy(key).agg(F.count("*").alias("_n"))
    m = places.groupBy(key).agg(F.count("*").alias("_m"))
    fits = n.join(m, key).filter((F.col("_m") == 1) | (F.col("_m") == F.col("_n"))).select(key, (F.col("_m") == 1).alias("_single"))
    single, several = fits.filter("_single").select(key), fits.filter("not _single").select(key)
    numbered = lambda df, order: df.join(several, key, "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    alone = units.join(places.join(single, key, "left_semi"), key)
    paired = numbered(units, unit_order).join(numbered(places, place_order), [key, "_k"]).drop("_k")
    return alone.unionByName(paired)


def by_priority(rows: DataFrame, key: Column, priority: Column) -> DataFrame:
    """The row of the highest priority for each key; map-side, as one aggregate."""
    picked = rows.groupBy(key.alias("key")).agg(F.max_by(F.struct(*rows.columns), priority).alias("_row"))
    return picked.select("key", "_row.*")


def merge(existing: DataFrame, incoming: DataFrame, key: str, value: str, policy: str = "error") -> DataFrame:
    """Upsert of (key, value). policy: ``error``, ``keep`` or ``replace`` where values differ."""
    old = existing.select(key, F.col(value).alias("_old"))
    new = incoming.select(key, F.col(value).alias("_new"))
    conflict = F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old") != F.col("_new"))
    chosen = {
        "keep": F.coalesce("_old", "_new"),
        "replace": F.coalesce("_new", "_old"),
        "error": F.when(conflict, F.raise_error(F.concat(F.lit("conflict: "), key)).cast("string")).otherwise(F.coalesce("_new", "_old")),
    }[policy]
    return old.join(new, key, "full").select(key, chosen.alias(value))


def next_on_page(items: DataFrame, blocks: DataFrame, page: list[str], below: str, top: str, name: str) -> DataFrame:
    """Adds ``name``: the first block of the item's page that starts at or below the item's end, else null.

    ``blocks`` has ``block``, ``top`` and the page columns; of blocks at one height the least counts. Both
    sides are one table, read from the foot of each page upwards: an as-of join that makes no
    pairs. ``page`` should name the book too, as a page is sorted in one task.
    """
    row = F.struct(*items.columns)
    both = items.select(*page, F.col(below).cast("double").alias("_at"), F.lit(None).cast(blocks.schema["block"].dataType).alias("_block"), row.alias("_item"))
    both = both.unionByName(blocks.select(*page, F.col(top).cast("double").alias("_at"), F.col("block").alias("_block")), allowMissingColumns=True)
    # Blocks before items at one height, the least block last: it is the nearest seen.
    upwards = Window.partitionBy(*page).orderBy(F.desc("_at"), F.col("_block").isNull(), F.desc("_block")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_next", F.last("_block", ignorenulls=True).over(upwards))
    return seen.filter("_item is not null").select("_item.*", F.col("_next").alias(name))


def carried_over(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New rows with the columns of the old ones of the same keys, where they have none."""
    kept = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = new.join(kept, keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") if c in new.columns else F.col(f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def aligned_sequences(old: DataFrame, new: DataFrame, group: str, pos: str, content: list[str]) -> DataFrame:
    """Groups whose whole sequences of ``content`` are equal on both sides (group, aligned)."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        item = F.sha2(F.to_json(F.struct(*content)).cast("binary"), 256)
        ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), item.alias("h"))))
        return df.groupBy(group).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), "").cast("binary"), 256).alias(name))

    return digest(new, "_n").join(digest(old, "_o"), group, "left").select(group, F.coalesce(F.col("_n") == F.col("_o"), F.lit(False)).alias("aligned"))
