"""Order-dependent operators: islands, running values, stacks, packers, neighbourhoods.

All windows and folds are per document or group; none orders a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType


def reference_ranges(blocks: DataFrame, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds ``in_reference``: from a heading ``References`` to the next one of its level or above.

    A fold is not needed: a reference section is open at a block if, since the last reference
    heading, no heading of its level or less has come.
    """
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("kind") == "heading") & F.col("text").rlike(r"(?i)^#{1,6}\s+(\d+(\.\d+)*[.)]?\s+)?(references|bibliography|works cited|literature cited|参考文献|參考文獻)\s*[:：]?$")
    staged = blocks.withColumn("_open", F.last(F.when(opens, F.struct(F.col("level").alias("l"), F.col(pos).alias("p"))), ignorenulls=True).over(w))
    since = Window.partitionBy(group, "_open.p").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    later = (F.col("kind") == "heading") & (F.col(pos) > F.col("_open.p"))
    lowest = F.min(F.when(later, F.col("level"))).over(since)
    held = F.col("_open").isNotNull() & (lowest.isNull() | (lowest > F.col("_open.l")))
    return staged.withColumn("in_reference", held).drop("_open")


def heading_paths(blocks: DataFrame, group: str = "doc_id", pos: str = "pos", depth: int = 6) -> DataFrame:
    """Adds ``path``: the open headings above and at each block, joined by `` / ``.

    A heading of level n is open if none of a level below n, and none of level n, came after it.
    """
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    out, names = blocks, []
    for n in range(1, depth + 1):
        at = F.last(F.when(heading & (F.col("level") == n), F.struct(F.col(pos).alias("p"), F.col("text").alias("t"))), ignorenulls=True).over(w)
        above = F.max(F.when(heading & (F.col("level") < n), F.col(pos))).over(w)
        out = out.withColumns({f"_h{n}": at, f"_a{n}": above})
        names += [f"_h{n}", f"_a{n}"]
    titles = [
        F.when(F.col(f"_a{n}").isNull() | (F.col(f"_a{n}") < F.col(f"_h{n}.p")), F.regexp_replace(F.col(f"_h{n}.t"), r"^#{1,6}\s+", ""))
        for n in range(1, depth + 1)
    ]
    return out.withColumn("path", F.concat_ws(" / ", *titles)).drop(*names)


def running_chapter(blocks: DataFrame, deepest: int = 3, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds ``chapter``: the last heading of at most that level."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    title = F.when((F.col("kind") == "heading") & (F.col("level") <= deepest), F.col("text"))
    return blocks.withColumn("chapter", F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit("")))


def cost(kind: Column, text: Column) -> Column:
    """Cost of a block: its length, but 60 for what is not running text."""
    return F.when(kind.isin("table", "formula", "image", "code", "reference"), F.lit(60)).otherwise(F.length(text))


def numbered(number: Callable[..., list[int]], *columns: Column) -> Column:
    """array<bigint>: a number for each item of a group's parallel arrays, by a linear pass in Arrow batches."""

    def run(group: pd.DataFrame) -> pd.Series:
        return pd.Series([number(*arrays) for arrays in zip(*(group[c] for c in group), strict=True)], dtype=object)

    arrays = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    return F.pandas_udf(run, "array<bigint>", functionType=PandasUDFType.SCALAR)(arrays)


def packed(blocks: DataFrame, maximum: int = 10_000, minimum: int = 1_800, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """group, pos, segment: number of the segment that each block falls in.

    A segment ends before a block that would exceed the maximum, or before a heading of level
    1 or 2 once it has the minimum; never right after an image or table. One pass over a document's
    costs and flags; texts don't enter it.
    """
    top = (F.col("kind") == "heading") & (F.col("text").startswith("# ") | F.col("text").startswith("## "))
    item = F.struct(
        F.col(pos).cast("long").alias("pos"),
        cost(F.col("kind"), F.col("text")).cast("long").alias("cost"),
        F.coalesce(top, F.lit(False)).alias("top"),
        F.col("kind").isin("image", "table").alias("sticky"),
    )
    ordered = blocks.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def segments(costs, tops, sticky) -> list[int]:
        out, size, number, held = [], 0, 0, True
        for c, t, s in zip(costs, tops, sticky, strict=True):
            if not held and (size + c > maximum or t and size >= minimum):
                number, size = number + 1, 0
            size, held = size + c + 2, s
            out.append(number)
        return out

    made = numbered(segments, F.col("items.cost"), F.col("items.top"), F.col("items.sticky"))
    placed = ordered.select(group, F.col("items.pos").alias("pos"), made.alias("segment"))
    return placed.select(group, F.explode(F.arrays_zip("pos", "segment")).alias("x")).select(group, F.col("x.pos").alias("pos"), F.col("x.segment").alias("segment"))


def cell_batches(cells: DataFrame, items: int = 32, chars: int = 3_500, by_row: bool = True, group: str = "table_id") -> DataFrame:
    """group, row_no, col_no, batch: a new batch at so many cells or characters, or at a new row."""
    item = F.struct(F.col("row_no").cast("int").alias("row_no"), F.col("col_no").cast("int").alias("col_no"), F.length("text").cast("long").alias("size"))
    ordered = cells.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def batches(rows, sizes) -> list[int]:
        out, n, size, number, row = [], 0, 0, 0, None
        for r, s in zip(rows, sizes, strict=True):
            if n and (n >= items or size + s > chars or by_row and r != row):
                n, size, number = 0, 0, number + 1
            n, size, row = n + 1, size + s, r
            out.append(number)
        return out

    made = numbered(batches, F.col("items.row_no"), F.col("items.size"))
    placed = ordered.select(group, F.col("items.row_no").alias("row_no"), F.col("items.col_no").alias("col_no"), made.alias("batch"))
    return placed.select(group, F.explode(F.arrays_zip("row_no", "col_no", "batch")).alias("x")).select(group, "x.row_no", "x.col_no", "x.batch")


def ordered_positions(rows: DataFrame, place: str, step: int = 1_000) -> DataFrame:
    """rows with pos: their number from 1 in the order of a numeric ``place``, without one task that sorts them all.

    Rows are numbered within ranges of ``step`` places; the ranges' counts are summed within ranges of
    ``step`` ranges, and these over all. So a window without a partition sees one row for each
    ``step`` * ``step`` places.
    """
    ranged = rows.withColumn("_part", F.floor(F.col(place) / step)).withColumn("_over", F.floor(F.col("_part") / step))
    counts = ranged.groupBy("_over", "_part").agg(F.count("*").alias("_n"))
    until = (Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_over").orderBy("_part").rowsBetween(*until)), F.lit(0))
    above = counts.groupBy("_over").agg(F.sum("_n").alias("_m"))
    outer = above.select("_over", F.coalesce(F.sum("_m").over(Window.orderBy("_over").rowsBetween(*until)), F.lit(0)).alias("_before"))
    offsets = counts.withColumn("_inner", inner).join(outer, "_over").select("_part", (F.col("_inner") + F.col("_before")).alias("_offset"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(place)))
    return numbered.join(offsets, "_part").withColumn("pos", F.col("_offset") + F.col("_k")).drop("_part", "_over", "_k", "_offset")


def reference_entries(lines: DataFrame, group: str = "doc_id", pos: str = "pos") -> DataFrame:
    """group, entry, number, text, jump_from: numbered entries with their continuation lines merged.

    Lines before the first numbered one have no entry and go.
    """
    number = F.regexp_extract("line", r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})\.)\s+", 1)
    dotted = F.regexp_extract("line", r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})\.)\s+", 2)
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_n", F.coalesce(F.nullif(number, F.lit("")), F.nullif(dotted, F.lit(""))).cast("int"))
    marked = marked.withColumn("entry", F.count("_n").over(w)).filter("entry > 0")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.trim("line").alias("line"))))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["line"]), " "), r"\s+", " "))
    entries = marked.groupBy(group, "entry").agg(F.max("_n").alias("number"), text.alias("text"), (F.count("*") - 1).alias("merged"))
    before = F.lag("number").over(Window.partitionBy(group).orderBy("entry"))
    return entries.withColumn("_b", before).withColumn("jump_from", F.when(F.col("number") != F.col("_b") + 1, F.col("_b"))).drop("_b")


def excerpts(texts: DataFrame, limit: int, tail: bool, group: str, pos: str) -> DataFrame:
    """group, excerpt: whole paragraphs from the start (or the end) up to ``limit`` characters."""
    key = -F.col(pos) if tail else F.col(pos)
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("text").alias("t"))))
    start = F.expr("named_struct('size', 0L, 'open', true, 'out', cast(array() as array<string>))")

    def step(s: Column, x: Column) -> Column:
        fits = s["open"] & (s["size"] + F.length(x["t"]) + 2 <= limit)
        return F.struct(
            F.when(fits, s["size"] + F.length(x["t"]) + 2).otherwise(s["size"]).alias("size"),
            fits.alias("open"),
            F.when(fits, F.concat(s["out"], F.array(x["t"]))).otherwise(s["out"]).alias("out"),
        )

    out = F.aggregate("items", start, step, lambda s: F.array_join(F.reverse(s["out"]) if tail else s["out"], "\n\n"))
    return texts.groupBy(group).agg(items.alias("items")).select(group, out.alias("excerpt"))
