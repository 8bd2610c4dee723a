"""The review index: issues of units, decisions on them, search, roll-up, ranked pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..store import Store
from . import checks

#: Version of the rules that a decision was made under (fixed value).
RULES = "review-rules-v2"


def decision_key(source: Column, effective: Column, issues: Column) -> Column:
    """What a decision depends on; another text, source or set of issues reopens it."""
    return fingerprint(F.lit(RULES), source, effective, F.array_join(issues, "；"))


def index(units: DataFrame) -> DataFrame:
    """Units with rank, category, and the string that searches look into."""
    rank = checks.category_rank(F.col("issues"), F.col("kind"))
    text = F.lower(F.concat_ws(" ", "unit_id", "chapter", "source", "translated"))
    return units.withColumns({"rank": rank, "search": text}).withColumn("category", checks.category(F.col("rank")))


def with_status(indexed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``status``: the decision on a unit while its key still holds, else ``open``."""
    current = decision_key(F.col("source"), F.col("translated"), F.col("issues"))
    saved = decisions.select("unit_id", F.col("key").alias("_key"), F.col("status").alias("_status"))
    joined = indexed.join(saved, "unit_id", "left")
    return joined.withColumn("status", F.when(F.col("_key") == current, F.col("_status")).otherwise("open")).drop("_key", "_status")


def select(indexed: DataFrame, query: str = "", chapter: str = "", category: str = "", status: str = "open", issues_only: bool = True) -> DataFrame:
    """parent_id, rank: parents of the units that fit, at the best rank of theirs."""
    chosen = indexed
    if issues_only:
        chosen = chosen.filter(F.size("issues") > 0)
        chosen = chosen if status == "all" else chosen.filter(F.col("status") == status)
    if query.strip():
        chosen = chosen.filter(F.col("search").contains(query.strip().lower()))
    if chapter:
        chosen = chosen.filter(F.col("chapter") == chapter)
    if category:
        chosen = chosen.filter(F.col("category") == category)
    return chosen.groupBy("parent_id").agg(F.min("rank").alias("rank"))


def page(selected: DataFrame, number: int, size: int = 100) -> DataFrame:
    """A page of results by rank and document order: a bounded top-k with an offset."""
    return selected.orderBy("rank", "parent_id").offset(number * size).limit(size)


def unresolved(indexed: DataFrame) -> DataFrame:
    """chapter, open_issues: leaf units with issues that nobody confirmed or dismissed."""
    left = (F.size("issues") > 0) & ~F.col("status").isin("confirmed", "dismissed")
    return indexed.groupBy("chapter").agg(F.count_if(left).alias("open_issues"))


def table_page(cells: DataFrame, number: int, size: int = 40, group: str = "table_id") -> DataFrame:
    """The cells of page ``number`` of each table: its rows, and cells of earlier rows that span into them.

    cells: row_no (from 1), height.
    """
    first, last = number * size + 1, (number + 1) * size
    return cells.filter((F.col("row_no") <= last) & (F.col("row_no") + F.col("height") > first))


def publish_index(store: Store, indexed: DataFrame) -> str:
    """The index as a version of a store, sorted by chapter and rank, so that filters skip files and row groups."""
    return store.publish({"index": indexed.repartitionByRange("chapter", "rank").sortWithinPartitions("chapter", "rank")})


def search_index(store: Store, **how) -> DataFrame:
    """A search of the current version: nothing is computed again, and only the columns asked for are read."""
    return select(store.read("index"), **how)


def numbered_within(indexed: DataFrame, group: str, order: list[str]) -> DataFrame:
    return indexed.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def issue_streams(*streams: DataFrame) -> DataFrame:
    """Streams of issues with different columns as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
