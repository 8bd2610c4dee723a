"""The review index: search, decisions, roll-up, paging, unions of issue streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from ..sources import fixtures
from ..sources.tables import read_table, scratch
from ..store import Store
from . import twins
from .registry import query

INDEXED = (
    twins.with_(twins.UNITS)
    + """,
indexed AS (
  SELECT *, lower(unit_id || ' ' || chapter || ' ' || source || ' ' || translated) AS search,
         CASE WHEN list_contains(issues, '表格结构不能可靠对应') THEN 0 WHEN list_contains(issues, '数字可能发生变化') THEN 1
              WHEN list_contains(issues, '术语待核对：tax → 税') THEN 2 WHEN len(issues) > 0 THEN 3 ELSE 4 END AS rank,
         CASE WHEN CAST(split_part(unit_id, ':', 3) AS BIGINT) % 4 = 0 THEN 'dismissed'
              WHEN CAST(split_part(unit_id, ':', 3) AS BIGINT) % 4 = 2 THEN 'confirmed' ELSE 'open' END AS status
  FROM units)
"""
)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on three quarters of the units; those on every fourth are out of date."""
    units = fixtures.units(spark, sf_dir)
    part = F.split("unit_id", ":")[2].cast("long")
    key = review.decision_key(F.col("source"), F.col("translated"), F.col("issues"))
    stale = review.decision_key(F.col("source"), F.lit("an older text"), F.col("issues"))
    status = F.when(part % 4 == 0, "dismissed").otherwise("confirmed")
    decisions = units.filter(part % 4 != 3).select("unit_id", F.when(part % 4 == 1, stale).otherwise(key).alias("key"), status.alias("status"))
    return review.with_status(review.index(units), decisions.dropDuplicates(["unit_id", "key"]))


def _index_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.index(fixtures.units(spark, sf_dir))


@query(INDEXED + "SELECT DISTINCT unit_id, rank, status FROM indexed")
def e5_decision_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision counts only while what it was made on is unchanged."""
    return _indexed(spark, sf_dir).select("unit_id", "rank", "status").distinct()


@query(INDEXED + "SELECT parent_id, min(rank) AS rank FROM indexed WHERE len(issues) > 0 AND status = 'open' AND contains(search, 'supplier 1') GROUP BY parent_id")
def e4_issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.select(_indexed(spark, sf_dir), query="Supplier 1")


@query(INDEXED + "SELECT parent_id, min(rank) AS rank FROM indexed WHERE len(issues) > 0 GROUP BY parent_id")
def g16_parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest issue of each table, whatever was decided."""
    return review.select(_index_only(spark, sf_dir), status="all")


@query(INDEXED + "SELECT parent_id, min(rank) AS rank FROM indexed WHERE len(issues) > 0 AND chapter = 'chapter 3' AND rank = 1 GROUP BY parent_id")
def e4_filter_by_chapter_and_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.select(_index_only(spark, sf_dir), chapter="chapter 3", category="数值与单位", status="all")


@query(INDEXED + "SELECT parent_id, min(rank) AS rank FROM indexed WHERE len(issues) > 0 GROUP BY parent_id ORDER BY rank, parent_id LIMIT 100 OFFSET 200")
def h12_result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 100 results."""
    return review.page(review.select(_index_only(spark, sf_dir), status="all"), 2)


@query(
    twins.with_(twins.CELLS)
    + """
SELECT table_id, row_no, col_no, text FROM cells WHERE row_no <= 6 AND row_no + CASE WHEN row_no % 2 = 1 THEN 3 ELSE 1 END > 4"""
)
def h12_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of three rows of every table, with the cells that span into it."""
    height = F.when(F.col("row_no") % 2 == 1, 3).otherwise(1)
    cells = fixtures.cells(spark, sf_dir).withColumn("height", height)
    return review.table_page(cells, 1, 3).select("table_id", "row_no", "col_no", "text")


@query(INDEXED + "SELECT parent_id, min(rank) AS rank FROM indexed WHERE len(issues) > 0 AND status = 'open' AND chapter = 'chapter 4' GROUP BY parent_id")
def e4_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written once and searched from its stored version."""
    store = Store(spark, scratch(spark, "index"))
    review.publish_index(store, _indexed(spark, sf_dir))
    return review.search_index(store, chapter="chapter 4")


@query(INDEXED + "SELECT chapter, count(DISTINCT unit_id) FILTER (WHERE len(issues) > 0 AND status = 'open') AS open_issues FROM indexed GROUP BY chapter")
def g14_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _indexed(spark, sf_dir).dropDuplicates(["unit_id"])
    return review.unresolved(leaves)


@query(
    INDEXED
    + """
SELECT chapter, unit_id, rank, row_number() OVER (PARTITION BY chapter ORDER BY rank, unit_id) AS place FROM (SELECT DISTINCT chapter, unit_id, rank FROM indexed WHERE len(issues) > 0)"""
)
def i1_issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a chapter by rank, then in document order."""
    found = _index_only(spark, sf_dir).filter(F.size("issues") > 0).select("chapter", "unit_id", "rank").distinct()
    return review.numbered_within(found, "chapter", ["rank", "unit_id"])


@query(
    INDEXED
    + """
SELECT unit_id AS id, 'unit' AS stream, chapter, page, rank FROM indexed WHERE len(issues) > 0
UNION ALL SELECT 'omission:' || page_id, 'omission', NULL, CAST(page_id % 20 + 1 AS INTEGER), 0 FROM pages WHERE page_id % 6 = 0
UNION ALL SELECT 'export:' || event_id, 'export', '导出与解析', NULL, 4 FROM events WHERE event_type = 'error'"""
)
def j1_issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of units, omissions and the export as one stream."""
    units = _index_only(spark, sf_dir).filter(F.size("issues") > 0).select(F.col("unit_id").alias("id"), F.lit("unit").alias("stream"), "chapter", "page", "rank")
    omissions = read_table(spark, sf_dir, "pages").filter("page_id % 6 = 0").select(
        F.concat(F.lit("omission:"), "page_id").alias("id"), F.lit("omission").alias("stream"), (F.col("page_id") % 20 + 1).cast("int").alias("page"), F.lit(0).alias("rank")
    )
    exports = read_table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("export:"), "event_id").alias("id"), F.lit("export").alias("stream"), F.lit("导出与解析").alias("chapter"), F.lit(4).alias("rank")
    )
    return review.issue_streams(units, omissions, exports)


@query(
    twins.with_(twins.EDITS)
    + """
SELECT d.doc_id, CASE WHEN e.source_hash = sha256(coalesce(text, '')) THEN len(history) ELSE 0 END AS valid_edits,
       e.source_hash IS NOT NULL AND e.source_hash <> sha256(coalesce(text, '')) AS drifted
FROM documents d LEFT JOIN edits e USING (doc_id)"""
)
def k8_edit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that were made on a text which has changed since."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    joined = docs.join(fixtures.edits(spark, sf_dir), "doc_id", "left")
    valid = F.when(F.col("source_hash") == F.col("h"), F.size("history")).otherwise(0).cast("long")
    return joined.select("doc_id", valid.alias("valid_edits"), F.coalesce(F.col("source_hash") != F.col("h"), F.lit(False)).alias("drifted"))
