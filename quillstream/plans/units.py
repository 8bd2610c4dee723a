"""Review units end to end: issues, edits, documents, reports, proposals, recovered alignments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import issues, remote, review
from ..sources import fixtures
from ..sources.tables import read_table, spread
from . import twins
from .checks import NUMBERS_SQL
from .registry import query

PHRASE_SQL = r"'\b[A-Z][A-Za-z]+(?:[- ][A-Za-z][A-Za-z]+){2,}\b'"

K4_SQL = (
    twins.with_(twins.ORDER_PAIRS, NUMBERS_SQL)
    + """,
sorted AS (SELECT unit_id, side, list(token ORDER BY token) AS t FROM clean GROUP BY unit_id, side),
same AS (
  SELECT p.unit_id, source, target, coalesce(a.t, []) = coalesce(b.t, []) AS equal
  FROM order_pairs p LEFT JOIN sorted a ON a.unit_id = p.unit_id AND a.side = 'source'
  LEFT JOIN sorted b ON b.unit_id = p.unit_id AND b.side = 'target'),
issues AS (
  SELECT unit_id, list_concat(list_filter([
      CASE WHEN NOT equal THEN '数字可能发生变化' END,
      CASE WHEN len(regexp_extract_all(source, '[A-Za-z]{2,}')) >= 6 AND NOT regexp_matches(target, '[一-鿿]') THEN '疑似整段未翻译' END,
      CASE WHEN length(source) >= 120 AND length(target) < length(source) * 0.12 THEN '译文异常短，可能漏译' END,
      CASE WHEN length(source) >= 120 AND length(target) > length(source) * 2 THEN '译文异常长，可能增加内容' END],
      lambda x: x IS NOT NULL), list_filter(regexp_extract_all(target, """
    + PHRASE_SQL
    + """), lambda p: length(p) >= 18)) AS issues
  FROM same)"""
)


@query(K4_SQL + " SELECT unit_id, issues FROM issues")
def k4_text_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns of every pair of texts under protection, and the English left in its target."""
    pairs = spread(fixtures.order_pairs(spark, sf_dir)).withColumnRenamed("target", "translated")
    return issues.text_issues(pairs).select("unit_id", "issues")


def _order_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as units, edits of every 5th (of an outdated source every 25th), confirmations of every 4th."""
    k, terms = F.col("unit_id"), F.array(F.struct(F.lit("customer").alias("source"), F.lit("客户").alias("target")))
    pairs = spread(fixtures.order_pairs(spark, sf_dir)).withColumnRenamed("target", "translated")
    units = pairs.withColumns(
        {
            "kind": F.when(k % 10 == 0, "reference").otherwise("text"),
            "source_hash": F.sha2(F.col("source").cast("binary"), 256),
            "issues": F.when(k % 6 == 0, F.array(F.lit("表格结构不能可靠对应"), F.lit("旧"))).otherwise(F.array().cast("array<string>")),
            "terms": F.when(k % 3 == 0, terms).otherwise(F.array().cast(issues.TERMS)),
        }
    )
    last = F.struct(F.concat(F.lit("第 "), k, F.lit(" 号")).alias("text"), F.from_json(F.lit("[]"), issues.TERMS).alias("terms"))
    stale = F.when(k % 25 == 0, F.lit("old")).otherwise(F.col("source_hash"))
    edits = units.filter("unit_id % 5 = 0").select("unit_id", stale.alias("source_hash"), F.array(last).alias("history"))
    listed = F.when(F.col("kind") == "reference", F.col("issues"))
    confirmed = units.filter("unit_id % 4 = 0 and unit_id % 5 <> 0 and kind = 'reference' or unit_id % 20 = 0")
    keys = confirmed.select("unit_id", "source", "translated", listed.alias("issues"), "terms", "kind")
    edited = F.when((k % 5 == 0) & (k % 25 != 0), F.concat(F.lit("第 "), k, F.lit(" 号"))).otherwise(F.col("translated"))
    key = issues.confirmation_key(F.col("source"), edited, F.coalesce("issues", F.array().cast("array<string>")), F.col("terms"))
    return units, edits, keys.select("unit_id", key.alias("key"))


@query()
def k6_active_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open issues of every unit: its effective text checked again, terms compared, confirmations applied."""
    return issues.active_issues(*_order_units(spark, sf_dir)).select("unit_id", "effective", "active")


@query(
    """
SELECT o_orderkey AS unit_id, CASE o_orderkey % 8 WHEN 0 THEN 'read-only' WHEN 1 THEN 'protected fragments' WHEN 2 THEN 'protected fragments' WHEN 3 THEN 'heading levels'
  WHEN 4 THEN 'one block' WHEN 5 THEN 'one block' WHEN 6 THEN 'structure' END AS refusal,
  CASE WHEN o_orderkey % 8 = 7 THEN ['数字可能发生变化'] ELSE [] END AS concerns FROM orders"""
)
def k7_edit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of edit that may not be made, and one whose number differs."""
    k = F.col("o_orderkey")
    source = F.when(k % 8 == 5, F.concat(F.lit("Cell "), k)).otherwise(F.concat(F.lit("See [3] and order "), k))
    text = (
        F.when(k % 8 == 1, F.concat(F.lit("见 [4] 和订单 "), k))
        .when(k % 8 == 2, F.concat(F.lit("见 [3] 和订单 ![x](a.png) "), k))
        .when(k % 8 == 3, F.concat(F.lit("# 见 [3] 和订单 "), k))
        .when(k % 8 == 4, F.concat(F.lit("见 [3] 和订单\n\n"), k))
        .when(k % 8 == 5, F.concat(F.lit("单元 "), k, F.lit("</td>")))
        .when(k % 8 == 6, F.lit("[[[TP_x [3]"))
        .otherwise(F.concat(F.lit("见 [3] 和订单 "), k + 1))
    )
    kind = F.when(k % 8 == 0, "formula").when(k % 8 == 5, "cell").otherwise("text")
    edits = spread(read_table(spark, sf_dir, "orders")).select(k.alias("unit_id"), kind.alias("kind"), source.alias("source"), text.alias("text"))
    return issues.guarded_edits(edits).select("unit_id", "refusal", "concerns")


@query(
    """
SELECT p_partkey AS cell_id, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS attempt,
       CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 1 END AS score FROM part"""
)
def k9_accepted_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction of a cell counts only if it is valid and strictly better than the first answer."""
    k = F.col("p_partkey")
    better, same = F.concat(F.lit("零件 "), k), F.concat(F.lit("零件 Assembly "), k)
    tries = F.array(
        F.struct(F.lit(0).alias("attempt"), F.when(k % 4 == 0, better).otherwise(same).alias("text"), (k % 4 != 3).alias("valid")),
        F.struct(F.lit(1).alias("attempt"), F.when(k % 4 == 2, same).otherwise(better).alias("text"), (k % 4 != 3).alias("valid")),
        F.struct(F.lit(2).alias("attempt"), same.alias("text"), F.lit(True).alias("valid")),
    )
    rows = spread(read_table(spark, sf_dir, "part")).select(k.alias("cell_id"), F.col("p_name").alias("source"), F.explode(tries).alias("t")).select("cell_id", "source", "t.*")
    return issues.accepted(issues.cell_scores(rows)).select("cell_id", "attempt", "score")


@query()
def g12_table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in the cells of each table: a table for every supplier, a cell for every part of the nation's first."""
    part = read_table(spark, sf_dir, "part")
    text = F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" $x_1$ <sup>2</sup>")).otherwise(F.lit("")))
    cells = part.select((F.col("p_partkey") % 100).alias("table_id"), "p_partkey", text.alias("text"))
    return issues.table_quality(cells, "table_id", ["p_partkey"], "text")


@query(
    twins.with_(twins.BLOCKS)
    + r"""
SELECT doc_id, sha256(regexp_replace(string_agg(CASE kind WHEN 'table' THEN regexp_replace(text, '<td>(\d+)</td>', '<td>第 \1 格</td>') ELSE text END, chr(10) || chr(10) ORDER BY pos),
       '^\s+|\s+$', '', 'g') || chr(10)) AS h FROM blocks GROUP BY doc_id"""
)
def b3_rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together from the effective texts of their units and table cells."""
    blocks = fixtures.blocks(spark, sf_dir)
    units = blocks.select("doc_id", F.expr("pos div 10").alias("segment"), "pos", F.struct("doc_id", "pos").alias("unit_id"), F.col("text").alias("effective"))
    number = F.regexp_extract("text", r"<td>(\d+)</td>", 1)
    cells = blocks.filter("kind = 'table'").select(F.struct("doc_id", "pos").alias("unit_id"), F.lit(0).alias("cell_pos"), F.concat(F.lit("第 "), number, F.lit(" 格")).alias("effective"))
    return issues.rendered(units, cells).select("doc_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("h"))


@query(
    twins.with_(twins.UNITS)
    + """,
i AS (SELECT parent_id AS task, count(*) AS n FROM units WHERE len(issues) > 0 GROUP BY 1)
SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'partial_failed' WHEN coalesce(n, 0) > 0 THEN 'needs_review' ELSE 'completed' END AS status,
       CAST(coalesce(n, 0) AS INTEGER) AS n_issues, CAST(coalesce(n, 0) AS INTEGER) AS cards, CAST(coalesce(n, 0) AS INTEGER) AS json_rows
FROM orders LEFT JOIN i ON task = o_orderkey"""
)
def b6_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of every task: status, and its issues as HTML, Markdown and JSON."""
    rows = issues.report_rows(fixtures.units(spark, sf_dir).withColumnsRenamed({"parent_id": "task", "issues": "active"}))
    orders = read_table(spark, sf_dir, "orders")
    failures = orders.select(F.col("o_orderkey").alias("task"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)).alias("failed"))
    usage = orders.select(F.col("o_orderkey").alias("task"), F.lit(1).alias("requests"), F.lit(2).alias("tokens"))
    made = issues.reports(rows, failures, usage)
    cards = F.regexp_count("html", F.lit("<tr id=")).alias("cards")
    json_rows = F.size(F.from_json("json", "array<struct<unit_id: string>>")).alias("json_rows")
    return made.select("task", "status", "n_issues", cards, json_rows)


@query(
    """
SELECT o_orderkey AS omission_id, o_orderkey % 50 AS insert_before, 'source ' || o_orderkey AS source, 'chapter ' || (o_orderkey % 50) AS chapter, CAST(o_orderkey % 7 AS BIGINT) AS segment
FROM orders WHERE o_orderkey % 100 < 50 AND o_orderkey % 50 % 7 = o_orderkey % 7"""
)
def p3_omission_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omissions with an anchor as editable units."""
    k = F.col("o_orderkey")
    orders = read_table(spark, sf_dir, "orders")
    anchor = F.when(k % 100 < 50, F.concat_ws(":", k % 50, k % 7))
    omissions = orders.select(k.alias("omission_id"), anchor.alias("insert_before"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("source "), k).alias("source"))
    units = spark.range(50).select(F.concat_ws(":", "id", F.col("id") % 7).alias("unit_id"), F.concat(F.lit("chapter "), F.col("id")).alias("chapter"), (F.col("id") % 7).alias("segment"))
    made = issues.omission_units(omissions, units)
    return made.select("omission_id", F.substring_index("insert_before", ":", 1).cast("long").alias("insert_before"), "source", "chapter", "segment")


@query(
    """
SELECT o_orderkey AS omission_id, CASE WHEN o_orderkey % 3 = 0 THEN '已有 ' || o_orderkey ELSE '译 ' || o_orderkey END AS translated FROM orders
WHERE o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0)"""
)
def l8_adopted_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for omissions adopted once; a refused or repeated one changes nothing."""
    k = F.col("o_orderkey")
    orders = spread(read_table(spark, sf_dir, "orders"))
    units = orders.select(k.alias("omission_id"), F.lit(1).alias("insert_before"), F.lit("text").alias("kind"), F.concat(F.lit("source "), k).alias("source"), F.lit("c").alias("chapter"), F.lit(1).alias("segment"))
    known = units.filter("omission_id % 3 = 0").withColumn("translated", F.concat(F.lit("已有 "), "omission_id"))
    text = F.when(F.col("omission_id") % 5 == 0, F.concat(F.lit("译\n\n"), "omission_id")).otherwise(F.concat(F.lit("译 "), "omission_id"))
    proposals = units.filter("omission_id % 2 = 0").select("omission_id", text.alias("text"))
    recovered = known.select("omission_id", "insert_before", "kind", "source", "translated", "chapter", "segment")
    once = issues.adopted(recovered, proposals, units)
    return issues.adopted(once, proposals, units).select("omission_id", "translated")


def marked_stub(texts: list[str]) -> list[str]:
    """A deterministic translator of protected segments: a sign before each block's text, after heading marks."""
    block = re.compile(r"(\[\[\[TP_BEGIN_\d+\]\]\]\n)(#{1,6}\s+)?([\s\S]*?)(?=\n\[\[\[TP_END)")
    return [block.sub(lambda m: f"{m[1]}{m[2] or ''}译：{m[3]}", t) for t in texts]


@query(
    twins.with_(twins.ORDER_PAIRS)
    + "SELECT unit_id, '# 译：Order ' || k || chr(10) || chr(10) || '译：' || source AS translated, true AS ok, 2 AS n_pairs FROM order_pairs JOIN order_base USING (unit_id)"
)
def l1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a heading and a paragraph through the translator, block by block."""
    pairs = spread(fixtures.order_pairs(spark, sf_dir))
    segment = F.concat(F.lit("# Order "), "unit_id", F.lit("\n\n"), "source")
    done = remote.translate_segments(pairs.select("unit_id", segment.alias("text")), "unit_id", "text", marked_stub)
    return done.select("unit_id", "translated", "ok", F.size("pairs").alias("n_pairs"))


@query(
    twins.with_(twins.ORDER_PAIRS)
    + "SELECT unit_id, CASE WHEN unit_id % 3 = 0 THEN source ELSE '译：' || source END AS translated, unit_id % 3 <> 0 AS ok FROM order_pairs"
)
def l9_recovered_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments from the cache alone: segments that it doesn't hold are misses, and nothing is asked for."""
    pairs = spread(fixtures.order_pairs(spark, sf_dir)).select("unit_id", F.col("source").alias("text"))
    former = pairs.filter("unit_id % 3 <> 0")
    cache = remote.translate_segments(former, "unit_id", "text", marked_stub).join(former, "unit_id")
    cache = cache.select(remote.segment_key(F.col("text")).alias("key"), "protected")
    return remote.translate_segments(pairs, "unit_id", "text", None, cache).select("unit_id", "translated", "ok")


@query(
    """
SELECT p_partkey, chr(10) || '<table><tr><td>译:' || p_name || '</td><td>' || p_size || '</td></tr></table>' || chr(10) AS text, 2::BIGINT AS cells, 1::BIGINT AS changed, 0::BIGINT AS failures
FROM part"""
)
def l5_tables_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of texts with translated cells, every distinct cell asked for once."""
    html = F.concat(F.lit("<table><tr><td>"), "p_name", F.lit("</td><td>"), "p_size", F.lit("</td></tr></table>"))
    texts = spread(read_table(spark, sf_dir, "part")).select("p_partkey", html.alias("text"))
    return remote.translate_tables(texts, "p_partkey", "text")


@query(
    """
SELECT o_orderkey AS unit_id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN '译：Order ' || o_orderkey END AS text, o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AS ok,
       CASE WHEN o_custkey % 2 = 1 THEN 'other service or model' WHEN o_orderkey % 3 = 0 THEN 'read-only' END AS reason FROM orders"""
)
def l7_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for single units, by the original task's service and model only."""
    k = F.col("o_orderkey")
    orders = spread(read_table(spark, sf_dir, "orders"))
    asked = orders.select(F.col("o_custkey").alias("task"), k.alias("unit_id"), F.when(k % 3 == 0, "code").otherwise("text").alias("kind"), F.concat(F.lit("Order "), k).alias("source"))
    tasks = orders.select(F.col("o_custkey").alias("task")).distinct()
    config = tasks.select("task", F.lit("p").alias("provider"), F.when(F.col("task") % 2 == 0, "m").otherwise("n").alias("model"))
    return remote.candidates(asked, config, "p", "m", marked_stub)


@query(
    """
SELECT p_partkey % 100 AS book, lower(p_name) AS term, '译' || lower(p_name) AS target FROM part WHERE length(p_name) > 0 GROUP BY ALL"""
)
def l6_term_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a service proposes for a book's candidates; one that it invents is left out."""
    parts = read_table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("book"), F.lower("p_name").alias("term"))
    offered = parts.groupBy("book", "term").agg(F.count("*").alias("rank"))
    contexts = parts.distinct().select("book", F.xxhash64("term").alias("pos"), F.col("term").alias("snippet"))
    propose = lambda terms, _: [(t.upper(), f"译{t}") for t in terms] + [("invented", "假")]
    return remote.suggestions(offered, contexts, "book", propose)


@query(
    twins.with_(twins.CELLS)
    + """
SELECT table_id, -1 AS cell_pos, 'table' AS kind, 'table ' || table_id AS text FROM (SELECT DISTINCT table_id FROM cells)
UNION ALL SELECT table_id, CAST((row_no - 1) * 4 + col_no AS INTEGER), 'cell', text FROM cells"""
)
def d26_all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and their cells as one stream in order."""
    cells = fixtures.cells(spark, sf_dir)
    units = cells.select("table_id").distinct().select("table_id", F.lit("table").alias("kind"), F.concat(F.lit("table "), "table_id").alias("text"))
    place = ((F.col("row_no") - 1) * 4 + F.col("col_no")).cast("int")
    return issues.all_units(units, cells.select("table_id", F.lit("cell").alias("kind"), "text", place.alias("cell_pos"))).select("table_id", "cell_pos", "kind", "text")


@query(
    twins.with_(twins.BLOCKS)
    + "SELECT kind, count(*) AS n, count_if(kind IN ('heading', 'text', 'caption')) AS prose, count_if(kind <> 'table') AS editable FROM blocks GROUP BY kind"
)
def e3_e10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that give context, and blocks that a reviewer may edit."""
    from ..functions.visible import PROSE

    prose = F.count_if(F.col("kind").isin(*PROSE)).alias("prose")
    return fixtures.blocks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), prose, F.count_if(issues.editable(F.col("kind"))).alias("editable"))


@query(
    """
SELECT o_orderkey AS key, '译 ' || o_orderkey AS translated FROM orders WHERE o_orderkey % 5 NOT IN (1, 2, 3)"""
)
def b11_n5_cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the request cache that hold: not of an older version, not damaged, never empty."""
    k = F.col("key")
    answers = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    answers = answers.withColumn("text", F.when(k % 5 == 1, " ").otherwise(F.concat(F.lit("译 "), k)))
    damaged = F.when(k % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = remote.cache_entries(answers).withColumns({"text": damaged, "version": F.when(k % 5 == 3, 1).otherwise(F.col("version"))})
    return remote.sound_entries(kept)


@query(
    twins.with_(twins.ORDER_PAIRS)
    + "SELECT unit_id, sha256('译：' || source) AS output_hash FROM order_pairs"
)
def b12_segment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every segment's result, as kept in a job's state."""
    pairs = spread(fixtures.order_pairs(spark, sf_dir)).select("unit_id", F.col("source").alias("text"))
    return remote.segment_results(remote.translate_segments(pairs, "unit_id", "text", marked_stub), "unit_id").select("unit_id", "output_hash")


@query(
    twins.with_(twins.LINES)
    + "SELECT doc_id, pos, printf('b%06d', pos) AS block_id, printf('s%05d', pos // 3) AS segment_id, sha256(line) AS h FROM lines"
)
def h5_c6_unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of blocks and segments; the text of formulas is left as it is."""
    lines = fixtures.lines(spark, sf_dir)
    ids = [T.unit_id("b", F.col("pos"), 6).alias("block_id"), T.unit_id("s", F.expr("pos div 3"), 5).alias("segment_id")]
    return lines.select("doc_id", "pos", *ids, F.sha2(T.clean_latex(F.col("line")).cast("binary"), 256).alias("h"))


@query(
    twins.with_(twins.GLOSSARY)
    + """
SELECT layer, source, row_number() OVER (PARTITION BY layer ORDER BY lower(source)) AS place FROM glossary"""
)
def i2_glossary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each layer in the order of their keys."""
    entries = fixtures.glossary(spark, sf_dir).withColumn("key", T.term_key(F.col("source")))
    return review.numbered_within(entries, "layer", ["key"]).select("layer", "source", "place")


@query(
    """
SELECT page_id, page, row_number() OVER (PARTITION BY page_id // 200 ORDER BY page, y, page_id) AS place
FROM (SELECT page_id, CAST(page_id % 20 + 1 AS INTEGER) AS page, page_id * 37 % 700 AS y FROM pages)"""
)
def i5_recovered_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered units of each book by page and height."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 200").alias("book"), (F.col("page_id") % 20 + 1).cast("int").alias("page"), (F.col("page_id") * 37 % 700).alias("y"))
    return review.numbered_within(pages, "book", ["page", "y", "page_id"]).select("page_id", "page", "place")
