"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures
from ..sources.tables import read_table
from . import twins
from .registry import query

MESSY = "concat('\ufeff', replace(text, ' ', '  '), '\t', chr(13), chr(10), 'Abstract the end ', chr(10), 'x')"


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.expr(MESSY).alias("text"))


@query(
    f"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(replace({MESSY}, chr(65279), ''), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')) AS h FROM documents"""
)
def c1_normalize_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messy(spark, sf_dir).select("doc_id", F.sha2(T.normalize_source(F.col("text")).cast("binary"), 256).alias("h"))


@query(
    r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace('Abstract' || chr(10) || text || chr(10) || 'ABSTRACT the end', '(?im)^abstract[ \t]*$', '## 摘要', 'g'),
       '(?im)^abstract\s+(.+)$', '## 摘要' || chr(10) || chr(10) || '\1', 'g')) AS h FROM documents"""
)
def c2_abstract_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Abstract\n"), "text", F.lit("\nABSTRACT the end"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_abstract_heading(text).cast("binary"), 256).alias("h"))


@query(
    r"""
WITH t AS (SELECT doc_id, left(regexp_replace(trim(regexp_replace(trim(string_split(text, chr(10))[1]), '\$[^$]+\$', '', 'g')), '[\\{}<>:"/|?*]', '', 'g'), 60) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'translated' ELSE t END AS title FROM t"""
)
def c3_extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("intro\n# "), "text")
    return read_table(spark, sf_dir, "documents").select("doc_id", T.extract_title(text).alias("title"))


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS inner_text FROM documents")
def c5_unwrap_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))
    return read_table(spark, sf_dir, "documents").select("doc_id", T.unwrap_fence(fenced).alias("inner_text"))


@query(twins.with_(twins.LINES) + "SELECT doc_id, pos, trim(regexp_replace(replace(line, chr(160), ' '), '\\s+', ' ', 'g')) AS line FROM lines")
def c7_normalize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.lines(spark, sf_dir).select("doc_id", "pos", T.normalize_line(F.col("line")).alias("line"))


@query(
    r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g'),
  '(?m)^#{1,6}\s+', '', 'g'), '[\s\x{00a0}]+', '', 'g')) AS key FROM pages"""
)
def c8_location_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.sha2(T.location_key(F.col("html")).cast("binary"), 256).alias("key"))


@query(
    r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '[ \t\r\f\v]+', ' ', 'g'), '\n\s*', chr(10), 'g'))) AS cell FROM pages"
)
def c9_normalize_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", F.sha2(T.normalize_cell(F.col("html")).cast("binary"), 256).alias("cell"))


@query(twins.with_(twins.GLOSSARY) + "SELECT layer, source, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS key FROM glossary")
def c10_term_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.glossary(spark, sf_dir).select("layer", "source", T.term_key(F.col("source")).alias("key"))


@query(
    r"SELECT page_id, sha256(trim(regexp_replace('[[[TP_MATH_0001]]] ' || html || ' ' || url, '\[\[\[TP_[A-Z]+_\d+\]\]\]|https?://\S+|<[^>]+>', ' ', 'g'))) AS plain FROM pages"
)
def c12_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("[[[TP_MATH_0001]]] "), "html", F.lit(" "), "url")
    return read_table(spark, sf_dir, "pages").select("page_id", F.sha2(T.plain(text).cast("binary"), 256).alias("plain"))


@query(
    f"SELECT p_partkey, translate(p_name, '{T.RAISED_FROM}', '{T.RAISED_TO}') AS raised, translate(p_name, '{T.LOWERED_FROM}', '{T.LOWERED_TO}') AS lowered FROM part"
)
def c13_script_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read_table(spark, sf_dir, "part").select("p_partkey", T.raised(name).alias("raised"), T.lowered(name).alias("lowered"))


@query("SELECT p_partkey, p_name AS inner_text FROM part")
def c14_strip_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    wrapped = (
        F.when(k == 0, F.concat(F.lit("$$ "), "p_name", F.lit(" $$")))
        .when(k == 1, F.concat(F.lit(" $"), "p_name", F.lit("$")))
        .when(k == 2, F.concat(F.lit("\\["), "p_name", F.lit("\\]")))
        .otherwise(F.concat(F.lit("\\( "), "p_name", F.lit("\\)")))
    )
    return read_table(spark, sf_dir, "part").select("p_partkey", T.strip_math(wrapped).alias("inner_text"))


@query(
    """
SELECT p_partkey, sha256('["' || p_name || '","' || p_brand || '"]') AS fp, substr(sha256(p_name), 1, 16) AS short FROM part"""
)
def c19_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 16)
    return read_table(spark, sf_dir, "part").select("p_partkey", T.fingerprint(F.col("p_name"), F.col("p_brand")).alias("fp"), short.alias("short"))


@query("SELECT doc_id, strlen(text) AS tokens, greatest(4096, 32768 - strlen(text)) AS budget FROM documents")
def c20_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.estimated_tokens(F.col("text")).cast("long")
    return read_table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), F.greatest(F.lit(4096), 32768 - tokens).alias("budget"))


@query(twins.with_(twins.CELLS) + "SELECT table_id, row_no, col_no, length(trim(text)) >= 2 AND regexp_matches(text, '[A-Za-z]{2,}') AS needed FROM cells")
def c21_needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).select("table_id", "row_no", "col_no", T.needs_translation(F.col("text")).alias("needed"))


@query("SELECT event_id, '[' || props || ']' AS answer FROM events")
def c22_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Here it is: ["), "props", F.lit("] as asked"))
    return read_table(spark, sf_dir, "events").select("event_id", T.json_array(answer).alias("answer"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def c23_first_json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", T.first_json_value(F.col("props"), "missing", "data.k", "k").alias("value"))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/v1/chat' AS endpoint, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def c24_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("//"))
    return read_table(spark, sf_dir, "pages").select("page_id", T.endpoint(base, "/v1/chat").alias("endpoint"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query(
    r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS clean, left(trim(regexp_replace(text, '[<>:\x22/\\|?*\x00-\x1F]', '_', 'g')), 40) AS stem FROM documents"
)
def c31_c32_safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.sha2(T.strip_control(F.col("text")).cast("binary"), 256)
    return read_table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"), T.safe_stem(F.col("text")).alias("stem"))


LOG = "['Processed ' || event_id || '/9 pages', 'loading model', 'OCR of ' || event_type, 'export ' || event_type, chr(27) || '[31mmarkdown', 'idle']"


@query(
    f"""
WITH l AS (SELECT event_id, {LOG}[event_id % 6 + 1] AS line FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '页面解析' WHEN 1 THEN '加载模型' WHEN 2 THEN '页面解析' WHEN 3 THEN '导出解析结果' WHEN 4 THEN '导出解析结果' END AS stage FROM l"""
)
def c33_progress_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(
        F.concat(F.lit("Processed "), "event_id", F.lit("/9 pages")), F.lit("loading model"), F.concat(F.lit("OCR of "), "event_type"),
        F.concat(F.lit("export "), "event_type"), F.lit("\x1b[31mmarkdown"), F.lit("idle"),
    )
    line = F.get(lines, (F.col("event_id") % 6).cast("int"))
    return read_table(spark, sf_dir, "events").select("event_id", T.progress_stage(line).alias("stage"))


@query(
    twins.with_(twins.CELLS)
    + r""",
n AS (SELECT table_id, col_no, max(least(5.0, greatest(0.9, coalesce(list_max(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+'), lambda w: length(w))), 1) * 0.14 + 0.35))) AS need FROM cells GROUP BY ALL)
SELECT table_id, round(sum(need), 6) AS width, sum(need) > 16.6 OR max(col_no) >= 9 AS landscape FROM n GROUP BY table_id"""
)
def c34_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths that tables ask for, and whether they need a landscape page."""
    cells = fixtures.cells(spark, sf_dir)
    need = cells.groupBy("table_id", "col_no").agg(F.max(T.column_need(F.col("text"), F.lit(1))).alias("need"))
    wide = (F.sum("need") > 16.6) | (F.max("col_no") >= 9)
    return need.groupBy("table_id").agg(F.round(F.sum("need"), 6).alias("width"), wide.alias("landscape"))


@query(
    """
SELECT p_partkey, round(least(1.0, 15.0 / (p_size * 2.54 / 1.8), 20.0 / (p_retailprice / 40)), 6) AS scale FROM part"""
)
def c35_image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale at which an image of that size fits into 15 by 20 cm, never enlarged."""
    scale = F.least(F.lit(1.0), 15.0 / (F.col("p_size") * 2.54 / 1.8), 20.0 / (F.col("p_retailprice") / 40))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.round(scale, 6).alias("scale"))


@query(
    r"""SELECT page_id, list_filter([CASE WHEN regexp_matches(html, '(?i)<\s*/?\s*(sup|sub)\b') THEN 'html_script' END,
  CASE WHEN regexp_matches(html, '\\(?:mathrm|operatorname|frac|dot|text|mathbf|mathit)\b') THEN 'latex_command' END], lambda x: x IS NOT NULL) AS artifacts FROM
  (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<p>x<sup>2</sup>' WHEN 1 THEN '\frac{a}{b}' ELSE left(url, 20) END AS html FROM pages)"""
)
def d21_inline_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    text = F.when(k == 0, F.lit("<p>x<sup>2</sup>")).when(k == 1, F.lit("\\frac{a}{b}")).otherwise(F.substring("url", 1, 20))
    return read_table(spark, sf_dir, "pages").select("page_id", T.inline_artifacts(text).alias("artifacts"))


@query("SELECT page_id, 'Bearer *** for ' || replace(url, 'example', '***') AS line FROM pages")
def b17_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Bearer sk-"), "page_id", F.lit(" for "), "url")
    return read_table(spark, sf_dir, "pages").select("page_id", T.redact(line, ["example", ""]).alias("line"))


@query("SELECT page_id, '![a](_internal/img/' || page_id || '.png) ![b](https://x/y.png)' AS text FROM pages")
def b4_public_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("![a](img/"), "page_id", F.lit(".png) ![b](https://x/y.png)"))
    return read_table(spark, sf_dir, "pages").select("page_id", T.public_links(text).alias("text"))


@query(
    r"""
WITH n AS (SELECT page_id, ['a/', '../', '/', 'C:', ''][page_id % 5 + 1] || 'img' || page_id || '.png' AS name FROM pages)
SELECT page_id, name, NOT (left(name, 1) = '/' OR regexp_matches(name, '^[A-Za-z]:') OR regexp_matches(name, '(^|/)\.\.(/|$)')) AS safe FROM n"""
)
def k10_a21_member_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May an archive member of this name be extracted?"""
    prefix = F.element_at(F.array(*map(F.lit, ("a/", "../", "/", "C:", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(prefix, F.lit("img"), "page_id", F.lit(".png"))
    unsafe = F.col("name").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    return read_table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("safe", ~unsafe)


@query(
    """SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) = 'blog.ththan.example.net' AND url LIKE 'https:%' AS same_origin FROM pages"""
)
def e12_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials go only to the configured service."""
    part = lambda name: F.try_parse_url("url", F.lit(name))
    same = (part("PROTOCOL") == "https") & (part("HOST") == "blog.ththan.example.net")
    return read_table(spark, sf_dir, "pages").select("page_id", same.alias("same_origin"))


@query(
    """
SELECT book, count(*) AS parts, max(end_page) > 60 OR max(end_page) * 1000000 > 40000000 AS partitioned FROM ("""
    + twins.with_(twins.PARTS)
    + """ SELECT * FROM parts) GROUP BY book"""
)
def e8_needs_partitioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a book beyond the limits of pages or bytes for one parse?"""
    pages = F.max("end_page")
    return fixtures.parts(spark, sf_dir).groupBy("book").agg(F.count("*").alias("parts"), ((pages > 60) | (pages * 1_000_000 > 40_000_000)).alias("partitioned"))


@query("SELECT l_orderkey AS result, bool_and(l_linestatus = CASE WHEN l_partkey % 97 = 0 THEN 'X' ELSE l_linestatus END) AS valid FROM lineitem GROUP BY 1")
def e7_result_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result holds while every recorded digest is the current one."""
    items = read_table(spark, sf_dir, "lineitem")
    current = F.xxhash64("l_linestatus")
    recorded = F.when(F.col("l_partkey") % 97 == 0, F.xxhash64(F.lit("X"))).otherwise(current)
    return items.groupBy(F.col("l_orderkey").alias("result")).agg(F.bool_and(current == recorded).alias("valid"))


@query(
    twins.with_(twins.BLOCKS)
    + r"""
SELECT doc_id, pos, CASE WHEN regexp_matches(trim(text), '(?i)^<table\b') THEN 'table' WHEN regexp_matches(trim(text), '^!\[') THEN 'image'
  WHEN regexp_matches(trim(text), '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(trim(text), '(?i)^(fig(ure)?\.?|table|图|表)\s*\d+') THEN 'caption'
  WHEN regexp_matches(trim(text), '^\d+[.)]\s') THEN 'numbered' ELSE 'body' END AS style FROM blocks"""
)
def p8_paragraph_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim("text")
    style = (
        F.when(t.rlike(r"(?i)^<table\b"), "table")
        .when(t.rlike(r"^!\["), "image")
        .when(t.rlike(r"^#{1,6}\s"), "heading")
        .when(t.rlike(r"(?i)^(fig(ure)?\.?|table|图|表)\s*\d+"), "caption")
        .when(t.rlike(r"^\d+[.)]\s"), "numbered")
        .otherwise("body")
    )
    return fixtures.blocks(spark, sf_dir).select("doc_id", "pos", style.alias("style"))


@query(
    """
SELECT o_custkey AS batch, string_agg('第 ' || o_orderkey || ' 段等待 ' || (o_orderkey % 60) || ' 秒', '；' ORDER BY o_orderkey) AS waiting FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"""
)
def p15_waiting_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    item = F.struct(key.alias("k"), F.concat(F.lit("第 "), key, F.lit(" 段等待 "), key % 60, F.lit(" 秒")).alias("t"))
    waiting = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "；")
    return waiting.groupBy(F.col("o_custkey").alias("batch")).agg(line.alias("waiting"))
