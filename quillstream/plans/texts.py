"""Operators in Python over whole tables: blocks, tables, protection, formulas, leftovers, terms, remote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens
from ..operators import parts as P
from ..operators import remote, terms, texts
from ..sources import fixtures
from ..sources.tables import read_table, spread
from . import twins
from .registry import query


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: every document as Markdown with headings, a reference section and an appendix."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    text = F.concat(
        F.lit("# Document "), "doc_id", F.lit("\n\n"), body, F.lit("\n\n## References\n\n[1] "), F.substring("text", 1, 40), F.lit("\n\n## Appendix\n\nEnd of "), "source"
    )
    return docs.select("doc_id", text.alias("text"))


@query(
    twins.with_(twins.LINES)
    + """,
kept AS (SELECT doc_id, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) + 4 AS blocks, 2 AS headings, 1 AS refs FROM documents LEFT JOIN kept USING (doc_id)"""
)
def d1_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks, headings and reference sections every document has as Markdown."""
    found = texts.markdown_blocks(_books(spark, sf_dir))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").cast("int").alias("headings"), F.count_if(F.col("kind") == "reference").cast("int").alias("refs")
    )


@query("SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), ' +', ' ', 'g')) AS words FROM documents")
def d3_split_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces keep all words in order."""
    pieces = texts.prose_pieces(spread(read_table(spark, sf_dir, "documents")), 600)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ")
    words = F.sha2(F.trim(F.regexp_replace(ordered, r"[\s]+", " ")).cast("binary"), 256)
    return pieces.groupBy("doc_id").agg(words.alias("words"))


HTML_TABLES = """
'<table class="t"><tr><th rowspan="2">Item ' || l_orderkey || '</th><th colspan="2">Price</th></tr><tr><td>net<sup>1</sup></td><td>tax</td></tr><tr><td>' || l_partkey
|| '</td><td>' || l_linenumber || '</td><td>' || l_returnflag || '<br/>&lt;' || l_linestatus || '</td></tr></table>'
"""


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spread(read_table(spark, sf_dir, "lineitem"))
    return items.select(F.xxhash64(*items.columns).alias("row_id"), F.expr(HTML_TABLES).alias("html"))


@query(
    f"""
WITH h AS (SELECT {HTML_TABLES} AS html, l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem),
c AS (
  SELECT 1 AS row_no, 1 AS col_no, 'Item ' || l_orderkey AS cell_text, '' AS headers, '' AS row_header FROM h
  UNION ALL SELECT 1, 2, 'Price', '', 'Item ' || l_orderkey FROM h
  UNION ALL SELECT 2, 2, 'net<sup>1</sup>', 'Price', 'Item ' || l_orderkey FROM h
  UNION ALL SELECT 2, 3, 'tax', 'Price', 'Item ' || l_orderkey FROM h
  UNION ALL SELECT 3, 1, CAST(l_partkey AS VARCHAR), 'Item ' || l_orderkey, '' FROM h
  UNION ALL SELECT 3, 2, CAST(l_linenumber AS VARCHAR), 'Price', CAST(l_partkey AS VARCHAR) FROM h
  UNION ALL SELECT 3, 3, l_returnflag || chr(10) || '<' || l_linestatus, 'Price', CAST(l_partkey AS VARCHAR) FROM h)
SELECT row_no, col_no, cell_text, headers, row_header, count(*) AS n FROM c GROUP BY ALL"""
)
def d5_d8_d9_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables with spans: their places, texts, spanning headers and row labels."""
    cells = texts.table_cells(_html(spark, sf_dir), "row_id", "html")
    flat = cells.select("row_no", "col_no", "cell_text", F.array_join("column_headers", " / ").alias("headers"), "row_header")
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))


FORMULA = """concat('Force $F = m a$ of ', p_name, ' [', p_partkey, '] is $', p_size, ' . 5 ^ {{ \\\\circ }}$ <sup>', p_size, '</sup> ![i](a.png)')"""


@query()
def d14_d15_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(read_table(spark, sf_dir, "part")).select("p_partkey", F.expr(FORMULA.replace("{{", "{").replace("}}", "}")).alias("text"))
    return texts.protected(part, "p_partkey", "text").select("p_partkey", "protected", F.size("marks").cast("long").alias("marks"))


@query("SELECT p_partkey, 'angle ' || p_size || '.5°, V̇O₂max ≥ ' || p_partkey || ' a/b' AS readable FROM part")
def c15_c16_readable_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("angle $"), "p_size", F.lit(" . 5 ^ { \\circ }$, $\\dot { V } \\mathrm { O } _ { 2 \\operatorname* { m a x } } \\geq "), "p_partkey", F.lit("$ $\\frac{a}{b}$")
    )
    return texts.readable(spread(read_table(spark, sf_dir, "part")).select("p_partkey", text.alias("text")), "p_partkey", "text")


@query(
    """
SELECT p_partkey, pos, CASE pos WHEN 0 THEN p_name || ' x' WHEN 1 THEN '²' ELSE p_brand END AS run, pos = 2 AS bold, pos = 1 AS superscript FROM part, (SELECT unnest([0, 1, 2]) AS pos)"""
)
def c18_styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" x<sup>2</sup><b>"), "p_brand", F.lit("</b>"))
    runs = texts.styled_runs(spread(read_table(spark, sf_dir, "part")).select("p_partkey", text.alias("text")), "p_partkey", "text")
    return runs.select("p_partkey", "pos", "run", "bold", "superscript")


@query()
def d18_leftover_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.english_left(spread(read_table(spark, sf_dir, "documents")), "doc_id", "text")


@query()
def d19_leftover_english_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.english_left(read_table(spark, sf_dir, "conversations").withColumn("cell", F.concat_ws(":", "conv_id", "turn")), "cell", "text", cells=True)


@query("SELECT p_partkey, unnest([0, 1]) AS pos, unnest(['\\frac', 'mathrm']) AS command FROM part")
def d20_latex_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" \\frac{a}{b} \\FRAC mathrm"))
    return texts.latex_left(spread(read_table(spark, sf_dir, "part")).select("p_partkey", text.alias("text")), "p_partkey", "text")


@query()
def d22_audit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.audit_terms(spread(read_table(spark, sf_dir, "documents")), "doc_id", "text")


STOP_LIST = ", ".join(f"'{w}'" for w in terms.STOP)


@query(
    f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z \\t-]', chr(10), 'g'), '(^|[^A-Za-z])-+', '\\1' || chr(10), 'g'), '-+([^A-Za-z]|$)', chr(10) || '\\1', 'g'), chr(10)) AS s FROM documents),
runs AS (SELECT doc_id, run, s[run] AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS run FROM cut)),
toks AS (SELECT doc_id, run, regexp_extract_all(t, '[A-Za-z]+(?:-[A-Za-z]+)*') AS w FROM runs),
words AS (SELECT doc_id, run, pos, w[pos] AS w, lower(w[pos]) IN ({STOP_LIST}) AS stop FROM (SELECT doc_id, run, w, unnest(range(1, len(w) + 1)) AS pos FROM toks)),
islands AS (SELECT *, count(*) FILTER (WHERE stop) OVER (PARTITION BY doc_id, run ORDER BY pos) AS island FROM words),
kept AS (SELECT * FROM islands WHERE NOT stop),
ahead AS (SELECT doc_id, run, pos, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM kept WINDOW x AS (PARTITION BY doc_id, run, island ORDER BY pos)),
grams AS (
  SELECT doc_id, run, pos, 1 AS words, w AS term FROM ahead UNION ALL SELECT doc_id, run, pos, 2, w || ' ' || w2 FROM ahead
  UNION ALL SELECT doc_id, run, pos, 3, w || ' ' || w2 || ' ' || w3 FROM ahead UNION ALL SELECT doc_id, run, pos, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead),
counted AS (SELECT doc_id, lower(term) AS k, count(*) AS n, max(words) AS words, arg_min(term, (run, pos)) AS term FROM grams
            WHERE term IS NOT NULL AND NOT (words = 1 AND length(term) < 4 AND upper(term) <> term) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n > 1 DESC, words > 1 DESC, n DESC, words DESC, k) AS rank FROM counted)
SELECT doc_id, rank, term, n FROM ranked WHERE rank <= 100"""
)
def d23_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best term candidates of every document."""
    return terms.candidates(spread(read_table(spark, sf_dir, "documents")), "doc_id", "text")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("The "), F.upper("p_name"), F.lit(", "), F.lower("p_type"), F.lit(" of brand; a "), "p_name", F.lit("s and small things"))
    target = F.concat(F.lit("译"), F.col("p_partkey") % 64)
    return spread(read_table(spark, sf_dir, "part")).select("p_partkey", text.alias("text"), target.alias("target"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fixtures.glossary(spark, sf_dir).filter("layer = 'global'").select("source", "target")
    first = names.select(F.substring_index("source", " ", 1).alias("source"), F.lit("短").alias("target")).distinct()
    return names.unionByName(first)


MATCHES_SQL = (
    twins.with_(twins.GLOSSARY)
    + """,
firsts AS (SELECT DISTINCT split_part(source, ' ', 1) AS f FROM glossary WHERE layer = 'global')
SELECT p_partkey, 2 AS pos, 2 AS words, p_name AS source, target FROM part JOIN glossary ON layer = 'global' AND source = p_name
UNION ALL SELECT p_partkey, pos, 1, w, '短' FROM (SELECT p_partkey, 5 AS pos, lower(p_type) AS w FROM part) JOIN firsts ON f = w
UNION ALL SELECT p_partkey, 10, 1, split_part(p_name, ' ', 1), '短' FROM part
UNION ALL SELECT p_partkey, 13, 1, 'small', '短' FROM part WHERE 'small' IN (SELECT f FROM firsts)"""
)


@query(MATCHES_SQL)
def d24_f5_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms in texts: the longest at each place, none inside a longer word."""
    return terms.longest_matches(_catalogue(spark, sf_dir), _terms(spark, sf_dir), "p_partkey", "text")


@query(
    MATCHES_SQL.replace("SELECT p_partkey, 2 AS pos", ", m AS (SELECT p_partkey, 2 AS pos", 1)
    + ") SELECT DISTINCT p_partkey, source AS term, target AS wanted FROM m WHERE NOT contains('译' || (p_partkey % 64), target)"
)
def k5_glossary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.violations(_catalogue(spark, sf_dir), _terms(spark, sf_dir), "p_partkey", "text", "target")


@query(
    """
WITH c AS (SELECT doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) SELECT doc_id FROM c WHERE total <= 12000"""
)
def l6_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippets that fit into a request's budget, in order."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return terms.within_budget(docs, "source", "doc_id", "size", 12_000).select("doc_id")


@query(
    twins.with_(twins.CELLS)
    + """
SELECT table_id, row_no, col_no, CASE WHEN length(trim(text)) >= 2 AND regexp_matches(text, '[A-Za-z]{2,}') THEN '译:' || text ELSE text END AS translated, true AS ok FROM cells"""
)
def l2_f12_cell_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct cell is translated once; every third comes from the cache."""
    cells = fixtures.cells(spark, sf_dir)
    former = cells.filter("table_id % 3 = 0")
    cache = remote.new_cache_rows(former.withColumns({"translated": F.concat(F.lit("译:"), "text"), "ok": F.lit(True)}), "text")
    return remote.translate_texts(cells, "text", cache=cache).select("table_id", "row_no", "col_no", "translated", "ok")


@query(
    """
WITH RECURSIVE b AS (SELECT o_custkey AS book, CAST(max(o_orderkey) % 700 + 1 AS INTEGER) AS pages FROM orders GROUP BY 1),
h AS (SELECT DISTINCT o_custkey AS book, CAST(o_orderkey % 700 + 1 AS INTEGER) AS page, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 1 END AS rank FROM orders),
p AS (
  SELECT book, pages, 0 AS part_no, 0 AS start,
         CASE WHEN pages <= 200 THEN pages ELSE coalesce((SELECT arg_max(page, (rank, -abs(page - 128), page)) FROM h WHERE h.book = b.book AND page >= 64 AND page <= 200), 128) END AS stop
  FROM b
  UNION ALL
  SELECT p.book, p.pages, p.part_no + 1, p.stop,
         CASE WHEN p.pages - p.stop <= 200 THEN p.pages
              ELSE coalesce((SELECT arg_max(page, (rank, -abs(page - p.stop - 128), page)) FROM h WHERE h.book = p.book AND page >= p.stop + 64 AND page <= least(p.stop + 200, p.pages)), p.stop + 128) END
  FROM p WHERE p.stop < p.pages)
SELECT book, part_no, start, stop AS "end" FROM p"""
)
def d27_part_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of books by the best boundaries."""
    rank = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 3).otherwise(1)
    hints = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 700 + 1).cast("int").alias("page"), rank.alias("rank")
    )
    pages = hints.groupBy("book").agg((F.max("key") % 700 + 1).cast("int").alias("pages"))
    return P.plan(hints.join(pages, "book")).select("book", "part_no", "start", "end")


@query(
    """
WITH RECURSIVE p AS (SELECT o_custkey AS book, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders),
f AS (
  SELECT book, page, bytes, CAST(0 AS BIGINT) AS piece, CAST(bytes AS BIGINT) AS size FROM p WHERE page % 8 = 0
  UNION ALL
  SELECT p.book, p.page, p.bytes, CASE WHEN f.size + p.bytes > 300000 THEN f.piece + 1 ELSE f.piece END, CASE WHEN f.size + p.bytes > 300000 THEN p.bytes ELSE f.size + p.bytes END
  FROM f JOIN p ON p.book = f.book AND p.page = f.page + 1 AND p.page % 8 <> 0)
SELECT book, page // 8 AS part_no, piece, min(page) AS start, max(page) + 1 AS "end", CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY 1, 2, 3"""
)
def d27_split_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of eight pages cut where their measured size asks for it."""
    orders = read_table(spark, sf_dir, "orders")
    place = F.expr("row_number() over (partition by o_custkey order by o_orderkey) - 1")
    pages = orders.select(F.col("o_custkey").alias("book"), place.alias("page"), F.floor("o_totalprice").alias("bytes"))
    parts = pages.select("book", F.expr("page div 8").alias("part_no")).distinct()
    parts = parts.withColumns({"start": F.col("part_no") * 8, "end": F.col("part_no") * 8 + 8})
    return P.split_by_size(parts, pages, 300_000)


@query(
    """
SELECT l_orderkey AS part, arg_max(st, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS state, bool_or(st = 'submission_unknown') AS poisoned,
       NOT bool_or(st = 'submission_unknown') AND arg_max(st, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) <> 'done' AS replay
FROM (SELECT *, ['new', 'uploaded', 'running', 'done', 'failed', 'submission_unknown', 'pending'][l_partkey % 7 + 1] AS st FROM lineitem) GROUP BY 1"""
)
def m4_m5_part_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every part; one that may have been submitted is not submitted again."""
    names = F.array(*map(F.lit, ("new", "uploaded", "running", "done", "failed", "submission_unknown", "pending")))
    events = read_table(spark, sf_dir, "lineitem").withColumn("st", F.get(names, (F.col("l_partkey") % 7).cast("int")))
    return P.current_state(events.withColumnRenamed("l_orderkey", "part"), "part", "st", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT conv_id, sum(strlen(text))::BIGINT AS tokens FROM conversations GROUP BY 1")
def c20_tokens_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(estimated_tokens(F.col("text"))).alias("tokens"))
