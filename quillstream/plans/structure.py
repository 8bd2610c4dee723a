"""Structure of documents: references, headings, segments, batches, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..sources import fixtures
from ..sources.tables import read_table
from . import twins
from .registry import query

IN_REFERENCE = (
    twins.with_(twins.BLOCKS)
    + """,
opened AS (SELECT *, last_value(CASE WHEN kind = 'heading' AND regexp_matches(text, '^#+ References$') THEN pos END IGNORE NULLS) OVER
                  (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ref_pos FROM blocks),
refs AS (
  SELECT b.doc_id, b.pos, b.kind, b.level, b.text,
         o.pos IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blocks h WHERE h.doc_id = b.doc_id AND h.kind = 'heading' AND h.pos > o.pos AND h.pos <= b.pos AND h.level <= o.level) AS in_reference
  FROM opened b LEFT JOIN blocks o ON o.doc_id = b.doc_id AND o.pos = b.ref_pos)
"""
)


@query(IN_REFERENCE + "SELECT doc_id, pos, in_reference FROM refs")
def d2_reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reference_ranges(fixtures.blocks(spark, sf_dir)).select("doc_id", "pos", "in_reference")


@query(
    IN_REFERENCE
    + """
SELECT doc_id, in_reference AS reference, count(*) AS blocks, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM refs GROUP BY doc_id, in_reference"""
)
def d12_body_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = windows.reference_ranges(fixtures.blocks(spark, sf_dir))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n")
    return split.groupBy("doc_id", F.col("in_reference").alias("reference")).agg(F.count("*").alias("blocks"), text.alias("text"))


HEADINGS = twins.with_(twins.BLOCKS) + ", h AS (SELECT doc_id, pos, level, regexp_replace(text, '^#+ ', '') AS t FROM blocks WHERE kind = 'heading')"


@query(
    HEADINGS
    + """,
open AS (SELECT b.doc_id, b.pos, h.pos AS hp, h.t FROM blocks b JOIN h ON h.doc_id = b.doc_id AND h.pos <= b.pos
         WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = b.doc_id AND g.pos > h.pos AND g.pos <= b.pos AND g.level <= h.level))
SELECT b.doc_id, b.pos, coalesce(string_agg(o.t, ' / ' ORDER BY o.hp), '') AS path FROM blocks b LEFT JOIN open o USING (doc_id, pos) GROUP BY b.doc_id, b.pos"""
)
def d10_heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.heading_paths(fixtures.blocks(spark, sf_dir), depth=3).select("doc_id", "pos", "path")


@query(
    twins.with_(twins.BLOCKS)
    + """
SELECT doc_id, pos, coalesce(last_value(CASE WHEN kind = 'heading' AND level <= 2 THEN text END IGNORE NULLS) OVER
       (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS chapter FROM blocks"""
)
def h2_running_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_chapter(fixtures.blocks(spark, sf_dir), 2).select("doc_id", "pos", "chapter")


@query(
    """
WITH RECURSIVE """
    + twins.BLOCKS
    + """,
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, pos, CASE WHEN kind = 'table' THEN 60 ELSE length(text) END AS cost,
             kind = 'heading' AND level <= 2 AS top, kind = 'table' AS sticky FROM blocks),
f AS (
  SELECT doc_id, k, pos, CAST(cost + 2 AS BIGINT) AS size, CAST(0 AS BIGINT) AS segment, sticky FROM c WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, c.pos,
         CAST(CASE WHEN NOT f.sticky AND (f.size + c.cost > 4000 OR (c.top AND f.size >= 900)) THEN 0 ELSE f.size END + c.cost + 2 AS BIGINT),
         CAST(f.segment + CASE WHEN NOT f.sticky AND (f.size + c.cost > 4000 OR (c.top AND f.size >= 900)) THEN 1 ELSE 0 END AS BIGINT), c.sticky
  FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1)
SELECT doc_id, pos, segment FROM f"""
)
def d4_segment_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.packed(fixtures.blocks(spark, sf_dir), 4_000, 900)


@query(
    """
WITH RECURSIVE """
    + twins.CELLS
    + """,
c AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY row_no, col_no) AS k, row_no, col_no, length(text) AS size FROM cells),
f AS (
  SELECT table_id, k, row_no, col_no, 1 AS n, CAST(size AS BIGINT) AS size, CAST(0 AS BIGINT) AS batch FROM c WHERE k = 1
  UNION ALL
  SELECT c.table_id, c.k, c.row_no, c.col_no,
         CASE WHEN f.n >= 3 OR f.size + c.size > 20 OR f.row_no <> c.row_no THEN 1 ELSE f.n + 1 END,
         CAST(CASE WHEN f.n >= 3 OR f.size + c.size > 20 OR f.row_no <> c.row_no THEN 0 ELSE f.size END + c.size AS BIGINT),
         f.batch + CASE WHEN f.n >= 3 OR f.size + c.size > 20 OR f.row_no <> c.row_no THEN 1 ELSE 0 END
  FROM f JOIN c ON c.table_id = f.table_id AND c.k = f.k + 1)
SELECT table_id, row_no, col_no, batch FROM f"""
)
def h11_cell_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cell_batches(fixtures.cells(spark, sf_dir), 3, 20)


REFERENCE_LINES = """CASE WHEN pos % 3 = 0 THEN '[' || (pos // 3 + CASE WHEN pos > 20 THEN 2 ELSE 1 END) || '] ' || line ELSE '   ' || line END"""


@query(
    twins.with_(twins.LINES)
    + f""",
r AS (SELECT doc_id, pos, {REFERENCE_LINES} AS line, pos // 3 + 1 AS entry FROM lines),
e AS (SELECT doc_id, entry, CAST(regexp_extract(min_by(line, pos), '^\\[(\\d+)\\]', 1) AS INTEGER) AS number,
             trim(regexp_replace(string_agg(trim(line), ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text, count(*) - 1 AS merged FROM r GROUP BY doc_id, entry),
j AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY entry) AS b FROM e)
SELECT doc_id, entry, number, text, merged, CASE WHEN number <> b + 1 THEN b END AS jump_from FROM j"""
)
def d13_h6_reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered entries, continuation lines merged, jumps in the numbering."""
    lines = fixtures.lines(spark, sf_dir)
    made = F.expr("case when pos % 3 = 0 then concat('[', pos div 3 + case when pos > 20 then 2 else 1 end, '] ', line) else concat('   ', line) end")
    return windows.reference_entries(lines.select("doc_id", "pos", made.alias("line")))


@query(
    """
SELECT conv_id, turn, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS before,
       coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS after
FROM conversations"""
)
def h8_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = lambda a, b: F.collect_list("text").over(w.rowsBetween(a, b))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", near(-2, -1).alias("before"), near(1, 2).alias("after"))


@query(
    """
WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations),
f AS (
  SELECT conv_id, k, length(text) + 2 <= 900 AS open, CASE WHEN length(text) + 2 <= 900 THEN length(text) + 2 ELSE 0 END AS size FROM t WHERE k = 1
  UNION ALL
  SELECT t.conv_id, t.k, f.open AND f.size + length(text) + 2 <= 900, f.size + CASE WHEN f.open AND f.size + length(text) + 2 <= 900 THEN length(text) + 2 ELSE 0 END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY t.k DESC) FILTER (WHERE f.open), '') AS excerpt FROM t JOIN f USING (conv_id, k) GROUP BY conv_id"""
)
def h1_previous_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last whole turns of a conversation that fit into 900 characters."""
    return windows.excerpts(read_table(spark, sf_dir, "conversations"), 900, True, "conv_id", "turn")


@query(
    twins.with_(twins.CELLS)
    + """,
r AS (SELECT table_id, row_no, bool_and(tag = 'th') AS th, bool_or(regexp_matches(text, '\\d')) AS digits, count(*) AS n FROM cells GROUP BY table_id, row_no),
m AS (SELECT *, th OR (row_no = 1 AND n >= 2 AND NOT digits AND coalesce(lead(digits) OVER (PARTITION BY table_id ORDER BY row_no), false)) AS head FROM r)
SELECT table_id, row_no, bool_and(head) OVER (PARTITION BY table_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS repeats FROM m"""
)
def h9_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat on every page: the first ones, of header cells or without digits above digits."""
    rows = fixtures.cells(spark, sf_dir).groupBy("table_id", "row_no").agg(
        F.bool_and(F.col("tag") == "th").alias("th"), F.bool_or(F.col("text").rlike(r"\d")).alias("digits"), F.count("*").alias("n")
    )
    w = Window.partitionBy("table_id").orderBy("row_no")
    inferred = (F.col("row_no") == 1) & (F.col("n") >= 2) & ~F.col("digits") & F.coalesce(F.lead("digits").over(w), F.lit(False))
    marked = rows.withColumn("head", F.col("th") | inferred)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("table_id", "row_no", F.bool_and("head").over(so_far).alias("repeats"))


@query(
    twins.with_(twins.BLOCKS)
    + """,
n AS (SELECT doc_id, pos, kind, text, lead(kind) OVER w AS nk, lead(text) OVER w AS nt,
             last_value(CASE WHEN kind = 'caption' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CASE WHEN nk = 'caption' AND regexp_matches(nt, '(?i)^table\\b|^表') THEN nt ELSE before END AS caption FROM n WHERE kind = 'table'"""
)
def h15_caption_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption that directly follows a table and names one, else the nearest before it."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.last(F.when(F.col("kind") == "caption", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    named = (F.lead("kind").over(w) == "caption") & F.lead("text").over(w).rlike(r"(?i)^table\b|^表")
    found = fixtures.blocks(spark, sf_dir).select("doc_id", "pos", "kind", F.when(named, F.lead("text").over(w)).otherwise(before).alias("caption"))
    return found.filter("kind = 'table'").select("doc_id", "pos", "caption")


@query(
    twins.with_(twins.LINES)
    + """,
s AS (SELECT doc_id, pos, line FROM lines WHERE trim(line) <> '')
SELECT doc_id, pos, lag(line) OVER w AS previous, lead(line) OVER w AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""
)
def h13_caption_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-blank lines around each line."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = fixtures.lines(spark, sf_dir).filter(F.trim("line") != "")
    return lines.select("doc_id", "pos", F.lag("line").over(w).alias("previous"), F.lead("line").over(w).alias("next"))


@query(
    twins.with_(twins.BLOCKS)
    + """,
s AS (SELECT doc_id, text AS section, pos AS start, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), 1000000000) AS stop FROM blocks WHERE kind = 'heading' AND level IN (2, 3))
SELECT b.doc_id, b.pos, coalesce(s.section, 'preamble') AS section FROM blocks b LEFT JOIN s ON s.doc_id = b.doc_id AND b.pos >= s.start AND b.pos < s.stop WHERE b.kind = 'table'"""
)
def d11_owning_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of level 2 or 3 that a table stands in: the range join as a running value."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when((F.col("kind") == "heading") & F.col("level").isin(2, 3), F.col("text"))
    section = F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit("preamble"))
    return fixtures.blocks(spark, sf_dir).withColumn("section", section).filter("kind = 'table'").select("doc_id", "pos", "section")


@query(
    twins.with_(twins.LINES)
    + """
SELECT doc_id, pos, 'u_' || substr(sha256(line), 1, 24) || '_' || (row_number() OVER (PARTITION BY doc_id, sha256(line) ORDER BY pos) - 1) AS content_id FROM lines"""
)
def g8_duplicate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identifiers: digest, and the ordinal among equal lines of the document."""
    digest = F.sha2(F.col("line").cast("binary"), 256)
    lines = fixtures.lines(spark, sf_dir).withColumn("h", digest)
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("pos")) - 1
    return lines.select("doc_id", "pos", F.concat(F.lit("u_"), F.substring("h", 1, 24), F.lit("_"), ordinal).alias("content_id"))


@query(
    twins.with_(twins.PARTS)
    + """,
n AS (SELECT *, lead(first_page) OVER (PARTITION BY book ORDER BY part_no) AS nf FROM parts)
SELECT book, part_no, greatest(first_page, end_page - 2) AS seam_start, least(end_page + 2, nf + 2) AS seam_end, end_page AS boundary FROM n WHERE nf IS NOT NULL"""
)
def h10_seam_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages on either side of the boundary between consecutive parts."""
    following = F.lead("first_page").over(Window.partitionBy("book").orderBy("part_no"))
    parts = fixtures.parts(spark, sf_dir).withColumn("following", following).filter("following is not null")
    return parts.select(
        "book",
        "part_no",
        F.greatest("first_page", F.col("end_page") - 2).alias("seam_start"),
        F.least(F.col("end_page") + 2, F.col("following") + 2).alias("seam_end"),
        F.col("end_page").alias("boundary"),
    )


@query(
    twins.with_(twins.PARTS)
    + """,
l AS (SELECT *, lag(end_page) OVER (PARTITION BY book ORDER BY part_no) AS b FROM parts)
SELECT book, bool_and(coalesce(first_page = b, first_page = 0)) AS contiguous, max(end_page) AS pages FROM l GROUP BY book"""
)
def g17_part_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the parts follow each other without gaps from page 0?"""
    before = F.lag("end_page").over(Window.partitionBy("book").orderBy("part_no"))
    parts = fixtures.parts(spark, sf_dir).withColumn("b", before)
    fits = F.coalesce(F.col("first_page") == F.col("b"), F.col("first_page") == 0)
    return parts.groupBy("book").agg(F.bool_and(fits).alias("contiguous"), F.max("end_page").alias("pages"))
