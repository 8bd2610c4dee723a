"""Joins: overlays, guards, priorities, nearest rows, alignment, anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, windows
from ..sources import fixtures
from ..sources.tables import read_table
from . import twins
from .registry import query


@query(
    """
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS source FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text AS target FROM conversations WHERE role = 'assistant'),
ok AS (SELECT conv_id FROM (SELECT conv_id, count(*) AS n FROM u GROUP BY 1) JOIN (SELECT conv_id, count(*) AS m FROM a GROUP BY 1) USING (conv_id) WHERE n = m)
SELECT conv_id, pos, source, target FROM u JOIN a USING (conv_id, pos) JOIN ok USING (conv_id)"""
)
def f1_positional_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    rank = F.expr("row_number() over (partition by conv_id order by turn) - 1").cast("long")
    side = lambda role, name: turns.filter(F.col("role") == role).select("conv_id", rank.alias("pos"), F.col("text").alias(name))
    return joins.positional(side("user", "source"), side("assistant", "target"), ["conv_id"])


@query(
    twins.with_(twins.CELLS)
    + """,
t AS (SELECT table_id, row_no, col_no, tag, CASE WHEN table_id % 5 = 0 AND row_no = 2 AND col_no = 4 THEN 'th' ELSE tag END AS tag2, '译' || text AS target, text FROM cells),
ok AS (SELECT table_id FROM t GROUP BY table_id HAVING bool_and(tag = tag2))
SELECT table_id, row_no, col_no, text AS source, target FROM t JOIN ok USING (table_id)"""
)
def f2_guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two tables side by side, only where the tables have the same shape."""
    source = fixtures.cells(spark, sf_dir)
    other = F.when((F.col("table_id") % 5 == 0) & (F.col("row_no") == 2) & (F.col("col_no") == 4), "th").otherwise(F.col("tag"))
    target = source.select("table_id", "row_no", "col_no", other.alias("tag"), F.concat(F.lit("译"), "text").alias("target"))

    def shape(df: DataFrame) -> DataFrame:
        cell = F.struct("row_no", "col_no", "tag")
        return df.groupBy("table_id").agg(F.xxhash64(F.array_sort(F.collect_list(cell))).alias("shape"))

    same = shape(source).join(shape(target), ["table_id", "shape"]).select("table_id")
    pairs = source.select("table_id", "row_no", "col_no", F.col("text").alias("source")).join(target.drop("tag"), ["table_id", "row_no", "col_no"])
    return pairs.join(same, "table_id", "left_semi")


@query(
    twins.with_(twins.LINES)
    + """,
u AS (SELECT doc_id, pos, regexp_replace(line, '\\s+', '', 'g') AS key, row_number() OVER (PARTITION BY lang, regexp_replace(line, '\\s+', '', 'g') ORDER BY doc_id, pos) AS k,
             count(*) OVER (PARTITION BY lang, regexp_replace(line, '\\s+', '', 'g')) AS n, lang FROM lines WHERE regexp_matches(line, '\\S')),
p AS (SELECT conv_id, turn, key, row_number() OVER (PARTITION BY key ORDER BY conv_id, turn, n_line) AS j, count(*) OVER (PARTITION BY key) AS m
      FROM (SELECT conv_id, turn, unnest(range(len(s))) AS n_line, regexp_replace(s[n_line + 1], '\\s+', '', 'g') AS key
            FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations)) WHERE key <> ''),
c AS (SELECT key, count(*) AS n FROM u GROUP BY key),
r AS (SELECT doc_id, pos, key, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS k FROM u)
SELECT r.doc_id, r.pos, p.conv_id, p.turn FROM r JOIN c USING (key) JOIN p USING (key) WHERE p.m = 1 OR (p.m = c.n AND p.j = r.k)"""
)
def f3_guarded_location_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines located among conversation lines by their key, where unambiguous."""
    units = fixtures.lines(spark, sf_dir).select("doc_id", "pos", F.regexp_replace("line", r"\s+", "").alias("key")).filter("key <> ''")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    places = turns.select("conv_id", "turn", "at", F.regexp_replace("line", r"\s+", "").alias("key")).filter("key <> ''")
    units = units.withColumn("unit_at", F.struct("doc_id", "pos"))
    places = places.withColumn("place_at", F.struct("conv_id", "turn", "at"))
    return joins.guarded_location(units, places, "key", "unit_at", "place_at").select("doc_id", "pos", "conv_id", "turn")


@query(
    twins.with_(twins.EDITS)
    + """
SELECT d.doc_id, CASE WHEN e.source_hash = sha256(coalesce(text, '')) THEN history[-1] ELSE lang END AS effective
FROM documents d LEFT JOIN edits e USING (doc_id)"""
)
def f4_edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("own_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).select("doc_id", "lang", "own_hash")
    return joins.overlay(docs, fixtures.edits(spark, sf_dir), "doc_id", F.col("own_hash"), "lang").select("doc_id", "effective")


@query(
    twins.with_(twins.EDITS)
    + """
SELECT doc_id, CASE WHEN len(history) >= 2 THEN history[-2] ELSE 'machine ' || doc_id END AS restored, len(history) AS edits FROM edits"""
)
def h14_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.call_function("try_element_at", F.col("history"), F.lit(-2))
    machine = F.concat(F.lit("machine "), "doc_id")
    return fixtures.edits(spark, sf_dir).select("doc_id", F.coalesce(before, machine).alias("restored"), F.size("history").cast("long").alias("edits"))


@query(
    twins.with_(twins.GLOSSARY)
    + """
SELECT key, arg_max(layer, pri) AS layer, arg_max(target, pri) AS target
FROM (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS key, layer, target, CASE layer WHEN 'book' THEN 1 ELSE 0 END AS pri FROM glossary) GROUP BY key"""
)
def f6_glossary_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's own terms win over the global layer."""
    terms = fixtures.glossary(spark, sf_dir)
    best = joins.by_priority(terms, T.term_key(F.col("source")), F.when(F.col("layer") == "book", 1).otherwise(0))
    return best.select("key", "layer", "target")


@query(
    twins.with_(twins.GLOSSARY)
    + """,
g AS (SELECT lower(source) AS key, target FROM glossary WHERE layer = 'global'), b AS (SELECT lower(source) AS key, target FROM glossary WHERE layer = 'book')
SELECT key, coalesce(b.target, g.target) AS target, CASE WHEN b.target IS NULL THEN 'kept' WHEN g.target IS NULL THEN 'added' ELSE 'replaced' END AS action
FROM g FULL JOIN b USING (key)"""
)
def f7_glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = fixtures.glossary(spark, sf_dir).withColumn("key", F.lower("source"))
    old, new = terms.filter("layer = 'global'"), terms.filter("layer = 'book'")
    merged = joins.merge(old, new, "key", "target", "replace")
    known = old.select("key", F.lit(True).alias("was")).join(new.select("key", F.lit(True).alias("comes")), "key", "full")
    action = F.when(F.col("comes").isNull(), "kept").when(F.col("was").isNull(), "added").otherwise("replaced")
    return merged.join(known, "key").select("key", "target", action.alias("action"))


OMISSIONS = (
    twins.with_(twins.FURNITURE)
    + """,
body AS (SELECT page_id, page_id // 200 AS book, CAST(page_id % 20 + 1 AS INTEGER) AS page, 200 + (page_id * 37) % 700 AS top FROM pages),
body_lines AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents),
omitted AS (SELECT page_id, page_id // 200 AS book, page, text, y2 FROM furniture f WHERE NOT margin AND length(text) >= 8
            AND NOT EXISTS (SELECT 1 FROM body_lines d WHERE d.line = f.text))
"""
)


@query(
    OMISSIONS
    + """
SELECT o.page_id, o.text, arg_min(b.page_id, (b.top, b.page_id)) AS before
FROM omitted o LEFT JOIN body b ON b.book = o.book AND b.page = o.page AND b.top >= o.y2 GROUP BY o.page_id, o.text"""
)
def f8_omission_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrongly set aside as furniture, each with the block of its page that follows it."""
    furniture = fixtures.furniture(spark, sf_dir).filter(~F.col("margin") & (F.length("text") >= 8))
    known = fixtures.lines(spark, sf_dir).select(F.col("line").alias("text"))
    book = F.expr("page_id div 200").alias("book")
    omitted = furniture.join(known, "text", "left_anti").select("page_id", book, "page", "text", "y2")
    body = read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("block"), book, (F.col("page_id") % 20 + 1).cast("int").alias("page"), (F.col("page_id") * 37 % 700 + 200).alias("top")
    )
    found = joins.next_on_page(omitted, body, ["book", "page"], "y2", "top", "before")
    return found.select("page_id", "text", "before")


@query(
    """
WITH u AS (SELECT page_id AS unit, CAST(page_id AS DOUBLE) AS place FROM pages),
r AS (SELECT page_id + 100000 AS unit, page_id - 0.5 AS place FROM pages WHERE page_id % 4 = 0)
SELECT unit, row_number() OVER (ORDER BY place) AS pos FROM (SELECT * FROM u UNION ALL SELECT * FROM r)"""
)
def f9_ordered_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered units stand before their anchors; positions of a total order without one sorting task."""
    pages = read_table(spark, sf_dir, "pages")
    units = pages.select(F.col("page_id").alias("unit"), F.col("page_id").cast("double").alias("place"))
    recovered = pages.filter("page_id % 4 = 0").select((F.col("page_id") + 100000).alias("unit"), (F.col("page_id") - 0.5).alias("place"))
    return windows.ordered_positions(units.unionByName(recovered), "place").select("unit", "pos")


@query(
    """
SELECT p.p_partkey AS part, coalesce(a.l_returnflag, b.l_returnflag) AS state
FROM part p
LEFT JOIN (SELECT l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a ON a.l_partkey = p.p_partkey
LEFT JOIN (SELECT 'part ' || l_partkey AS stem, max(l_returnflag) AS l_returnflag FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b ON b.stem = 'part ' || p.p_partkey"""
)
def f10_part_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results found by identifier, or else by the stem of the file name."""
    items = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("part "), "p_partkey").alias("stem"))
    by_id = items.filter("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_returnflag").alias("a"))
    by_stem = items.filter("l_linestatus = 'F'").groupBy(F.concat(F.lit("part "), "l_partkey").alias("stem")).agg(F.max("l_returnflag").alias("b"))
    return part.join(by_id, "part", "left").join(by_stem, "stem", "left").select("part", F.coalesce("a", "b").alias("state"))


@query(
    """
SELECT n.o_orderkey AS part, o.o_orderstatus AS status
FROM orders n LEFT JOIN orders o ON o.o_orderkey = n.o_orderkey AND o.o_custkey % 10 = n.o_custkey % 10 AND o.o_orderkey % 3 <> 0"""
)
def f11_part_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts take the status of the former run's part of the same identifier and digest."""
    orders = read_table(spark, sf_dir, "orders")
    keyed = orders.select(F.col("o_orderkey").alias("part"), (F.col("o_custkey") % 10).alias("digest"), F.col("o_orderstatus").alias("status"))
    old = keyed.filter("part % 3 <> 0")
    return joins.carried_over(keyed.drop("status"), old, ["part", "digest"], ["status"]).select("part", "status")


@query(
    """
WITH asked AS (SELECT doc_id, sha256(coalesce(text, '')) AS k FROM documents), c AS (SELECT k, min(doc_id) AS hit FROM asked WHERE doc_id % 2 = 0 GROUP BY k)
SELECT doc_id, hit, hit IS NULL AS miss FROM asked LEFT JOIN c USING (k)"""
)
def f12_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and the cached answer of equal content, if there is one."""
    asked = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("k"))
    cache = asked.filter("doc_id % 2 = 0").groupBy("k").agg(F.min("doc_id").alias("hit"))
    return asked.join(cache, "k", "left").select("doc_id", "hit", F.col("hit").isNull().alias("miss"))


@query(
    """
WITH terms AS (SELECT l_orderkey AS seg, list_sort(list_distinct(list(l_returnflag))) AS now FROM lineitem GROUP BY 1),
saved AS (SELECT l_orderkey AS seg, list_sort(list_distinct(list(l_returnflag))) AS was FROM lineitem WHERE l_linenumber < 4 GROUP BY 1)
SELECT o_orderkey AS seg, CASE WHEN was IS NULL THEN 'pending' WHEN was = now THEN 'completed' ELSE 'pending' END AS status
FROM orders LEFT JOIN terms ON terms.seg = o_orderkey LEFT JOIN saved ON saved.seg = o_orderkey"""
)
def f13_state_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's saved state holds only while the terms that apply to it are the same."""
    items = read_table(spark, sf_dir, "lineitem")
    terms = lambda df, name: df.groupBy(F.col("l_orderkey").alias("seg")).agg(F.array_sort(F.collect_set("l_returnflag")).alias(name))
    segments = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg"))
    joined = segments.join(terms(items, "now"), "seg", "left").join(terms(items.filter("l_linenumber < 4"), "was"), "seg", "left")
    return joined.select("seg", F.when(F.col("was") == F.col("now"), "completed").otherwise("pending").alias("status"))


@query(
    """
WITH n AS (SELECT conv_id, turn, role, text FROM conversations),
o AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN text || '!' ELSE text END AS text FROM conversations WHERE conv_id % 5 <> 0),
a AS (SELECT conv_id, string_agg(role || '|' || text, '#' ORDER BY turn) AS s FROM n GROUP BY 1), b AS (SELECT conv_id, string_agg(role || '|' || text, '#' ORDER BY turn) AS s FROM o GROUP BY 1)
SELECT a.conv_id, coalesce(a.s = b.s, false) AS aligned FROM a LEFT JOIN b USING (conv_id)"""
)
def f14_sequence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read_table(spark, sf_dir, "conversations")
    other = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = new.filter("conv_id % 5 <> 0").withColumn("text", other)
    return joins.aligned_sequences(old, new, "conv_id", "turn", ["role", "text"])


@query(
    twins.with_(twins.UNITS)
    + """
SELECT parent_id, count(*) AS cells, count(*) FILTER (WHERE len(issues) > 0) AS with_issues FROM units GROUP BY parent_id"""
)
def f17_cell_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fixtures.units(spark, sf_dir)
    return units.groupBy("parent_id").agg(F.count("*").alias("cells"), F.count_if(F.size("issues") > 0).alias("with_issues"))


@query(
    twins.with_(twins.UNITS)
    + """,
p AS (SELECT DISTINCT page FROM units WHERE len(issues) > 0), f AS (SELECT DISTINCT CAST(page_id % 40 + 1 AS INTEGER) AS page FROM pages)
SELECT p.page, f.page IS NOT NULL AS available FROM p LEFT JOIN f USING (page)"""
)
def f18_issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fixtures.units(spark, sf_dir).filter(F.size("issues") > 0).select("page").distinct()
    files = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 40 + 1).cast("int").alias("page"), F.lit(True).alias("there")).distinct()
    return wanted.join(files, "page", "left").select("page", F.coalesce("there", F.lit(False)).alias("available"))


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def f19_unrecovered_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    recovered = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return read_table(spark, sf_dir, "pages").select("page_id", "url").join(recovered, "page_id", "left_anti")


@query(
    """
WITH h AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 20 AS title FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 20 AS entry FROM lineitem WHERE l_linenumber <= 2
           UNION SELECT DISTINCT o_orderkey, 99 FROM orders WHERE o_orderkey % 6 = 0)
SELECT e.doc, bool_and(h.title IS NOT NULL) AS is_toc FROM e LEFT JOIN h ON h.doc = e.doc AND h.title = e.entry GROUP BY e.doc"""
)
def f20_toc_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is every entry of a contents page a later heading?"""
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 20).alias("t"), "l_linenumber")
    odd = read_table(spark, sf_dir, "orders").filter("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("doc"), F.lit(99).cast("long").alias("t"))
    entries = items.filter("l_linenumber <= 2").select("doc", "t").unionByName(odd).groupBy("doc").agg(F.collect_set("t").alias("e"))
    headings = items.groupBy("doc").agg(F.collect_set("t").alias("h"))
    missing = F.array_except("e", F.coalesce("h", F.array().cast("array<bigint>")))
    return entries.join(headings, "doc", "left").select("doc", (F.size(missing) == 0).alias("is_toc"))


@query(
    """
SELECT c_custkey AS task, c_name AS name, n.n_name AS origin, coalesce(o.segments, 0) AS segments, o.latest, coalesce(o.failed, 0) > 0 AS needs_review
FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS segments, max(o_orderdate) AS latest, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey"""
)
def f21_task_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with the state of their segments: a star of left joins, the facts reduced first."""
    state = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(
        F.count("*").alias("segments"), F.max("o_orderdate").alias("latest"), F.count_if(F.col("o_orderstatus") == "F").alias("failed")
    )
    tasks = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    origin = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("origin"))
    zero = F.lit(0).cast("long")
    return tasks.join(origin, "n_nationkey", "left").join(state, "task", "left").select(
        "task", "name", "origin", F.coalesce("segments", zero).alias("segments"), "latest", (F.coalesce("failed", zero) > 0).alias("needs_review")
    )


@query(
    """
SELECT o_orderkey AS seg FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_returnflag <> 'R')"""
)
def m6_pending_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do: segments without a finished result."""
    done = read_table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F' and l_returnflag <> 'R'").select(F.col("l_orderkey").alias("seg"))
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg")).join(done, "seg", "left_anti")
