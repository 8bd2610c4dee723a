"""Document structures derived from the relational tables, as DataFrames.

Each function has a SQL twin in ``quillstream.plans.twins`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, spread


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, source, target: an English sentence on every order and its Chinese counterpart.

    Every 7th order has another total in the target, every 11th a target that breaks off,
    every 13th is left in English.
    """
    orders = spread(read_table(spark, sf_dir, "orders"))
    price = F.col("o_totalprice").cast("decimal(14,2)")
    source = F.concat(
        F.lit("Order "), F.col("o_orderkey"), F.lit(" of customer "), F.col("o_custkey"), F.lit(" was placed on "),
        F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" for a total of "), price, F.lit(" with priority "),
        F.col("o_orderpriority"), F.lit(" and entered by the clerk who keeps the ledger of the northern branch."),
    )
    date = F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.dayofmonth("o_orderdate"), F.lit("日"))
    total = F.when(F.col("o_orderkey") % 7 == 0, price + 1).otherwise(price).cast("decimal(14,2)")
    full = F.concat(
        F.lit("客户 "), F.col("o_custkey"), F.lit(" 的订单 "), F.col("o_orderkey"), F.lit(" 于 "), date, F.lit(" 下单，总额 "),
        total, F.lit("，优先级 "), F.col("o_orderpriority"), F.lit("，由负责北方分店账簿的店员登记。"),
    )
    target = (
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("订单 "), F.col("o_orderkey")))
        .when(F.col("o_orderkey") % 13 == 0, source)
        .otherwise(full)
    )
    return orders.select(F.col("o_orderkey").alias("unit_id"), source.alias("source"), target.alias("target"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source, target: a user's turn and the assistant's next one."""
    turns = read_table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return asked.join(answers, ["conv_id", "turn"])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pos, line: the lines of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, kind, level, text: the lines of every document as blocks of a book.

    By position modulo 7: a heading, two paragraphs, a caption, a table, two paragraphs; every
    third heading opens a reference section.
    """
    k, no = F.col("pos") % 7, F.expr("pos div 7")
    kind = F.when(k == 0, "heading").when(k == 3, "caption").when(k == 4, "table").otherwise("text")
    level = F.when(k == 0, no % 3 + 1).cast("int")
    title = F.when(no % 3 == 2, F.lit("References")).otherwise(F.concat(F.lit("Part "), no))
    text = (
        F.when(k == 0, F.concat(F.expr("repeat('#', cast(pos div 7 % 3 + 1 as int))"), F.lit(" "), title))
        .when(k == 3, F.concat(F.lit("Table "), no, F.lit(". "), F.substring("line", 1, 40)))
        .when(k == 4, F.concat(F.lit("<table><tr><td>"), F.length("line"), F.lit("</td></tr></table>")))
        .otherwise(F.col("line"))
    )
    return lines(spark, sf_dir).select("doc_id", "pos", kind.alias("kind"), level.alias("level"), text.alias("text"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, row_no, col_no, tag, text: a table for every order, a row for each line item.

    Row 1 names the columns.
    """
    items = read_table(spark, sf_dir, "lineitem")
    line = F.expr(
        "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag)"
    )
    body = items.withColumn("line", line).select(
        F.col("l_orderkey").alias("table_id"),
        (F.col("line") + 1).cast("int").alias("row_no"),
        F.posexplode(
            F.array(
                F.concat(F.lit("part "), F.col("l_partkey")),
                F.col("l_quantity").cast("int").cast("string"),
                F.col("l_extendedprice").cast("decimal(14,2)").cast("string"),
                F.col("l_returnflag"),
            )
        ).alias("k", "text"),
    ).select("table_id", "row_no", (F.col("k") + 1).alias("col_no"), F.lit("td").alias("tag"), "text")
    head = items.select(F.col("l_orderkey").alias("table_id")).distinct().select(
        "table_id",
        F.lit(1).alias("row_no"),
        F.posexplode(F.array(*map(F.lit, ("part", "quantity", "price", "flag")))).alias("k", "text"),
    ).select("table_id", "row_no", (F.col("k") + 1).alias("col_no"), F.lit("th").alias("tag"), "text")
    return head.unionByName(body)


def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, page, type, text, y1, y2, margin: header, footer, title and number of every page."""
    pages = read_table(spark, sf_dir, "pages")
    page = (F.col("page_id") % 20 + 1).cast("int")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    title = F.substring(F.regexp_extract("html", "<title>([^<]*)</title>", 1), 1, 60)
    row = lambda kind, text, y1, y2: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(y1).alias("y1"), F.lit(y2).alias("y2"))
    rows = F.array(
        row("header", host, 20, 80),
        row("page_number", page.cast("string"), 930, 970),
        row("header", title, 300, 340),
        row("footer", F.concat(F.lit("Copyright "), host), 910, 990),
    )
    flat = pages.select("page_id", page.alias("page"), F.explode(rows).alias("f")).select("page_id", "page", "f.*")
    return flat.withColumn("margin", (F.col("y2") <= 100) | (F.col("y1") >= 900))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, parent_id, kind, chapter, page, source, translated, issues: review units.

    An order is a table whose line items are cells; each line item has issues by its flags.
    """
    items = read_table(spark, sf_dir, "lineitem")
    issues = F.array_compact(
        F.array(
            F.when(F.col("l_returnflag") == "R", F.lit("数字可能发生变化")),
            F.when(F.col("l_discount") >= 0.09, F.lit("译文异常短，可能漏译")),
            F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.07), F.lit("术语待核对：tax → 税")),
            F.when(F.col("l_quantity") >= 49, F.lit("表格结构不能可靠对应")),
        )
    )
    return items.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("unit_id"),
        F.col("l_orderkey").alias("parent_id"),
        F.lit("cell").alias("kind"),
        F.concat(F.lit("chapter "), F.col("l_suppkey") % 10).alias("chapter"),
        (F.col("l_partkey") % 50 + 1).cast("int").alias("page"),
        F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" from supplier "), F.col("l_suppkey")).alias("source"),
        F.concat(F.lit("零件 "), F.col("l_partkey")).alias("translated"),
        issues.alias("issues"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_hash, history: human edits of the labelled documents.

    A document of low quality has two edits, others one; a toxic one has an outdated hash.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    first = F.concat(F.lit("edited "), F.col("doc_id"))
    history = F.when(F.col("quality") == 0, F.array(first, F.concat(first, F.lit(" again")))).otherwise(F.array(first))
    stale = F.when(F.col("toxic") == 1, F.sha2(F.concat(F.lit("old "), F.col("doc_id")).cast("binary"), 256)).otherwise(digest)
    return labels.join(docs, "doc_id").select("doc_id", stale.alias("source_hash"), history.alias("history"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, part_no, first_page, end_page: page ranges of every customer's orders in order.

    An order has 1 to 9 pages; every 10th customer has a gap after the first part.
    """
    orders = read_table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 9 + 1).cast("long").alias("pages")
    )
    rows = rows.selectExpr(
        "book",
        "row_number() over (partition by book order by key) as part_no",
        "sum(pages) over (partition by book order by key rows unbounded preceding) as until",
        "pages",
    )
    gap = F.when((F.col("book") % 10 == 0) & (F.col("part_no") > 1), 1).otherwise(0)
    return rows.select("book", "part_no", (F.col("until") - F.col("pages") + gap).alias("first_page"), (F.col("until") + gap).alias("end_page"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recorded_at, task, phase, seconds, total_tokens, retry: the usage ledger."""
    return read_table(spark, sf_dir, "events").select(
        F.col("ts").alias("recorded_at"),
        F.col("user_id").alias("task"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("total_tokens"),
        (F.col("event_type") == "error").alias("retry"),
    )


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, source, target: a global layer of part names, and a document's own for some of them."""
    names = read_table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    shared = names.select(F.lit("global").alias("layer"), F.col("p_name").alias("source"), F.concat(F.lit("译"), F.col("k")).alias("target"))
    own = names.filter("k % 3 = 0").select(F.lit("book").alias("layer"), F.upper("p_name").alias("source"), F.concat(F.lit("本"), F.col("k")).alias("target"))
    return shared.unionByName(own)
