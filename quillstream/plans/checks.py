"""Checks on pairs of texts: the issue triage and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import numbers
from ..operators import checks
from ..sources import fixtures
from ..sources.tables import read_table
from . import twins
from .registry import query

NUMBERS_SQL = """
numbered AS (
  SELECT unit_id, side, text,
         regexp_extract(text, '([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})', 1) AS en, regexp_extract(text, '[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日') AS zh
  FROM (SELECT unit_id, 'source' AS side, source AS text FROM order_pairs UNION ALL SELECT unit_id, 'target', target FROM order_pairs)),
rest AS (
  SELECT unit_id, side,
         CASE WHEN en <> '' THEN 'date:' || strftime(strptime(en, '%d %B %Y'), '%Y-%m-%d')
              WHEN zh <> '' THEN 'date:' || strftime(strptime(zh, '%Y年%m月%d日'), '%Y-%m-%d') END AS day,
         replace(replace(text, en, ' '), zh, ' ') AS text
  FROM numbered),
tokens AS (
  SELECT unit_id, side, day AS token FROM rest WHERE day IS NOT NULL
  UNION ALL
  SELECT unit_id, side, regexp_replace(regexp_replace(t, '^([-]?)0+([0-9])', '\\1\\2'), '(\\.[0-9]*?)0+$', '\\1') AS token
  FROM (SELECT unit_id, side, unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9_])([-+]?[0-9]+(?:[.,][0-9]+)*)', 2)) AS t FROM rest)),
clean AS (SELECT unit_id, side, regexp_replace(token, '\\.$', '') AS token FROM tokens)
"""


@query(
    twins.with_(twins.ORDER_PAIRS, NUMBERS_SQL)
    + "SELECT unit_id, side, token, count(*) AS n FROM clean GROUP BY unit_id, side, token"
)
def d16_number_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixtures.order_pairs(spark, sf_dir)
    sides = pairs.selectExpr("unit_id", "stack(2, 'source', source, 'target', target) as (side, text)")
    return sides.select("unit_id", "side", F.explode(numbers(F.col("text"))).alias("token")).groupBy("unit_id", "side", "token").agg(F.count("*").alias("n"))


@query(
    twins.with_(twins.ORDER_PAIRS, NUMBERS_SQL)
    + """
SELECT unit_id, CASE WHEN sum(b) > 0 THEN 'missing' ELSE 'extra' END AS direction, token, CAST(abs(sum(b)) AS BIGINT) AS n
FROM (SELECT unit_id, token, CASE side WHEN 'source' THEN 1 ELSE -1 END AS b FROM clean) GROUP BY unit_id, token HAVING sum(b) <> 0"""
)
def g6_number_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each side has more of: a multiset difference as one grouped count, without a join."""
    pairs = fixtures.order_pairs(spark, sf_dir)
    sides = pairs.selectExpr("unit_id", "stack(2, 1, source, -1, target) as (sign, text)")
    tokens = sides.select("unit_id", "sign", F.explode(numbers(F.col("text"))).alias("token"))
    more = tokens.groupBy("unit_id", "token").agg(F.sum("sign").alias("balance")).filter("balance <> 0")
    direction = F.when(F.col("balance") > 0, "missing").otherwise("extra")
    return more.select("unit_id", direction.alias("direction"), "token", F.abs("balance").alias("n"))


@query(
    twins.with_(twins.ORDER_PAIRS, NUMBERS_SQL)
    + """,
l AS (SELECT unit_id, token, row_number() OVER (PARTITION BY unit_id, token) AS k FROM clean WHERE side = 'source'),
r AS (SELECT unit_id, token, row_number() OVER (PARTITION BY unit_id, token) AS k FROM clean WHERE side = 'target')
SELECT unit_id, token FROM l ANTI JOIN r USING (unit_id, token, k)"""
)
def j2_except_all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixtures.order_pairs(spark, sf_dir)
    side = lambda c: pairs.select("unit_id", F.explode(numbers(F.col(c))).alias("token"))
    return side("source").exceptAll(side("target"))


TRIAGE_SQL = (
    twins.with_(twins.ORDER_PAIRS, twins.TURN_PAIRS, NUMBERS_SQL)
    + """,
sorted AS (SELECT unit_id, side, list(token ORDER BY token) AS t FROM clean GROUP BY unit_id, side),
same AS (
  SELECT p.unit_id, coalesce(a.t, []) = coalesce(b.t, []) AS equal
  FROM order_pairs p LEFT JOIN sorted a ON a.unit_id = p.unit_id AND a.side = 'source'
  LEFT JOIN sorted b ON b.unit_id = p.unit_id AND b.side = 'target'),
pairs AS (
  SELECT 'order:' || unit_id AS unit_id, source, target, equal FROM order_pairs JOIN same USING (unit_id)
  UNION ALL SELECT 'turn:' || conv_id || ':' || turn, trim(source), trim(target), true FROM turn_pairs),
ruled AS (
  SELECT unit_id, list_filter([
      CASE WHEN NOT equal THEN '数字可能发生变化' END,
      CASE WHEN len(regexp_extract_all(source, '[A-Za-z]{2,}')) >= 6 AND NOT regexp_matches(target, '[一-鿿]') THEN '疑似整段未翻译' END,
      CASE WHEN length(source) >= 120 AND length(target) < length(source) * 0.12 THEN '译文异常短，可能漏译' END,
      CASE WHEN length(source) >= 120 AND length(target) > length(source) * 2 THEN '译文异常长，可能增加内容' END],
      lambda x: x IS NOT NULL) AS reasons
  FROM pairs),
ranked AS (
  SELECT unit_id, array_to_string(reasons, '；') AS reasons,
         CASE WHEN list_contains(reasons, '数字可能发生变化') THEN 1 ELSE 3 END AS rank
  FROM ruled WHERE len(reasons) > 0)
SELECT unit_id, reasons, rank, CASE rank WHEN 1 THEN '数值与单位' ELSE '翻译疑点' END AS category FROM ranked"""
)


@query(TRIAGE_SQL)
def k2_concern_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of texts with a concern, its category and rank."""
    orders = fixtures.order_pairs(spark, sf_dir).withColumn("unit_id", F.concat(F.lit("order:"), "unit_id"))
    turns = fixtures.turn_pairs(spark, sf_dir).select(F.concat(F.lit("turn:"), "conv_id", F.lit(":"), "turn").alias("unit_id"), "source", "target")
    found = checks.with_concerns(orders.unionByName(turns)).filter(F.size("concerns") > 0)
    ranked = found.withColumn("rank", checks.category_rank(F.col("concerns"), F.lit("text")))
    return ranked.select("unit_id", F.array_join("concerns", "；").alias("reasons"), "rank", checks.category(F.col("rank")).alias("category"))


@query(
    TRIAGE_SQL.rsplit("ranked AS (", 1)[0].rstrip().rstrip(",")
    + """,
more AS (SELECT unit_id, token, sum(CASE side WHEN 'source' THEN 1 ELSE -1 END) AS b FROM clean GROUP BY unit_id, token HAVING b <> 0),
each AS (SELECT unit_id, token, b > 0 AS missing, unnest(range(CAST(abs(b) AS BIGINT))) AS k FROM more),
lists AS (SELECT unit_id, string_agg(token, '、' ORDER BY token) FILTER (WHERE missing) AS a, string_agg(token, '、' ORDER BY token) FILTER (WHERE NOT missing) AS b
          FROM each GROUP BY unit_id)
SELECT CAST(split_part(r.unit_id, ':', 2) AS BIGINT) AS unit_id, concat_ws('；', array_to_string(reasons, '；'),
       CASE WHEN list_contains(reasons, '数字可能发生变化') THEN '原文有而现译缺少：' || a END, CASE WHEN list_contains(reasons, '数字可能发生变化') THEN '现译新增或不同：' || b END) AS detail
FROM ruled r LEFT JOIN lists l ON 'order:' || l.unit_id = r.unit_id WHERE len(reasons) > 0 AND starts_with(r.unit_id, 'order:')"""
)
def c28_issue_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixtures.order_pairs(spark, sf_dir)
    found = checks.with_concerns(pairs).filter(F.size("concerns") > 0)
    found = found.withColumns({"a": numbers(F.col("source")), "b": numbers(F.col("target"))})
    return found.select("unit_id", checks.issue_detail(F.col("concerns"), F.col("a"), F.col("b")).alias("detail"))


PROTECTED = """
SELECT o_orderkey AS unit_id,
       concat('[[[TP_BEGIN_0000]]]', chr(10), '# Order ', o_orderkey, chr(10), '[[[TP_END_0001]]]') AS source,
       CASE o_orderkey % 7
         WHEN 0 THEN concat('[[[TP_BEGIN_0000]]]', chr(10), '## 订单 ', o_orderkey, chr(10), '[[[TP_END_0001]]]')
         WHEN 1 THEN concat('[[[TP_BEGIN_0000]]]', chr(10), '# 订单 ', o_orderkey)
         WHEN 2 THEN concat('[[[TP_BEGIN_0000]]]', chr(10), '[[[TP_END_0001]]]')
         WHEN 3 THEN concat('note [[[TP_BEGIN_0000]]]', chr(10), '# 订单', chr(10), '[[[TP_END_0001]]]')
         WHEN 4 THEN ' '
         WHEN 5 THEN concat('[[[TP_BEGIN_0000]]]', chr(10), '# 订单 [[[TP_MATH]]]', chr(10), '[[[TP_END_0001]]]')
         ELSE concat('[[[TP_BEGIN_0000]]]', chr(10), '# 订单 ', o_orderkey, chr(10), '[[[TP_END_0001]]]') END AS target
FROM orders
"""


@query(
    f"WITH p AS ({PROTECTED})"
    """
SELECT unit_id, list_filter([
    CASE WHEN trim(target) = '' THEN 'empty' END,
    CASE WHEN unit_id % 7 IN (1, 4) THEN 'marks' END,
    CASE WHEN contains(regexp_replace(target, '\\[\\[\\[TP_[A-Z]+_[0-9]+\\]\\]\\]', '', 'g'), '[[[TP_') THEN 'damaged mark' END,
    CASE WHEN regexp_matches(regexp_replace(target, '(?s)\\[\\[\\[TP_BEGIN_[0-9]+\\]\\]\\].*?\\[\\[\\[TP_END_[0-9]+\\]\\]\\]', '', 'g'), '\\S')
         THEN 'text outside blocks' END,
    CASE WHEN regexp_matches(target, '^\\[\\[\\[TP_BEGIN_0000\\]\\]\\]\\s*\\[\\[\\[TP_END_0001\\]\\]\\]$') THEN 'empty block' END,
    CASE WHEN regexp_matches(target, 'TP_END') AND NOT regexp_matches(target, '(?m)^# ') THEN 'heading levels' END],
    lambda x: x IS NOT NULL) AS violations
FROM p"""
)
def k1_structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("_k1_orders")
    pairs = spark.sql(PROTECTED.replace("FROM orders", "FROM _k1_orders"))
    return pairs.select("unit_id", checks.structure_violations(F.col("source"), F.col("target")).alias("violations"))


@query(
    """
SELECT o_custkey AS task, CASE max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END)
         WHEN 2 THEN 'partial_failed' WHEN 1 THEN 'needs_review' ELSE 'completed' END AS status
FROM orders GROUP BY o_custkey"""
)
def g15_status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status of a task's segments."""
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    worst = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.max(rank).alias("r"))
    return worst.select("task", F.element_at(F.array(*map(F.lit, ("completed", "needs_review", "partial_failed"))), F.col("r") + 1).alias("status"))


@query(
    twins.with_(twins.UNITS)
    + """
SELECT unit_id, CASE WHEN len(list_filter(issues, lambda r: regexp_matches(r, '遗漏|结构|对应|未完成|失败'))) > 0 THEN 0
                     WHEN len(list_filter(issues, lambda r: regexp_matches(r, '数字|数值'))) > 0 THEN 1
                     WHEN len(list_filter(issues, lambda r: contains(r, '术语'))) > 0 THEN 2
                     WHEN len(issues) > 0 THEN 3 ELSE 4 END AS rank,
       list_transform(issues, lambda r: CASE WHEN contains(r, '数字') THEN 'numbers' WHEN regexp_matches(r, '公式|标记') THEN 'formula'
                WHEN contains(r, '遗漏') THEN 'omission' WHEN regexp_matches(r, '未翻译|术语') THEN 'translation' ELSE 'review' END) AS advice
FROM units"""
)
def c26_c27_category_and_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.units(spark, sf_dir).select(
        "unit_id",
        checks.category_rank(F.col("issues"), F.col("kind")).alias("rank"),
        F.transform("issues", checks.suggestion_kind).alias("advice"),
    )
