"""SQL twins of ``quillstream.sources.fixtures`` for the oracles, as common table expressions."""

ORDER_PAIRS = """
order_base AS (
  SELECT o_orderkey AS unit_id, o_orderkey AS k, o_custkey AS c, o_orderpriority AS pr, CAST(o_totalprice AS DECIMAL(14,2)) AS p,
         o_orderdate AS d
  FROM orders),
order_source AS (
  SELECT *, 'Order ' || k || ' of customer ' || c || ' was placed on ' || strftime(d, '%-d %B %Y') || ' for a total of ' || p
            || ' with priority ' || pr || ' and entered by the clerk who keeps the ledger of the northern branch.' AS source
  FROM order_base),
order_pairs AS (
  SELECT unit_id, source,
         CASE WHEN k % 11 = 0 THEN '订单 ' || k
              WHEN k % 13 = 0 THEN source
              ELSE '客户 ' || c || ' 的订单 ' || k || ' 于 ' || year(d) || '年' || month(d) || '月' || day(d) || '日 下单，总额 '
                   || CAST(CASE WHEN k % 7 = 0 THEN p + 1 ELSE p END AS DECIMAL(14,2)) || '，优先级 ' || pr
                   || '，由负责北方分店账簿的店员登记。' END AS target
  FROM order_source)
"""

TURN_PAIRS = """
turn_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""

LINES = """
split_lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS s FROM documents),
lines AS (
  SELECT doc_id, lang, source, pos, s[pos + 1] AS line
  FROM (SELECT doc_id, lang, source, s, unnest(range(len(s))) AS pos FROM split_lines))
"""

BLOCKS = (
    LINES
    + """,
blocks AS (
  SELECT doc_id, pos,
         CASE pos % 7 WHEN 0 THEN 'heading' WHEN 3 THEN 'caption' WHEN 4 THEN 'table' ELSE 'text' END AS kind,
         CASE WHEN pos % 7 = 0 THEN CAST(pos // 7 % 3 + 1 AS INTEGER) END AS level,
         CASE pos % 7
           WHEN 0 THEN repeat('#', CAST(pos // 7 % 3 + 1 AS INTEGER)) || ' '
                       || CASE WHEN pos // 7 % 3 = 2 THEN 'References' ELSE 'Part ' || (pos // 7) END
           WHEN 3 THEN 'Table ' || (pos // 7) || '. ' || substr(line, 1, 40)
           WHEN 4 THEN '<table><tr><td>' || length(line) || '</td></tr></table>'
           ELSE line END AS text
  FROM lines)
"""
)

CELLS = """
cell_rows AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS line
  FROM lineitem),
cells AS (
  SELECT l_orderkey AS table_id, CAST(line + 1 AS INTEGER) AS row_no, col_no, 'td' AS tag,
         CASE col_no WHEN 1 THEN 'part ' || l_partkey WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
                     WHEN 3 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) ELSE l_returnflag END AS text
  FROM cell_rows, (SELECT unnest([1, 2, 3, 4]) AS col_no)
  UNION ALL
  SELECT l_orderkey, 1, col_no, 'th', ['part', 'quantity', 'price', 'flag'][col_no]
  FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest([1, 2, 3, 4]) AS col_no))
"""

FURNITURE = """
furniture_base AS (
  SELECT page_id, CAST(page_id % 20 + 1 AS INTEGER) AS page, regexp_extract(url, '://([^/?#]*)', 1) AS host,
         substr(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 60) AS title
  FROM pages),
furniture_flat AS (
  SELECT page_id, page, 'header' AS type, host AS text, 20 AS y1, 80 AS y2 FROM furniture_base
  UNION ALL SELECT page_id, page, 'page_number', CAST(page AS VARCHAR), 930, 970 FROM furniture_base
  UNION ALL SELECT page_id, page, 'header', title, 300, 340 FROM furniture_base
  UNION ALL SELECT page_id, page, 'footer', 'Copyright ' || host, 910, 990 FROM furniture_base),
furniture AS (SELECT *, y2 <= 100 OR y1 >= 900 AS margin FROM furniture_flat)
"""

UNITS = """
units AS (
  SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) AS unit_id, l_orderkey AS parent_id, 'cell' AS kind,
         'chapter ' || (l_suppkey % 10) AS chapter, CAST(l_partkey % 50 + 1 AS INTEGER) AS page,
         'Part ' || l_partkey || ' from supplier ' || l_suppkey AS source, '零件 ' || l_partkey AS translated,
         list_filter([CASE WHEN l_returnflag = 'R' THEN '数字可能发生变化' END,
                      CASE WHEN l_discount >= 0.09 THEN '译文异常短，可能漏译' END,
                      CASE WHEN l_linestatus = 'O' AND l_tax >= 0.07 THEN '术语待核对：tax → 税' END,
                      CASE WHEN l_quantity >= 49 THEN '表格结构不能可靠对应' END], lambda x: x IS NOT NULL) AS issues
  FROM lineitem)
"""

EDITS = """
edits AS (
  SELECT doc_id,
         CASE WHEN toxic = 1 THEN sha256('old ' || doc_id) ELSE sha256(coalesce(text, '')) END AS source_hash,
         CASE WHEN quality = 0 THEN ['edited ' || doc_id, 'edited ' || doc_id || ' again'] ELSE ['edited ' || doc_id] END AS history
  FROM labels JOIN documents USING (doc_id))
"""

PARTS = """
part_rows AS (
  SELECT o_custkey AS book, o_orderkey % 9 + 1 AS pages, row_number() OVER w AS part_no,
         sum(o_orderkey % 9 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS until
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
parts AS (
  SELECT book, part_no,
         CAST(until - pages + CASE WHEN book % 10 = 0 AND part_no > 1 THEN 1 ELSE 0 END AS BIGINT) AS first_page,
         CAST(until + CASE WHEN book % 10 = 0 AND part_no > 1 THEN 1 ELSE 0 END AS BIGINT) AS end_page
  FROM part_rows)
"""

USAGE = """
usage AS (
  SELECT ts AS recorded_at, user_id AS task, event_type AS phase, value AS seconds,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens, event_type = 'error' AS retry
  FROM events)
"""

GLOSSARY = """
part_names AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
glossary AS (
  SELECT 'global' AS layer, p_name AS source, '译' || k AS target FROM part_names
  UNION ALL SELECT 'book', upper(p_name), '本' || k FROM part_names WHERE k % 3 = 0)
"""


def with_(*tables: str) -> str:
    return "WITH " + ",".join(tables)
