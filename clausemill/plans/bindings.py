"""The operators bound to the test tables: orders stand for documents, their items for facts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions import text as T
from clausemill.operators import evaluate as E, extract, gapfill, knowledge as K, rules as R, scan, segment, synth
from clausemill.plans import benchmark, review as V
from clausemill.sources import tables
from clausemill.sources.tables import Rule


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- lines and sections


def lines_offsets(spark, d):
    lines = segment.lines(segment.raw_lines(t(spark, d, "documents")))
    return lines.select("doc_id", "line_no", "char_start", "char_end", F.md5("text").alias("line_md5"))


LINES_OFFSETS = r"""
WITH p AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
s AS (SELECT doc_id, pos, regexp_replace(l, '^\s+|\s+$', '', 'g') AS l FROM p),
n AS (SELECT doc_id, row_number() OVER w - 1 AS line_no, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start, l
      FROM s WHERE l <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(l) AS INTEGER) AS char_end, md5(l) AS line_md5 FROM n"""


def numbered_lines(spark, d):
    x = t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.split_lines(F.col("text"))).alias("i", "line"))
    return x.select("conv_id", "turn", (F.col("i") + 1).alias("lineno"), F.length("line").alias("n"))


NUMBERED_LINES = r"""
WITH a AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS a FROM conversations WHERE text <> ''),
x AS (SELECT conv_id, turn, generate_subscripts(a, 1) AS lineno, unnest(a) AS line FROM a)
SELECT conv_id, turn, CAST(lineno AS INTEGER) AS lineno, CAST(length(line) AS INTEGER) AS n FROM x"""

_HEADING = "CASE p_partkey % 6 WHEN 0 THEN concat('一、', p_name) WHEN 1 THEN concat('3.2 ', p_name) WHEN 2 THEN concat('1.《', p_name, '》') WHEN 3 THEN concat('3.2.1、', p_name) WHEN 4 THEN concat('x', p_name) ELSE concat('5.4m', p_name) END"


def heading_levels(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.expr(_HEADING).alias("text"))
    return x.select("p_partkey", T.heading_level(F.col("text")).cast("int").alias("level"))


HEADING_LEVELS = f"""
WITH x AS (SELECT p_partkey, {_HEADING} AS text FROM part),
y AS (SELECT *, regexp_extract(text, '^([0-9]+(?:\\.[0-9]+)*)(?:[、.）)]\\s*|\\s+)(\\S.*)$', 1) AS n, regexp_extract(text, '^([0-9]+(?:\\.[0-9]+)*)(?:[、.）)]\\s*|\\s+)(\\S.*)$', 2) AS title FROM x)
SELECT p_partkey, CAST(CASE WHEN regexp_matches(text, '^[一二三四五六七八九十百]+\\s*、') THEN 1 WHEN n <> '' AND NOT starts_with(title, '《') THEN length(n) - length(replace(n, '.', '')) + 1 END AS INTEGER) AS level FROM y"""


def section_paths(spark, d):
    raw = t(spark, d, "part").selectExpr("p_partkey div 40 AS doc_id", "p_partkey % 40 AS pos", "concat('x', p_partkey) AS text", "CASE (p_partkey * 7) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS level")
    return segment.parse(raw).select("doc_id", "line_no", "level", "section_path")


SECTION_PATHS = """
WITH raw AS (SELECT p_partkey // 40 AS doc_id, p_partkey % 40 AS pos, concat('x', p_partkey) AS text, CASE (p_partkey * 7) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS level FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no FROM raw),
k AS (SELECT *,
  last_value(CASE WHEN level = 1 THEN line_no END IGNORE NULLS) OVER w AS n1, last_value(CASE WHEN level = 2 THEN line_no END IGNORE NULLS) OVER w AS n2, last_value(CASE WHEN level = 3 THEN line_no END IGNORE NULLS) OVER w AS n3,
  last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER w AS t3
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(level AS INTEGER) AS level,
  concat_ws('/', t1, CASE WHEN n2 > coalesce(n1, -1) THEN t2 END, CASE WHEN n3 > greatest(coalesce(n1, -1), coalesce(n2, -1)) THEN t3 END) AS section_path FROM k"""

# -- normalisation and extraction

_WIDE = "concat('开挖 深度 ', translate(CAST(CAST(l_quantity AS INT) AS STRING), '0123456789', '０１２３４５６７８９'), ' ． ', CAST(l_linenumber AS STRING), ' ｍ，K 1 2 次')"


def fold_normalize(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.normalise(F.expr(_WIDE)).alias("folded"))


FOLD_NORMALIZE = r"""
WITH x AS (SELECT l_orderkey, l_linenumber, concat('开挖 深度 ', CAST(CAST(l_quantity AS INT) AS VARCHAR), ' . ', CAST(l_linenumber AS VARCHAR), ' m，K 1 2 次') AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, replace(regexp_replace(s, '([0-9])\s*\.\s*([0-9])', '\1.\2', 'g'), ' ', '') AS folded FROM x"""


#: Place of an item in its order; line numbers alone repeat.
_AT = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey"


def _sentences(spark, d, depth: str):
    text = f"concat('基坑开挖深度为', CAST(CAST({depth} AS INT) AS STRING), 'm，挖深同前，水平位移控制值取', CAST(l_linenumber * 90 AS STRING), 'mm。')"
    raw = t(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_AT} AS pos", f"{text} AS text")
    return segment.parse(raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id"))  # the file is one row group


def param_cards(spark, d):
    return extract.cards(_sentences(spark, d, "l_quantity")).select("doc_id", "ord", "param_id", "value", "unit", "raw_text")


PARAM_CARDS = """
WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS k, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem),
c AS (SELECT doc_id, k, 0 AS p, 'dp.excavation_depth' AS param_id, CAST(q AS DOUBLE) AS value, 'm' AS unit, '开挖深度为' || q || 'm' AS raw_text FROM x
      UNION ALL SELECT doc_id, k, 1, 'dp.retaining.displacement', CAST(n * 90 AS DOUBLE), 'mm', '水平位移控制值取' || CAST(n * 90 AS VARCHAR) || 'mm' FROM x)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, p) - 1 AS INTEGER) AS ord, param_id, value, unit, raw_text FROM c
WHERE (p = 0 AND value > 0 AND value <= 50) OR (p = 1 AND value > 0 AND value <= 500)"""


def param_discarded(spark, d):
    return extract.discarded(_sentences(spark, d, "l_quantity * 3")).select("doc_id", "param", "value", "unit", "reason")


PARAM_DISCARDED = """
WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, CAST(CAST(l_quantity * 3 AS INT) AS DOUBLE) AS q FROM lineitem)
SELECT doc_id, 'dp.excavation_depth' AS param, q AS value, 'm' AS unit, '超出物理合理范围(0, 50]' AS reason FROM x WHERE q <= 0 OR q > 50
UNION ALL SELECT doc_id, 'dp.retaining.displacement', CAST(k * 90 AS DOUBLE), 'mm', '超出物理合理范围(0, 500]' FROM x WHERE k * 90 > 500"""


def _tricky(q: str) -> str:
    """Sentences with a guard word, millimetres and a second name of a unit, overlapping names, and a fact said twice."""
    return (f"CASE l_linenumber % 4 WHEN 0 THEN concat('每层开挖深度不超过', {q}, 'm，分段挖深', {q}, 'm') WHEN 1 THEN concat('基坑开挖深度为', {q}, '00mm，位移报警值', {q}, '毫米') "
            f"WHEN 2 THEN concat('挖深见开挖深度', {q}, 'm，基坑深度', {q}, '.5m') ELSE concat('监测频率', {q}, '次/天，监测频次', {q}, '次每日') END")  # fmt: skip


def param_guards(spark, d):
    raw = t(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_AT} AS pos", f"{_tricky('CAST(CAST(l_quantity AS INT) AS STRING)')} AS text")
    facts_ = extract.numeric(segment.lines(raw))
    return facts_.select("doc_id", "line_no", "param_id", "raw_text", F.round("value", 6).alias("value"), "unit", "in_range")


PARAM_GUARDS = """
WITH x AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) - 1 AS INTEGER) AS line_no, l_linenumber % 4 AS k, CAST(l_quantity AS INT) AS n, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem),
f AS (SELECT doc_id, line_no, 'dp.excavation_depth' AS param_id, '开挖深度为' || q || '00mm' AS raw_text, n * 100 / 1000.0 AS value, 'm' AS unit FROM x WHERE k = 1
  UNION ALL SELECT doc_id, line_no, 'dp.retaining.displacement', '位移报警值' || q || '毫米', n, 'mm' FROM x WHERE k = 1
  UNION ALL SELECT doc_id, line_no, 'dp.excavation_depth', '开挖深度' || q || 'm', n, 'm' FROM x WHERE k = 2
  UNION ALL SELECT doc_id, line_no, 'dp.excavation_depth', '基坑深度' || q || '.5m', n + 0.5, 'm' FROM x WHERE k = 2
  UNION ALL SELECT doc_id, line_no, 'dp.monitoring.frequency', '监测频率' || q || '次/天', n, '次/d' FROM x WHERE k = 3
  UNION ALL SELECT doc_id, line_no, 'dp.monitoring.frequency', '监测频次' || q || '次每日', n, '次/d' FROM x WHERE k = 3)
SELECT doc_id, line_no, param_id, raw_text, round(CAST(value AS DOUBLE), 6) AS value, unit,
  value > 0 AND value <= CASE param_id WHEN 'dp.excavation_depth' THEN 50 WHEN 'dp.retaining.displacement' THEN 500 ELSE 24 END AS in_range FROM f"""


def lines_scanned(spark, d):
    return extract.scanned(_lines(spark, d))


LINES_SCANNED = f"SELECT doc_id, count(*) AS lines_scanned FROM ({LINES_OFFSETS}) GROUP BY doc_id"


def text_param_first(spark, d):
    text = "CASE WHEN (l_linenumber + l_orderkey) % 3 = 0 THEN concat('侧壁安全等级为', CASE l_returnflag WHEN 'A' THEN '一' WHEN 'N' THEN '二' ELSE '三' END, '级。') ELSE '本行无取值' END"
    raw = t(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_AT} AS pos", f"{text} AS text")
    return extract.textual(segment.parse(raw)).select("doc_id", "param_id", "text_value", "line_no")


TEXT_PARAM_FIRST = """
WITH x AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) - 1 AS line_no, (l_linenumber + l_orderkey) % 3 = 0 AS hit,
  CASE l_returnflag WHEN 'A' THEN '一级' WHEN 'N' THEN '二级' ELSE '三级' END AS v FROM lineitem)
SELECT doc_id, 'dp.safety_grade' AS param_id, arg_min(v, line_no) AS text_value, CAST(min(line_no) AS INTEGER) AS line_no FROM x WHERE hit GROUP BY doc_id"""

# -- rules over facts

_EAV = ("li.quantity", "l_quantity"), ("li.discount", "l_discount"), ("li.tax", "l_tax")


def facts(spark, d) -> DataFrame:
    """Cards of orders: three numbers and a text for each item."""
    x = t(spark, d, "lineitem")
    number = [F.struct(F.lit(k).alias("param_id"), F.col(c).alias("value"), F.lit(None).cast("string").alias("text_value")) for k, c in _EAV]
    flag = F.struct(F.lit("li.flag").alias("param_id"), F.lit(None).cast("double").alias("value"), F.col("l_returnflag").alias("text_value"))
    out = x.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.expr(_AT).alias("at"), F.posexplode(F.array(*number, flag)).alias("k", "c"))
    line = F.struct(F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("line_text"), F.col("l_linenumber").alias("line_no"))  # with large keys _AT doesn't follow the item numbers
    return out.select("doc_id", (F.col("at") * 4 + F.col("k")).alias("ord"), "c.*", F.lit("").alias("unit"), line.alias("evidence"))


def cards_unpivot(spark, d):
    return facts(spark, d).select("doc_id", "ord", "param_id", "value", "text_value")


CARDS_UNPIVOT = "\nUNION ALL ".join(
    [f"SELECT l_orderkey AS doc_id, (l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) * 4 + {i} AS ord, '{k}' AS param_id, {c} AS value, CAST(NULL AS VARCHAR) AS text_value FROM lineitem" for i, (k, c) in enumerate(_EAV)]
    + ["SELECT l_orderkey, (l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) * 4 + 3, 'li.flag', CAST(NULL AS DOUBLE), l_returnflag FROM lineitem"]
)

RULES = (
    Rule("E-REQ", "required", "li.discount", ("URGENT", "HIGH")),
    Rule("E-MAX", "threshold_max", "li.quantity", op="<=", value=45, advice="got {value}, at most {limit}{unit}"),
    Rule("E-MIN", "threshold_min", "li.discount", op=">=", value=0.02),
    Rule("E-RNG", "within_range", "li.tax", min_value=0.01, max_value=0.07),
    Rule("E-ENUM", "enum", "li.flag", allowed=("A", "R")),
    Rule("E-COND", "conditional_program", "li.quantity", condition=(48, None), require_text="URGENT"),
    Rule("E-CHK", "checklist_section", "doc.sections", sections=(("F", ()), ("done", ("F", "P")))),
    Rule("E-UNK", "mystery", "li.tax"),
)


def _orders(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = t(spark, d, "orders")
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("line_no"), F.col("o_orderpriority").alias("text"))
    return o.select(F.col("o_orderkey").alias("doc_id")), lines, o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("title"))


def _findings(spark, d, *ids: str) -> DataFrame:
    docs, lines, titles = _orders(spark, d)
    return R.findings(facts(spark, d), tables.rules(spark, tuple(r for r in RULES if not ids or r.id in ids)), docs, lines, titles)


def rule_query(*ids: str):
    return lambda spark, d: _findings(spark, d, *ids).select("doc_id", "rule_id", "result", "detail", "advice", "evidence_line")


_NUM = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"


def _numeric_sql(rule: str, column: str, ok: str, detail: str, advice: str) -> str:
    x = "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END"
    return f"""
SELECT doc_id, '{rule}' AS rule_id, CASE WHEN n > 1 THEN 'manual' WHEN {ok} THEN 'pass' ELSE 'fail' END AS result,
  CASE WHEN n > 1 THEN '同一参数提取到 ' || CAST(n AS VARCHAR) || ' 个取值: ' || array_to_string(list_transform(vs, lambda x: {x}), '/') || '（疑似多出处冲突）' ELSE {detail} END AS detail,
  CASE WHEN n > 1 THEN '请人工确认以哪处原文为准。' WHEN {ok} THEN '' ELSE {advice} END AS advice, line AS evidence_line
FROM (SELECT l_orderkey AS doc_id, count(DISTINCT {column}) AS n, min({column}) AS v, list_sort(list(DISTINCT {column})) AS vs, 'item ' || CAST(min(l_linenumber) AS VARCHAR) AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"""


_LIMIT = lambda op, limit: f"'实测 ' || {_NUM} || '，要求 {op} {limit}'"
RULE_THRESHOLD = (
    _numeric_sql("E-MAX", "l_quantity", "v <= 45", _LIMIT("<=", "45"), f"'got ' || {_NUM} || ', at most 45'")
    + "\nUNION ALL"
    + _numeric_sql("E-MIN", "l_discount", "v >= 0.02", _LIMIT(">=", "0.02"), "'参数不满足要求，请复核并整改。'")
)
RULE_RANGE = _numeric_sql("E-RNG", "l_tax", "v BETWEEN 0.01 AND 0.07", f"'实测 ' || {_NUM} || '，要求区间 [0.01, 0.07]'", "'参数不满足要求，请复核并整改。'")
RULE_REQUIRED = """
WITH f AS (SELECT l_orderkey, arg_min(l_discount, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS v, min(l_linenumber) AS k FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS doc_id, 'E-REQ' AS rule_id, CASE WHEN k IS NULL THEN 'fail' ELSE 'pass' END AS result, CASE WHEN k IS NULL THEN '' ELSE '已提取: ' || CAST(v AS VARCHAR) || ' ' END AS detail,
  CASE WHEN k IS NULL THEN '未提取到该参数，请补充或人工确认。' ELSE '' END AS advice, CASE WHEN k IS NULL THEN '' ELSE 'item ' || CAST(k AS VARCHAR) END AS evidence_line
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey WHERE contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH')"""
RULE_ENUM = """
SELECT l_orderkey AS doc_id, 'E-ENUM' AS rule_id, CASE WHEN l_returnflag IN ('A', 'R') THEN 'pass' ELSE 'fail' END AS result,
  '取值「' || l_returnflag || CASE WHEN l_returnflag IN ('A', 'R') THEN '」在允许集合内' ELSE '」不在允许集合 A/R 内' END AS detail,
  CASE WHEN l_returnflag IN ('A', 'R') THEN '' ELSE '取值不在允许集合内，请复核。' END AS advice, 'item ' || CAST(l_linenumber AS VARCHAR) AS evidence_line
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
RULE_CONDITIONAL = """
SELECT o_orderkey AS doc_id, 'E-COND' AS rule_id, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'pass' ELSE 'fail' END AS result,
  '触发条件 ≥48，全文' || CASE WHEN contains(o_orderpriority, 'URGENT') THEN '存在' ELSE '未检出' END || '「URGENT」' AS detail,
  CASE WHEN contains(o_orderpriority, 'URGENT') THEN '' ELSE '请补充相应程序性材料。' END AS advice, '' AS evidence_line
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48)"""
RULE_CHECKLIST = """
SELECT o_orderkey AS doc_id, 'E-CHK' AS rule_id, CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END AS result,
  CASE o_orderstatus WHEN 'F' THEN '必备章节齐套（2 项）' WHEN 'P' THEN '缺少章节/内容: F' ELSE '缺少章节/内容: F、done' END AS detail,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE '请补齐专项方案必备章节。' END AS advice, '' AS evidence_line FROM orders"""


def rule_skipped(spark, d):
    docs, *_ = _orders(spark, d)
    rules, cards = tables.rules(spark, RULES), facts(spark, d)
    with_doc = R.skipped(cards, rules, docs, True).withColumn("with_document", F.lit(True))
    return with_doc.union(R.skipped(cards, rules, docs, False).withColumn("with_document", F.lit(False)))


RULE_SKIPPED = """
SELECT o_orderkey AS doc_id, rule_id, with_document FROM orders, (VALUES ('E-UNK', true), ('E-UNK', false), ('E-COND', false), ('E-CHK', false)) AS r(rule_id, with_document)"""

_ALL = f"SELECT doc_id, result FROM ({RULE_REQUIRED} UNION ALL {RULE_THRESHOLD} UNION ALL {RULE_RANGE} UNION ALL {RULE_ENUM} UNION ALL {RULE_CONDITIONAL} UNION ALL {RULE_CHECKLIST})"


def findings_summary(spark, d):
    docs, *_ = _orders(spark, d)
    return R.summary(_findings(spark, d), docs)


FINDINGS_SUMMARY = f"""
WITH f AS (SELECT doc_id, count(*) FILTER (result = 'pass') AS p, count(*) FILTER (result = 'fail') AS x, count(*) FILTER (result = 'manual') AS m FROM ({_ALL}) GROUP BY doc_id)
SELECT o_orderkey AS doc_id, coalesce(p, 0) AS n_pass, coalesce(x, 0) AS n_fail, coalesce(m, 0) AS n_manual, CASE WHEN x > 0 THEN '不合规' WHEN m > 0 THEN '待确认' ELSE '通过' END AS overall
FROM orders LEFT JOIN f ON doc_id = o_orderkey"""


def verdict_counts(spark, d):
    return findings_summary(spark, d).groupBy("overall").agg(F.count("*").alias("n_docs"), F.sum("n_fail").alias("n_fail"))


VERDICT_COUNTS = f"SELECT overall, count(*) AS n_docs, CAST(sum(n_fail) AS BIGINT) AS n_fail FROM ({FINDINGS_SUMMARY}) GROUP BY overall"


def missing_params(spark, d):
    docs = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    cards = t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "c.finished").otherwise("c.open").alias("param_id"))
    rules = tables.rules(spark, (Rule("C-1", "required", "c.finished"), Rule("C-2", "required", "c.open")))
    full = cards.selectExpr("doc_id", "0 AS ord", "param_id", "1D AS value", "'' AS unit", "CAST(NULL AS STRING) AS text_value", "named_struct('line_text', '') AS evidence")
    return R.missing_params(full, rules, docs)


MISSING_PARAMS = """
SELECT c_custkey AS doc_id, param FROM customer, (VALUES ('c.finished'), ('c.open')) AS p(param)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'F') = (param = 'c.finished'))"""


def findings_order(spark, d):
    """Report order of the first findings of each order: the feature's own limit of three."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("rank", "rule_id", "n")
    x = R.ranked(_findings(spark, d)).withColumn("place", F.row_number().over(w))
    return x.where("place <= 3").select("doc_id", "place", "rule_id", "result")


FINDINGS_ORDER = f"""
WITH f AS (SELECT doc_id, rule_id, result, 0 AS n FROM ({RULE_REQUIRED} UNION ALL {RULE_THRESHOLD} UNION ALL {RULE_RANGE} UNION ALL {RULE_CONDITIONAL} UNION ALL {RULE_CHECKLIST})
  UNION ALL SELECT doc_id, rule_id, result, CAST(substr(evidence_line, 6) AS INTEGER) FROM ({RULE_ENUM})),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE result WHEN 'fail' THEN 0 WHEN 'manual' THEN 1 ELSE 2 END, rule_id, n) AS place FROM f)
SELECT doc_id, CAST(place AS INTEGER) AS place, rule_id, result FROM r WHERE place <= 3"""

# -- knowledge


def tokens_tf(spark, d):
    return K.term_counts(t(spark, d, "benchmark"), "item_id", F.col("text"))


_TOKENS = "list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+(?:\\.[0-9]+)?'), lambda x: lower(x))"
TOKENS_TF = f"SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL"


def cjk_bigrams(spark, d):
    x = t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("基坑 "), "n_name", F.lit("，开挖5.4m深")).alias("s"))
    return x.select("n_nationkey", F.explode(T.tokens(F.col("s"))).alias("token"))


CJK_BIGRAMS = f"SELECT n_nationkey, unnest(list_concat(['基坑', '坑开', '开挖', '挖深'], {_TOKENS.format("'基坑 ' || n_name || '，开挖5.4m深'")})) AS token FROM nation"


def cosine_topk(spark, d):
    q = K.term_counts(t(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", F.col("text"))
    b = K.term_counts(t(spark, d, "documents").withColumnRenamed("doc_id", "block_id"), "block_id", F.col("text"), together=True)
    scored = K.cosine(q, b).withColumn("score", F.round("score", 9))
    return K.top(scored, 5).select("query_id", "block_id", "rank", "score")


COSINE_TOPK = f"""
WITH q AS (SELECT query_id, token, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL),
b AS (SELECT block_id, token, count(*) AS n FROM (SELECT doc_id AS block_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL),
dots AS (SELECT query_id, block_id, sum(q.n * b.n) AS dot FROM q JOIN b USING (token) GROUP BY ALL),
qq AS (SELECT query_id, sum(n * n) AS qq FROM q GROUP BY ALL), bb AS (SELECT block_id, sum(n * n) AS bb FROM b GROUP BY ALL),
s AS (SELECT query_id, block_id, round(CAST(dot AS DOUBLE) / (sqrt(CAST(qq AS DOUBLE)) * sqrt(CAST(bb AS DOUBLE))), 9) AS score FROM dots JOIN qq USING (query_id) JOIN bb USING (block_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS rank FROM s)
SELECT query_id, block_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 5"""

#: Thresholds whose keywords occur in the test conversations, so that scores, ties and misses all happen.
THRESHOLDS = [
    {"id": "T-1", "name": "one", "op": ">=", "value": 3, "unit": "m", "keywords": ["tion", "heon"], "doc": "A", "article_no": "1", "status": "ok"},
    {"id": "T-2", "name": "two", "op": "info", "value": "as agreed", "keywords": ["heon", "tion"], "doc": "B", "article_no": "2", "status": "ok"},
    {"id": "T-3", "name": "three", "op": "range", "value": [2, 5], "keywords": ["the", "ing", "ent"], "doc": "C", "article_no": "3", "status": "ok"},
    {"id": "T-4", "name": "four", "op": "enum", "value": ["x", "y"], "keywords": ["que", "ción", ""], "doc": "D", "article_no": "4", "status": "ok"},
]


def _questions(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


def threshold_match(spark, d):
    return K.match_threshold(_questions(spark, d), tables.thresholds(spark, THRESHOLDS)).select("query_id", "id", "score")


_SCORED = "\nUNION ALL ".join(
    f"SELECT query_id, '{x['id']}' AS id, {i} AS pos, " + " + ".join(f"CASE WHEN contains(question, '{k}') THEN {len(k)} ELSE 0 END" for k in x["keywords"] if k) + " AS score FROM q" for i, x in enumerate(THRESHOLDS)
)
_QUESTIONS = "q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user')"
THRESHOLD_MATCH = f"""
WITH {_QUESTIONS}, s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM s WHERE score >= 4)
SELECT query_id, id, CAST(score AS INTEGER) AS score FROM r WHERE k = 1"""


def ask_route(spark, d):
    """Route, whole answer and number of sources of every question."""
    passages = t(spark, d, "benchmark").selectExpr("CAST(item_id AS STRING) AS block_id", "'D' AS doc", "'' AS chapter", "CAST(item_id AS STRING) AS article_no", "text", "array() AS tags", "'ok' AS status")
    out = K.ask(_questions(spark, d), tables.thresholds(spark, THRESHOLDS), passages.withColumn("tags", F.array().cast("array<string>")))
    return out.select("query_id", "route", F.md5("answer").alias("answer_md5"), F.size("sources").alias("n_sources"))


_SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"T-1": "one：要求 3m。\n依据：A 1\n", "T-2": "two：要求：as agreed。\n依据：B 2\n", "T-3": "three：要求 2～5。\n依据：C 3\n", "T-4": "four：允许取值：x～y。\n依据：D 4\n"}.items())
ASK_ROUTE = f"""
WITH {_QUESTIONS}, s AS ({_SCORED}), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM s WHERE score >= 4),
hit AS (SELECT query_id, '【阈值表命中·ok】' || CASE id {_SAID} END AS answer FROM best WHERE k = 1),
qt AS (SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest({_TOKENS.format('question')}) AS token FROM q) GROUP BY ALL),
bt AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL),
qq AS (SELECT query_id, sum(n * n) AS qq FROM qt GROUP BY ALL), bb AS (SELECT item_id, sum(n * n) AS bb FROM bt GROUP BY ALL),
dots AS (SELECT query_id, item_id, sum(qt.n * bt.n) AS dot FROM qt JOIN bt USING (token) GROUP BY ALL),
near AS (SELECT query_id, item_id, CAST(dot AS DOUBLE) / (sqrt(CAST(qq AS DOUBLE)) * sqrt(CAST(bb AS DOUBLE))) AS score FROM dots JOIN qq USING (query_id) JOIN bb USING (item_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(item_id AS VARCHAR)) AS k FROM near),
line AS (SELECT query_id, k, '- 《D》 ' || CASE WHEN regexp_matches(CAST(item_id AS VARCHAR), '^[0-9]') THEN '第' || item_id || '条' ELSE CAST(item_id AS VARCHAR) END || '（ok）：' || text || '（相关度 ' || printf('%.2f', floor(score * 100 + 0.5) / 100) || '）' AS l
         FROM top JOIN benchmark USING (item_id) WHERE k <= 3),
passages AS (SELECT query_id, count(*) AS n, '【条文检索 top-' || count(*) || '】\n' || string_agg(l, '\n' ORDER BY k) || '\n{K.CLOSING}' AS answer FROM line GROUP BY query_id)
SELECT query_id, CASE WHEN h.query_id IS NOT NULL THEN 'threshold' WHEN n > 0 THEN 'blocks' ELSE 'empty' END AS route, md5(coalesce(h.answer, p.answer, '{K.NOTHING}')) AS answer_md5,
  CAST(CASE WHEN h.query_id IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS INTEGER) AS n_sources
FROM q LEFT JOIN hit h USING (query_id) LEFT JOIN passages p USING (query_id)"""


def search_order(spark, d):
    """Passages with equal scores come by document, article, place."""
    x = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    blocks = x.selectExpr("CAST(n_nationkey AS STRING) AS block_id", "left(n_name, 1) AS doc", "CAST(n_nationkey % 2 AS STRING) AS article_no", "concat(replace(r_name, ' ', ''), ' common') AS text", "array('x1') AS tags")
    questions = t(spark, d, "region").selectExpr("r_regionkey AS query_id", "replace(r_name, ' ', '') AS question")
    return K.search(questions, blocks, 4).select("query_id", "block_id", "rank", F.round("score", 9).alias("score"))


SEARCH_ORDER = """
SELECT r_regionkey AS query_id, block_id, CAST(rank AS INTEGER) AS rank, round(1 / sqrt(3.0::DOUBLE), 9) AS score FROM (
  SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS block_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name[1], CAST(n_nationkey % 2 AS VARCHAR), CAST(n_nationkey AS VARCHAR)) AS rank FROM nation) WHERE rank <= 4"""


def embedding_cosine(spark, d):
    e = t(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    return e.join(first, "label").select("vec_id", "label", F.round(K.dense_cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))


EMBEDDING_COSINE = """
WITH f AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS c FROM embeddings GROUP BY label)
SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS score FROM embeddings e JOIN f USING (label)"""

# -- scanner


def pii_hits(spark, d):
    return scan.hits(t(spark, d, "documents"), "doc_id")


def _hits_sql(table: str, key: str) -> str:
    runs = lambda p, full: f"list_filter(regexp_extract_all(line, '{p}'), lambda x: regexp_full_match(x, '{full}'))"
    assign = r"(?i)(?:^|[^A-Za-z0-9])(api[_-]?key|secret|password|passwd|token|access[_-]?key)\s*[:=]\s*[\"'']?([^\s\"''#,;]{8,})"
    path = r"(?:^|[^\w.])[A-Za-z]:[\\/]+Users[\\/]+([^\s\\/''\"`(),;、。，（）]+)"
    kinds = [
        ("email", f"list_filter(regexp_extract_all(line, '{scan.EMAIL}'), lambda x: NOT regexp_matches(x, '{scan.EMAIL_ALLOWED}'))"),
        ("phone", runs("[0-9]+", "1[3-9][0-9]{9}")),
        ("id_card", runs("[0-9]+[Xx]?", "[0-9]{17}[0-9Xx]")),
        ("private_ip", runs("[0-9.]+", r"192\.168\.[0-9]{1,3}\.[0-9]{1,3}|10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}")),
        ("secret_sk", f"regexp_extract_all(line, '{scan.SECRET_KEY}')"),
        ("secret_assign", f"list_transform(list_filter(list_zip(regexp_extract_all(line, '{assign}', 1), regexp_extract_all(line, '{assign}', 2)), lambda z: NOT regexp_matches(z[2], '{scan.CODE}')), lambda z: z[1])"),
        ("personal_path", f"list_filter(regexp_extract_all(line, '{path}', 1), lambda u: NOT regexp_matches(u, '^[<%{{$`\\[]') AND NOT list_contains({list(scan.PLACEHOLDERS)!r}, lower(u)))"),
    ]
    every = "list_concat(" * (len(kinds) - 1) + ", ".join(
        f"list_transform({e}, lambda y: {{'kind': '{k}', 'excerpt': y}})" + (")" if i else "") for i, (k, e) in enumerate(kinds)
    )
    return f"""
WITH l AS (SELECT {key}, generate_subscripts(a, 1) AS lineno, unnest(a) AS line FROM (SELECT {key}, string_split(text, chr(10)) AS a FROM {table})),
h AS (SELECT {key}, lineno, {every} AS hs FROM l),
x AS (SELECT {key}, lineno, generate_subscripts(hs, 1) - 1 AS n, unnest(hs) AS e FROM h)
SELECT {key}, CAST(lineno AS INTEGER) AS lineno, CAST(n AS INTEGER) AS n, e.kind AS kind, e.excerpt AS excerpt FROM x"""


PII_HITS = _hits_sql("documents", "doc_id")


def pii_by_kind(spark, d):
    return scan.hits(t(spark, d, "documents"), "doc_id").groupBy("kind").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


PII_BY_KIND = f"SELECT kind, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM ({PII_HITS}) GROUP BY kind"


#: A line for each detector, put together so that this text holds none, and two that are allowed.
_HITS = (
    "'call 138' || '0000' || right(CAST(10000 + conv_id % 10000 AS VARCHAR(9)), 4)", "'id 110101' || '19900101' || '123X'", "'host 10.' || '1.2.' || CAST(conv_id % 256 AS VARCHAR(9))", "'s' || 'k-abcdefgh' || CAST(conv_id AS VARCHAR(9))",
    "'pass' || 'word: hunter' || CAST(conv_id + 1000 AS VARCHAR(9))", "'D:/' || 'Users/u' || CAST(conv_id AS VARCHAR(9)) || '/x'", "'mail u' || CAST(conv_id AS VARCHAR(9)) || '@' || 'b-c.net'",
    "'token = ' || 'config.get(1)'", "'C:/' || 'Users/xx/y and a@' || 'example.org'",
)
_PLANTED = "text || chr(10) || CASE conv_id % 9 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_HITS)) + " END"


def pii_conversations(spark, d):
    """Hits of all seven detectors in conversations, a planted line each."""
    x = t(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS place", f"{_PLANTED} AS text")
    return scan.hits(x, "place")


PII_CONVERSATIONS = _hits_sql(f"(SELECT conv_id * 1000 + turn AS place, {_PLANTED} AS text FROM conversations)", "place")


def commit_hits(spark, d):
    """Addresses of distinct pairs that aren't the forge's own."""
    who = "concat('c', o_custkey, CASE WHEN o_custkey % 3 = 0 THEN '@Users.NoReply.github.com' ELSE '@firm.net' END)"
    return scan.commit_hits(t(spark, d, "orders").selectExpr(f"{who} AS author", "concat(o_orderstatus, '@x.org') AS committer")).distinct()


COMMIT_HITS = """
SELECT DISTINCT 'author' AS role, 'c' || o_custkey || '@firm.net' AS address FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT DISTINCT 'committer', o_orderstatus || '@x.org' FROM orders"""


def crlf_docs(spark, d):
    x = t(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")))
    return scan.crlf(x, "doc_id")


CRLF_DOCS = "SELECT doc_id FROM documents WHERE doc_id % 50 = 0 AND contains(text, chr(10))"

# -- gap filling


def _missing(spark, d):
    return t(spark, d, "documents").select("doc_id", F.lit("dp.excavation_depth").alias("param"))


def _lines(spark, d):
    return segment.lines(segment.raw_lines(t(spark, d, "documents")))


def gap_candidates(spark, d):
    return gapfill.candidates(_lines(spark, d), _missing(spark, d)).select("doc_id", "line_no", F.length("text").alias("n"))


GAP_CANDIDATES = f"""
WITH l AS ({LINES_OFFSETS.replace('md5(l) AS line_md5', 'l')}), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(l, '[0-9]'))
SELECT doc_id, line_no, CAST(length(l) AS INTEGER) AS n FROM c WHERE k <= 120"""


def _validated(spark, d):
    offered = gapfill.candidates(_lines(spark, d), _missing(spark, d))
    param = "CASE doc_id % 4 WHEN 0 THEN 'fs.pole.spacing' ELSE 'dp.excavation_depth' END"
    excerpt = "CASE line_no % 3 WHEN 0 THEN substring(text, 1, 5) WHEN 1 THEN 'not there' ELSE substring(text, 2, 6) END"
    items = offered.selectExpr("doc_id", "line_no AS n", f"{param} AS param", "CAST(line_no + CASE WHEN line_no % 5 = 4 THEN 100000 ELSE 0 END AS INT) AS line_no", f"{excerpt} AS excerpt", "CAST(line_no * 20 AS DOUBLE) AS value", "CAST(NULL AS STRING) AS text_value")
    return gapfill.validate(items, _missing(spark, d), offered)


def gap_validate(spark, d):
    return _validated(spark, d).select("doc_id", "n", "param", "value", "reason")


GAP_VALIDATE = f"""
WITH l AS ({LINES_OFFSETS.replace('md5(l) AS line_md5', 'l')}), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(l, '[0-9]')),
i AS (SELECT doc_id, line_no AS n, CASE doc_id % 4 WHEN 0 THEN 'fs.pole.spacing' ELSE 'dp.excavation_depth' END AS param, line_no % 5 <> 4 AS known, l,
  regexp_replace(CASE line_no % 3 WHEN 0 THEN substring(l, 1, 5) WHEN 1 THEN 'not there' ELSE substring(l, 2, 6) END, '^\\s+|\\s+$', '', 'g') AS e, CAST(line_no * 20 AS DOUBLE) AS value FROM c WHERE k <= 120)
SELECT doc_id, n, param, value, CASE WHEN param <> 'dp.excavation_depth' THEN 'param 不在缺失清单' WHEN NOT known THEN 'line_no 无效' WHEN e = '' OR NOT contains(l, e) THEN '摘录不是原文子串（防幻觉拦截）'
  WHEN NOT (value > 0 AND value <= 50) THEN '数值超出物理合理范围' END AS reason FROM i"""



def gap_cards(spark, d):
    """The first valid item of each parameter as a card, after the document's own."""
    lines = segment.parse(segment.raw_lines(t(spark, d, "documents"))).drop("level")
    checked = _validated(spark, d).withColumn("unit", F.lit("m"))
    return gapfill.cards(gapfill.accept(checked), lines).select("doc_id", "ord", "param_id", "name", "value", "raw_text", "source", "confidence", F.md5("evidence.line_text").alias("line_md5"))


GAP_CARDS = f"""
WITH v AS ({GAP_VALIDATE.replace('SELECT doc_id, n, param, value, CASE', 'SELECT doc_id, n, param, value, e, l, CASE')}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, param ORDER BY n) AS k FROM v WHERE reason IS NULL)
SELECT doc_id, CAST(1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS ord, param AS param_id, '基坑开挖深度' AS name, value, left(e0, 60) AS raw_text, 'llm' AS source, CAST(0.6 AS DOUBLE) AS confidence, md5(l) AS line_md5
FROM (SELECT *, CASE n % 3 WHEN 0 THEN substring(l, 1, 5) WHEN 1 THEN 'not there' ELSE substring(l, 2, 6) END AS e0 FROM f WHERE k = 1)"""


def gap_prompts(spark, d):
    missing = _missing(spark, d)
    return gapfill.prompts(gapfill.candidates(_lines(spark, d), missing), missing).select("doc_id", F.md5("prompt").alias("prompt_md5"))


GAP_PROMPTS = f"""
WITH l AS ({LINES_OFFSETS.replace('md5(l) AS line_md5', 'l')}), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(l, '[0-9]'))
SELECT doc_id, md5('{gapfill.HEAD}\n文档：' || doc_id || '\n\n目标参数（可能一个也抽不到）：\n{gapfill.described()["dp.excavation_depth"]}\n\n原文行（行号: 内容）：\n' || string_agg('  ' || line_no || ': ' || l, '\n' ORDER BY line_no) || '\n\n{gapfill.FOOT}') AS prompt_md5
FROM c WHERE k <= 120 GROUP BY doc_id"""

# -- evaluation


def eval_prf(spark, d):
    labels, docs = t(spark, d, "labels"), t(spark, d, "documents")
    truth = labels.selectExpr("doc_id", "'quality' AS param", "CAST(quality AS DOUBLE) AS num", "CAST(NULL AS STRING) AS txt").union(labels.selectExpr("doc_id", "'toxic'", "CAST(NULL AS DOUBLE)", "CAST(toxic AS STRING)"))
    x = docs.join(labels.select("doc_id"), "doc_id")
    got = x.selectExpr("doc_id", "'quality' AS param", "CASE WHEN n_chars >= 300 THEN 1D ELSE 0D END AS num", "CAST(NULL AS STRING) AS txt").union(x.where("n_chars > 100").selectExpr("doc_id", "'toxic'", "CAST(NULL AS DOUBLE)", "CASE WHEN contains(text, 'idiot') THEN '1' ELSE '0' END"))
    out = E.prf(E.matched(truth, got))
    return out.select("param", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_EVAL = """
WITH x AS (SELECT d.doc_id, quality, toxic, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS q, CASE WHEN n_chars > 100 THEN CASE WHEN contains(text, 'idiot') THEN 1 ELSE 0 END END AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT 'quality' AS param, count(*) FILTER (q = quality) AS tp, count(*) FILTER (q <> quality) AS fp, count(*) FILTER (q <> quality) AS fn FROM x
  UNION ALL SELECT 'toxic', count(*) FILTER (t = toxic), count(*) FILTER (t <> toxic), count(*) FILTER (t IS NULL OR t <> toxic) FROM x),
s AS (SELECT * FROM m UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM m),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS re FROM s)
"""
EVAL_PRF = _EVAL + "SELECT param, tp, fp, fn, round(CAST(pr AS DOUBLE), 9) AS precision, round(CAST(re AS DOUBLE), 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1 FROM p"


def eval_close(spark, d):
    """Large numbers that differ by a small share match, others don't."""
    o = t(spark, d, "orders")
    none = "CAST(NULL AS STRING) AS txt"
    truth = o.selectExpr("o_orderkey AS doc_id", "o_orderstatus AS param", "o_totalprice * 1e6 AS num", none)
    got = o.selectExpr("o_orderkey AS doc_id", "o_orderstatus AS param", "o_totalprice * 1e6 * CASE o_orderkey % 3 WHEN 0 THEN 1 + 1e-10 WHEN 1 THEN 1 + 1e-7 ELSE 1 END AS num", none)
    return E.prf(E.matched(truth, got)).select("param", "tp", "fp", "fn")


EVAL_CLOSE = """
WITH m AS (SELECT o_orderstatus AS param, count(*) FILTER (o_orderkey % 3 <> 1) AS tp, count(*) FILTER (o_orderkey % 3 = 1) AS f FROM orders GROUP BY 1)
SELECT param, tp, f AS fp, f AS fn FROM m UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(f) AS BIGINT), CAST(sum(f) AS BIGINT) FROM m"""


def _expected(spark, d):
    x = t(spark, d, "labels").where("toxic = 1").join(t(spark, d, "documents"), "doc_id")
    return x.selectExpr("doc_id", "0 AS inj_no", "lang AS type", "'R-TOX' AS rule_id", "'fail' AS result")


def _flagged(spark, d):
    return t(spark, d, "documents").where("contains(text, 'idiot') OR contains(text, 'scum')").selectExpr("doc_id", "'R-TOX' AS rule_id", "'fail' AS result")


def detection_rate(spark, d):
    out = E.detection_rate(E.detections(_expected(spark, d), _flagged(spark, d)))
    return out.withColumn("rate", F.round("rate", 9))


DETECTION_RATE = """
WITH x AS (SELECT lang AS type, contains(text, 'idiot') OR contains(text, 'scum') AS hit FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1),
s AS (SELECT type, count(*) FILTER (hit) AS hits, count(*) AS total FROM x GROUP BY ROLLUP (type))
SELECT type, hits, total, round(CASE WHEN total = 0 THEN 1.0 ELSE CAST(hits AS DOUBLE) / total END, 9) AS rate FROM s"""


def false_positives(spark, d):
    return E.false_positives(_flagged(spark, d), _expected(spark, d))


FALSE_POSITIVES = """
SELECT doc_id, 'R-TOX' AS rule_id, 'fail' AS result FROM documents WHERE (contains(text, 'idiot') OR contains(text, 'scum')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""


def _corpus(spark) -> tuple[benchmark.Corpus, V.Review]:
    """30 pit and 10 formwork plans and their review."""
    c = benchmark.generated(spark)
    return c, V.review(c.raw, tables.rules(spark), c.docs)


def corpus_prf(spark, d):
    c, r = _corpus(spark)
    got = r.cards.selectExpr("doc_id", "param_id AS param", "value AS num", "text_value AS txt")
    return E.prf(E.matched(c.truth, got)).selectExpr("param", "tp", "fp", "fn", "CAST(f1 AS DOUBLE) AS f1")


#: What the plans say, from their numbers alone: defects, and for each parameter how many values.
_PLANS = """
pit AS (SELECT i, ['over_disp', 'low_freq', 'multi_disp', 'unit_error', 'missing_section'] AS k, [k[i % 5 + 1], k[(i + 16) % 5 + 1]] AS has FROM range(30) AS r(i)),
form AS (SELECT i, ['over_height', 'low_spacing', 'multi_height', 'unit_error', 'missing_section'] AS k, [k[i % 5 + 1], k[(i + 6) % 5 + 1]] AS has, round(5.5 + (i * 7 % 21) / 10.0, 1) AS h FROM range(10) AS r(i))"""
CORPUS_PRF = f"""
WITH {_PLANS},
n AS (SELECT 'dp.excavation_depth' AS param, count(*) FILTER (NOT list_contains(has, 'unit_error')) AS tp FROM pit UNION ALL SELECT 'dp.monitoring.frequency', count(*) FROM pit UNION ALL SELECT 'dp.safety_grade', count(*) FROM pit
  UNION ALL SELECT 'dp.support_type', count(*) FROM pit UNION ALL SELECT 'dp.retaining.displacement', count(*) + count(*) FILTER (list_contains(has, 'multi_disp')) FROM pit
  UNION ALL SELECT 'fs.formwork.type', count(*) FROM form UNION ALL SELECT 'fs.pole.spacing', count(*) FILTER (NOT list_contains(has, 'unit_error')) FROM form
  UNION ALL SELECT 'fs.support.height', count(*) + count(*) FILTER (list_contains(has, 'multi_height') AND NOT list_contains(has, 'over_height') AND least(7.8, round(h + 1, 1)) <> h) FROM form),
s AS (SELECT param, tp FROM n UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT) FROM n)
SELECT param, tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(1.0 AS DOUBLE) AS f1 FROM s"""
#: The defects that show: a second value hides an excess, an excess drops a second height.
_SHOWN = """
shown AS (SELECT i AS doc_id, false AS fs, unnest(has) AS type, has FROM pit UNION ALL SELECT 30 + i, true, unnest(has), has FROM form),
seen AS (SELECT DISTINCT doc_id, fs, type FROM shown WHERE NOT (type = 'over_disp' AND list_contains(has, 'multi_disp')) AND NOT (type = 'multi_height' AND list_contains(has, 'over_height')))"""


def corpus_detection(spark, d):
    c, r = _corpus(spark)
    return E.detection_rate(E.detections(c.expected, r.findings)).select("type", "hits", "total")


CORPUS_DETECTION = f"WITH {_PLANS}, {_SHOWN} SELECT type, count(*) AS hits, count(*) AS total FROM seen GROUP BY ROLLUP (type)"


def corpus_false_positives(spark, d):
    """Every finding of the corpus that isn't a pass, and whether a defect explains it."""
    c, r = _corpus(spark)
    wrong = r.findings.where("result != 'pass'").select("doc_id", "rule_id", "result").distinct()
    return wrong.join(c.expected.select("doc_id", "rule_id", "result", F.lit(True).alias("_e")).distinct(), ["doc_id", "rule_id", "result"], "left").select("doc_id", "rule_id", "result", F.coalesce("_e", F.lit(False)).alias("explained"))


_GIVES = "VALUES " + ", ".join(
    f"('{k.removeprefix('fs:')}', {str(k.startswith('fs:') or k in synth.FORMWORK_DEFECTS[:3]).lower()}, '{r}', '{x}')" for k, v in synth.EXPECTED.items() for r, x in v
)
CORPUS_FALSE_POSITIVES = f"WITH {_PLANS}, {_SHOWN} SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, rule_id, result, true AS explained FROM seen JOIN ({_GIVES}) AS g(type, fs, rule_id, result) USING (type, fs)"

# -- inventory, JSON, logs


def inventory_by_category(spark, d):
    n = t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    said = F.expr("listagg(concat(p_brand, ' ', n), '、') WITHIN GROUP (ORDER BY n DESC, p_brand)")
    return n.groupBy("p_size").agg(said.alias("brands"), F.sum("n").alias("n_parts"))


INVENTORY_BY_CATEGORY = """
WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_size, string_agg(p_brand || ' ' || CAST(n AS VARCHAR), '、' ORDER BY n DESC, p_brand) AS brands, CAST(sum(n) AS BIGINT) AS n_parts FROM n GROUP BY p_size"""


def json_value_variant(spark, d):
    v = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return t(spark, d, "events").select("event_id", "event_type", v.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


JSON_VALUE_VARIANT = "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"


def log_resume(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("r")).select("user_id", "r.*")


LOG_RESUME = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


_MADE = """
SELECT CAST(p_partkey AS {text}) AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'threshold_max' WHEN 2 THEN 'within_range' WHEN 3 THEN 'enum' ELSE 'conditional_program' END AS check_type, 'p' AS param,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS basis, CASE WHEN p_size % 17 = 0 THEN 'x' ELSE '强制' END AS level, CASE WHEN p_size % 19 = 0 THEN 'x' WHEN p_size % 2 = 0 THEN 'error' ELSE 'info' END AS severity,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE '<=' END AS op, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 1.0 END AS min_value,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE 9.0 END AS max_value, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'a' END AS one_allowed, CASE WHEN p_size % 8 = 0 THEN NULL ELSE 5.0 END AS low, CASE WHEN p_size % 9 = 0 THEN '' ELSE 'text' END AS require_text,
  p_partkey % 4 <> 0 AS enabled FROM {part}"""


def _made_rules(spark, d):
    """Rules out of parts, with every kind of fault."""
    t(spark, d, "part").createOrReplaceTempView("_made_part")
    x = spark.sql(_MADE.format(text="STRING", part="_made_part"))
    return x.withColumns({
        "allowed": F.when(F.col("one_allowed").isNotNull(), F.array("one_allowed")), "condition": F.when(F.col("low").isNotNull(), F.struct(F.col("low").alias("min"), F.lit(None).cast("double").alias("max"))),
        "sections": F.lit(None).cast("array<struct<title:string,keywords:array<string>>>"),
    })


def rule_violations(spark, d):
    return R.violations(_made_rules(spark, d))


RULE_VIOLATIONS = f"""
SELECT id, CASE WHEN name = '' OR coalesce(basis, '') = '' THEN 'missing field' WHEN check_type = 'threshold_max' AND (op IS NULL OR value IS NULL) THEN 'threshold without op or value'
  WHEN check_type = 'within_range' AND min_value IS NULL AND max_value IS NULL THEN 'range without limits' WHEN check_type = 'enum' AND one_allowed IS NULL THEN 'enum without values'
  WHEN check_type = 'conditional_program' AND (low IS NULL OR require_text = '') THEN 'condition or text missing' WHEN level = 'x' THEN 'unknown level' WHEN severity = 'x' THEN 'unknown severity' END AS reason
FROM ({_MADE.format(text='VARCHAR', part='part')}) WHERE reason IS NOT NULL"""


def rule_inventory(spark, d):
    """Enabled rules that can be used, by type and severity."""
    made = _made_rules(spark, d)
    return made.where("enabled").join(R.violations(made).select("id"), "id", "left_anti").groupBy("check_type", "severity").agg(F.count("*").alias("n"))


RULE_INVENTORY = f"SELECT check_type, severity, count(*) AS n FROM ({_MADE.format(text='VARCHAR', part='part')}) WHERE enabled AND id NOT IN (SELECT id FROM ({RULE_VIOLATIONS})) GROUP BY ALL"


def rule_enabled(spark, d):
    """A disabled rule gives no finding; the exit code of each document."""
    docs, lines, titles = _orders(spark, d)
    some = [r for r in RULES if r.id in ("E-MAX", "E-REQ")]
    found = R.findings(facts(spark, d), tables.rules(spark, tuple(replace(r, enabled=r.id != "E-REQ") for r in some)), docs, lines, titles)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("result") == "fail").cast("int")).alias("exit_code"))


RULE_ENABLED = """
SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS n, CAST(count(DISTINCT l_quantity) = 1 AND min(l_quantity) > 45 AS INTEGER) AS exit_code FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"""


def rule_overdue(spark, d):
    x = t(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE date_format(add_months(CAST(o_orderdate AS DATE), 12), 'yyyy-MM-dd') END AS next_review")
    return R.overdue(x, "1996-06-01")


RULE_OVERDUE = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) AS next_review FROM orders WHERE o_orderkey % 7 <> 0 AND CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH < DATE '1996-06-01'"""
