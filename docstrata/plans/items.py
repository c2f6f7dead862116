"""Queries on audit items: orders are reports with their facts; customers are reports whose pages are their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import audit as A
from docstrata.plans.extraction import _TABLES, _tables
from docstrata.plans.registry import register
from docstrata.sources.tables import table

#: Facts of an order as a report, as SQL for Spark and DuckDB.
_FACTS = {
    "kind": "CASE WHEN o_orderpriority LIKE '1%' THEN '报告书' WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderpriority LIKE '4%' AND o_orderstatus = 'F' THEN '登记表' ELSE '报告表' END",
    "found": "o_totalprice > 30000",
    "tier": "CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_totalprice > 250000 THEN '报告书' WHEN o_totalprice > 120000 THEN '报告表' ELSE '登记表' END",
    "exception": "CASE WHEN o_custkey % 7 = 0 THEN 'unknown' ELSE 'none' END",
    "near": "CASE WHEN o_custkey % 5 < 2 THEN true WHEN o_custkey % 5 < 4 THEN false END",
    "direct": "CASE WHEN o_orderstatus = 'O' THEN false WHEN o_custkey % 3 = 0 THEN NULL ELSE true END",
    "tanker": "o_orderkey % 11 = 0",
    "groundwater": "CASE WHEN o_custkey % 4 = 1 THEN true WHEN o_custkey % 4 = 2 THEN false END",
    "river": "CASE WHEN o_orderkey % 5 = 1 THEN true WHEN o_orderkey % 5 < 4 THEN false END",
    "habitat": "CASE WHEN o_custkey % 3 = 1 THEN true WHEN o_custkey % 3 = 2 THEN false END",
    "sea": "CASE WHEN o_orderkey % 9 = 2 THEN true WHEN o_orderkey % 9 > 5 THEN false END",
    "risk": "CASE WHEN o_totalprice > 300000 THEN true WHEN o_totalprice > 60000 THEN false END",
    "project": "CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN '港口扩建' ELSE o_orderpriority END",
    "intake": "o_orderkey % 2 = 0",
    "water": "CASE WHEN o_custkey % 13 = 0 THEN 'standard' WHEN o_custkey % 13 = 1 THEN 'weak' END",
    "exceeds": "o_orderkey % 8 = 0",
    "stated_any": "o_custkey % 9 > 0",
    "risk_rows": "o_orderkey % 6",
    "risk_unknown": "o_orderkey % 3",
    "limit_rows": "o_custkey % 5",
    "limit_wrong": "CASE WHEN o_custkey % 5 > 2 THEN o_orderkey % 2 ELSE 0 END",
    "limit_all_unknown": "o_orderkey % 7 = 0",
    "limit_right": "o_orderkey % 5",
    "q_rows": "o_custkey % 4",
    "q_stated": "o_orderkey % 3 > 0",
    "q_below": "o_totalprice < 40000",
    "q_differs": "o_totalprice > 200000",
    "potential": "o_orderkey % 4 > 0",
    "potential_fits": "o_custkey % 2 = 0",
    "targets": "CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'row' WHEN 2 THEN 'caption' END",
    "targets_full": "o_custkey % 3 > 0",
    "lacks": "o_orderkey % 3",
    "wrong": "o_custkey % 2",
    "stale": "o_orderkey % 2",
    "official": "o_custkey % 3 = 0",
    "conclusion": "nullif(o_orderkey % 5, 0)",
    "verdict": "CASE WHEN o_custkey % 2 = 0 THEN '可行' END",
}
_STATED = "CASE WHEN (o_orderkey + e) % 4 = 0 THEN false WHEN (o_orderkey + e) % 4 = 1 THEN true END"
_SHOWN = "(o_custkey + e) % 3 > 0"
_POLLUTANTS = "CASE WHEN o_custkey % 8 = 0 THEN NULL WHEN o_custkey % 8 = 1 THEN {empty} ELSE {some} END"
_LISTED = "CASE WHEN o_custkey % 8 > 4 THEN {some} ELSE {empty} END"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"empty": "cast(array() AS array<string>)", "some": "array('甲苯')"}
    o = table(spark, sf_dir, "orders")
    return o.select("*", *[F.expr(x).alias(c) for c, x in _FACTS.items()], F.expr(_POLLUTANTS.format(**lists)).alias("pollutants"), F.expr(_LISTED.format(**lists)).alias("listed"))


_ORDERS = f"""f AS (SELECT *, {", ".join(f"{x} AS {c}" for c, x in _FACTS.items())}, o_custkey % 8 > 1 AS has_pollutants, o_custkey % 8 > 4 AS has_listed FROM orders)"""
_VERDICTS = """v AS (
  SELECT o_orderkey, 0 AS e, '大气' AS element, CASE WHEN NOT has_pollutants OR has_listed AND near IS NULL THEN 'unknown' ELSE 'decided' END AS status, has_listed AND coalesce(near, false) AS wanted,
    CASE WHEN NOT has_pollutants THEN 'no pollutants' WHEN NOT has_listed THEN 'not listed' WHEN near IS NULL THEN 'near unknown' WHEN near THEN 'listed and near' ELSE 'listed, not near' END AS reason FROM f UNION ALL
  SELECT o_orderkey, 1, '地表水', CASE WHEN direct IS NULL THEN 'unknown' ELSE 'decided' END, coalesce(direct, false) AND NOT tanker, CASE WHEN direct IS NULL THEN 'unknown' WHEN direct AND NOT tanker THEN 'direct' ELSE 'not direct' END FROM f UNION ALL
  SELECT o_orderkey, 2, '地下水', CASE WHEN groundwater IS NULL THEN 'unknown' ELSE 'decided' END, coalesce(groundwater, false), CASE WHEN groundwater IS NULL THEN 'unknown' WHEN groundwater THEN 'protected' ELSE 'not protected' END FROM f UNION ALL
  SELECT o_orderkey, 3, '生态', CASE WHEN river IS NULL OR river AND habitat IS NULL THEN 'unknown' ELSE 'decided' END, coalesce(river AND habitat, false), CASE WHEN river AND habitat THEN 'intake and habitat' WHEN NOT river THEN 'no intake' ELSE 'no habitat known' END FROM f UNION ALL
  SELECT o_orderkey, 4, '海洋', CASE WHEN sea IS NULL THEN 'unknown' ELSE 'decided' END, coalesce(sea, false), CASE WHEN sea THEN 'marine' ELSE 'not marine' END FROM f UNION ALL
  SELECT o_orderkey, 5, '环境风险', CASE WHEN risk IS NULL THEN 'unknown' ELSE 'decided' END, coalesce(risk, false), CASE WHEN risk IS NULL THEN 'unknown' WHEN risk THEN 'over' ELSE 'under' END FROM f UNION ALL
  SELECT o_orderkey, 6, '土壤', 'decided', false, 'never' FROM f UNION ALL SELECT o_orderkey, 7, '声环境', 'decided', false, 'never' FROM f)"""


@register("element_verdicts", f"WITH {_ORDERS}, {_VERDICTS} SELECT o_orderkey, element, status, wanted, reason FROM v")
def element_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.element_verdicts(_facts(spark, sf_dir), ["o_orderkey"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    each = f.select("o_orderkey", "o_custkey", F.posexplode(F.array(*map(F.lit, A.ELEMENTS))).alias("e", "element"))
    stated = each.select("o_orderkey", "element", F.expr(_STATED).alias("set"))
    evidence = each.filter(_SHOWN).select("o_orderkey", "element")
    reports = f.select("o_orderkey", "project", F.lit("").alias("industry"), "intake", "water")
    elements = A.element_facts(A.element_verdicts(f, ["o_orderkey"]), stated, evidence, reports, ["o_orderkey"])
    return A.audit_items(f.join(elements, "o_orderkey"), ["o_orderkey"])


def _item(no: int, state: str, confidence: str) -> str:
    return f"SELECT o_orderkey, {no} AS no, {state} AS state, {confidence} AS confidence FROM f"


_ITEMS = f"""
e AS (SELECT v.*, f.kind, f.project, {_STATED} AS stated, {_SHOWN} OR v.element = '海洋' AND status = 'unknown' AND project IS NOT NULL AND NOT regexp_matches(project, '{A.MARINE}') AS shown,
        CASE WHEN element = '海洋' AND status = 'unknown' AND NOT regexp_matches(coalesce(project, ''), '{A.MARINE}') THEN 'nature' WHEN element = '生态' AND status = 'unknown' AND NOT intake THEN 'absence' ELSE status END AS how, water
      FROM v JOIN f USING (o_orderkey)),
i AS (
  SELECT o_orderkey, e + 2 AS no,
    CASE WHEN coalesce(kind, '') <> '报告表' THEN '不适用' WHEN element = '大气' AND water = 'standard' THEN '存在疑似问题' WHEN how = 'unknown' THEN '存在疑似问题'
         WHEN how = 'decided' AND wanted THEN CASE WHEN stated THEN '无问题' WHEN NOT stated THEN '存在问题' ELSE '存在疑似问题' END WHEN stated THEN '优化调整建议' ELSE '无问题' END AS state,
    CASE WHEN coalesce(kind, '') <> '报告表' THEN '高' WHEN element = '大气' AND water = 'standard' THEN '低' WHEN how = 'unknown' OR how = 'absence' THEN '低' WHEN how = 'nature' THEN CASE WHEN shown THEN '中' ELSE '低' END
         WHEN wanted AND stated IS NOT NULL AND shown THEN '高' ELSE '中' END AS confidence FROM e UNION ALL
  {_item(1, "CASE WHEN kind IS NULL OR NOT found OR tier IS NULL THEN '存在疑似问题' WHEN kind = tier THEN '无问题' WHEN (kind = '报告书' OR tier = '登记表') THEN '优化调整建议' ELSE '存在问题' END", "CASE WHEN kind IS NULL OR NOT found OR tier IS NULL THEN '低' WHEN exception = 'unknown' THEN '中' ELSE '高' END")} UNION ALL
  {_item(10, "CASE WHEN kind <> '报告表' THEN '不适用' WHEN NOT stated_any THEN '存在疑似问题' WHEN exceeds THEN '优化调整建议' ELSE '无问题' END", "CASE WHEN kind <> '报告表' THEN '高' WHEN NOT stated_any THEN '低' ELSE '中' END")} UNION ALL
  {_item(11, "CASE WHEN risk_rows = 0 OR risk_unknown > 0 THEN '存在疑似问题' ELSE '无问题' END", "CASE WHEN risk_rows = 0 THEN '低' ELSE '中' END")} UNION ALL
  {_item(12, "CASE WHEN limit_rows = 0 THEN '存在疑似问题' WHEN limit_wrong > 0 THEN '存在问题' WHEN limit_all_unknown THEN '存在疑似问题' ELSE '无问题' END", "CASE WHEN limit_rows = 0 THEN '低' WHEN limit_wrong > 0 THEN '高' WHEN limit_all_unknown THEN '低' WHEN limit_right >= 3 THEN '高' ELSE '中' END")} UNION ALL
  {_item(13, "CASE WHEN q_rows = 0 OR NOT q_stated THEN '存在疑似问题' WHEN q_below THEN '存在问题' WHEN q_differs THEN '存在疑似问题' ELSE '无问题' END", "CASE WHEN q_rows = 0 OR NOT q_stated THEN '低' WHEN q_below THEN '高' WHEN q_differs THEN '中' ELSE '高' END")} UNION ALL
  SELECT f.o_orderkey, 14, CASE WHEN kind = '报告表' AND NOT coalesce(e.stated, false) THEN '不适用' WHEN NOT potential THEN '存在疑似问题' WHEN potential_fits THEN '无问题' ELSE '存在疑似问题' END,
    CASE WHEN kind = '报告表' AND NOT coalesce(e.stated, false) THEN '中' WHEN NOT potential THEN '低' ELSE '中' END FROM f JOIN (SELECT o_orderkey, stated FROM e WHERE element = '环境风险') e USING (o_orderkey) UNION ALL
  {_item(15, "CASE WHEN targets IS NULL THEN '存在疑似问题' WHEN targets = 'caption' OR targets_full THEN '无问题' ELSE '优化调整建议' END", "CASE WHEN targets IS NULL OR targets = 'caption' OR targets = 'row' AND NOT targets_full THEN '低' ELSE '中' END")} UNION ALL
  {_item(16, "CASE WHEN lacks > 0 THEN '存在疑似问题' ELSE '无问题' END", "CASE WHEN lacks > 0 THEN '低' ELSE '中' END")} UNION ALL
  {_item(17, "CASE WHEN wrong > 0 OR stale > 0 THEN '优化调整建议' ELSE '无问题' END", "CASE WHEN wrong > 0 OR stale > 0 AND official THEN '高' WHEN stale > 0 THEN '中' ELSE '低' END")} UNION ALL
  {_item(18, "CASE WHEN conclusion IS NULL OR verdict IS NULL THEN '存在疑似问题' ELSE '无问题' END", "CASE WHEN conclusion IS NULL OR verdict IS NULL THEN '低' ELSE '中' END")}),
items AS (SELECT o_orderkey, CAST(no AS INTEGER) AS no, ({[x for x, _ in A.ITEMS]})[no] AS item, state, confidence FROM i)"""


@register("audit_items", f"WITH {_ORDERS}, {_VERDICTS}, {_ITEMS} SELECT * FROM items")
def audit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eighteen items of every order's facts by one decision table."""
    return _items(spark, sf_dir)


@register("audit_statistics", f"""WITH {_ORDERS}, {_VERDICTS}, {_ITEMS},
s AS (SELECT o_orderkey, count(*) FILTER (WHERE state = '存在问题') AS problems, count(*) FILTER (WHERE state = '存在疑似问题') AS suspects, count(*) FILTER (WHERE state = '优化调整建议') AS suggestions, count(*) FILTER (WHERE state = '无问题') AS "right", count(*) FILTER (WHERE state = '不适用') AS not_applicable FROM items GROUP BY o_orderkey)
SELECT *, CASE WHEN problems > 0 THEN '存在问题' WHEN suspects > 0 THEN '存在疑似问题' WHEN suggestions > 0 THEN '优化调整建议' ELSE '无问题' END AS worst FROM s""")
def audit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.statistics(_items(spark, sf_dir), ["o_orderkey"])


#: A page of a report, from an order: headings, words, standards and sentences by its own columns.
_PAGE = """concat(
  CASE WHEN o_totalprice > 300000 THEN '第3章 工程分析' WHEN o_totalprice > 240000 THEN concat(CAST(o_orderkey % 9 AS STRING), '.1 污染源与工艺流程') WHEN o_totalprice > 180000 THEN '见项目概况' WHEN o_totalprice > 120000 THEN '第 9 章  结论' ELSE '概述' END, chr(10),
  CASE WHEN o_orderpriority LIKE '1%' THEN concat('依据 HJ/T 169-2018 与 GB ', CAST(3000 + o_custkey % 40 AS STRING), '—2012 编写，', o_orderpriority) WHEN o_orderpriority LIKE '2%' THEN concat('执行GB/T', CAST(3000 + o_orderkey % 40 AS STRING), '-96，环境风险') WHEN o_orderpriority LIKE '3%' THEN '结论与建议' WHEN o_orderpriority LIKE '4%' THEN '环境保护措施、影响预测与评价' ELSE '表2 环境敏感目标及位置一览表' END, chr(10),
  CASE WHEN o_orderstatus = 'F' THEN concat('从环境保护角度看', CAST(CAST(floor(o_totalprice) AS INT) AS STRING), '可行。') WHEN o_orderstatus = 'O' AND o_totalprice < 60000 THEN '项目不可行' ELSE '概述如上，治理措施与污染物排放量见后' END)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), page.alias("page"), F.expr(_PAGE).alias("text"))


_PAGES = f"p AS (SELECT o_custkey AS report, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, {_PAGE.replace('AS STRING', 'AS VARCHAR')} AS text FROM orders)"
_NEED = ", ".join(f"({'true' if form else 'false'}, {k}, '{part}', {w}, '{word}')" for form, parts in ((True, A.REQUIRED_FORM), (False, A.REQUIRED_BOOK)) for k, (part, words) in enumerate(parts) for w, word in enumerate(words))


@register("located_parts", f"""WITH {_PAGES}, need AS (SELECT * FROM (VALUES {_NEED}) v(form, k, part, w, word)),
h AS (SELECT report, page, need.*, (length(text) - length(replace(text, word, ''))) // length(word) AS n, regexp_matches(text, '第\\s*\\d+\\s*章[^\\n]{{0,16}}' || word) AS c, regexp_matches(text, '\\d+(?:\\.\\d+)*\\s*[^\\n]{{0,14}}' || word) AS s FROM p, need WHERE contains(text, word) AND form = (report % 2 = 0)),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY report, k, w ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
g AS (SELECT report, k, part, w, coalesce(min(page) FILTER (WHERE c), min(page) FILTER (WHERE s), min(page)) AS page FROM b WHERE before < 40 GROUP BY ALL),
a AS (SELECT report, k, part, arg_min(page, w) AS page FROM g GROUP BY ALL)
SELECT c_custkey AS report, n.part, CAST(a.page AS INTEGER) AS page FROM customer JOIN (SELECT DISTINCT form, k, part FROM need) n ON n.form = (c_custkey % 2 = 0) LEFT JOIN a ON a.report = c_custkey AND a.k = n.k""")
def located_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report"), F.when(F.col("c_custkey") % 2 == 0, "报告表").otherwise("报告书").alias("kind"))
    return A.located_parts(_pages(spark, sf_dir), kinds, ["report"])


#: Two standards of each number, some of them replaced, abolished, unchecked or of several states.
_CURRENCY = [("standard", "concat('GB ', CAST(3000 + s_suppkey % 60 AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN '-2012' ELSE '－2012' END)"), ("title", "s_name"),
             ("hardness", "CASE s_suppkey % 4 WHEN 0 THEN '硬-官方' WHEN 1 THEN '硬-标准自身' WHEN 2 THEN '软-待核' ELSE '其他' END"),
             ("state", "CASE WHEN s_acctbal > 5000 THEN '现行' WHEN s_acctbal > 2000 THEN '废止' ELSE NULL END"),
             ("replaced", "CASE WHEN s_acctbal > 7500 THEN concat(' GB ', CAST(s_suppkey AS STRING), ' ') WHEN s_acctbal > 6500 THEN '未查到' ELSE '' END")]


@register("stale_citations", f"""WITH {_PAGES},
k AS (SELECT {", ".join(f"{x.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, x in _CURRENCY)} FROM supplier),
t AS (SELECT *, regexp_replace(upper(standard), '[\\s\\-/—–－~～]', '', 'g') AS key, trim(replaced) <> '' AND NOT contains(replaced, '未查到') AS told FROM k),
b AS (SELECT *, CASE WHEN hardness = '软-待核' THEN 'unchecked' WHEN told THEN 'replaced by ' || trim(replaced) WHEN state IN ('已废止', '废止') THEN 'abolished' END AS finding, max(n) OVER (PARTITION BY key) AS states
      FROM (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY coalesce(state, '')) AS n FROM t)
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE hardness WHEN '硬-官方' THEN 1 WHEN '硬-标准自身' THEN 2 WHEN '软-待核' THEN 3 ELSE 9 END, NOT told, title) = 1),
c AS (SELECT report, page, unnest(regexp_extract_all(text, '(?:HJ\\s*/?\\s*T?\\s*\\d{{2,5}}|GB\\s*/?\\s*T?\\s*\\d{{4,5}})\\s*[—\\-–~]\\s*\\d{{2,4}}')) AS number, generate_subscripts(regexp_extract_all(text, '(?:HJ\\s*/?\\s*T?\\s*\\d{{2,5}}|GB\\s*/?\\s*T?\\s*\\d{{4,5}})\\s*[—\\-–~]\\s*\\d{{2,4}}'), 1) AS place FROM p),
r AS (SELECT *, regexp_replace(upper(number), '[\\s\\-/—–－~～]', '', 'g') AS key FROM c QUALIFY row_number() OVER (PARTITION BY report ORDER BY page, place) <= 300),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY report, key ORDER BY page, place) = 1)
SELECT report, number, CAST(page AS INTEGER) AS page, hardness, finding || CASE WHEN states > 1 THEN '; states differ' ELSE '' END AS finding FROM u JOIN b USING (key) WHERE finding IS NOT NULL""")
def stale_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = table(spark, sf_dir, "supplier").select(*[F.expr(x).alias(c) for c, x in _CURRENCY])
    return A.stale_citations(_pages(spark, sf_dir), currency, ["report"])


@register("conclusions", f"""WITH {_PAGES},
s AS (SELECT *, left(text, 500) AS head, max(page) OVER (PARTITION BY report) AS last FROM p),
d AS (SELECT *, CASE WHEN regexp_matches(head, '第\\s*\\d+\\s*章[^\\n]{{0,10}}结论') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(head, '(?m)^\\s*\\d+(?:\\.\\d+)*\\s*结论') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(head, '(?m)结论与建议|结论及建议|结论$') THEN 2 ELSE 0 END + CASE WHEN page > 0.6 * last THEN 2 ELSE 0 END AS score FROM s),
b AS (SELECT report, page AS start FROM d WHERE contains(text, '结论') QUALIFY row_number() OVER (PARTITION BY report ORDER BY score DESC, page) = 1),
v AS (SELECT d.report, page, regexp_extract(text, '{A.VERDICT}') AS v FROM d JOIN b USING (report) WHERE page >= start AND page < start + 10)
SELECT b.report, CAST(b.start AS INTEGER) AS page, arg_min(v.v, v.page) AS verdict, CAST(min(v.page) AS INTEGER) AS verdict_page FROM b LEFT JOIN v ON v.report = b.report AND v.v <> '' GROUP BY b.report, b.start""")
def conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conclusions(_pages(spark, sf_dir), ["report"])


@register("targets_form", f"""WITH {_TABLES}, {_PAGES},
d AS (SELECT report, page, tab, rows, array_to_string(list_transform(flatten(rows[1:3]), lambda c: coalesce(c, '')), ' ') AS blob FROM t WHERE report % 3 > 0),
w AS (SELECT report, 0 AS step, page, tab, 0 AS row, 'table' AS form, contains(blob, '方位') AND contains(blob, '距离') AS full FROM d WHERE len(rows) > 1 AND regexp_matches(blob, '{A.TARGET_NAME}') AND regexp_matches(blob, '{A.TARGET_PLACE}') AND (regexp_matches(blob, '{A.TARGET_WORD}') OR regexp_matches(blob, '{A.TARGET_PEOPLE}'))),
xr AS (SELECT report, page, tab, unnest(rows) AS cells, unnest(range(0, len(rows))) AS row FROM d),
r AS (SELECT report, 1, page, tab, row, 'row', regexp_matches(left(array_to_string(list_transform(cells[2:], lambda c: coalesce(c, '')), ' '), 200), '{A.TARGET_ROW_FULL}') FROM xr WHERE regexp_matches(coalesce(cells[1], ''), '{A.TARGET_ROW}')),
c AS (SELECT report, min(page) AS page FROM p WHERE regexp_matches(text, '{A.TARGET_CAPTION}') GROUP BY report),
u AS (SELECT report, page, arg_min(blob, tab) AS blob FROM d WHERE len(rows) > 2 GROUP BY ALL),
e AS (SELECT * FROM w UNION ALL SELECT * FROM r UNION ALL SELECT c.report, 2, c.page, 0, 0, CASE WHEN blob IS NULL THEN 'caption' ELSE 'table' END, contains(blob, '方位') AND contains(blob, '距离') FROM c LEFT JOIN u USING (report, page))
SELECT report, form, CAST(page AS INTEGER) AS page, "full" FROM e QUALIFY row_number() OVER (PARTITION BY report ORDER BY step, page, tab, row) = 1""")
def targets_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the reports of suppliers and customers give their places; two of three suppliers have tables."""
    return A.targets_form(_tables(spark, sf_dir).filter("report % 3 > 0"), _pages(spark, sf_dir), ["report"])
