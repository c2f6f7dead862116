"""Queries on facts from reports: suppliers' order lines, by line number, are the tables of a report; documents are its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import extraction as X
from docstrata.plans.registry import register
from docstrata.sources.tables import spread, table

#: Header rows, and what the cells below them hold, by form of table: with a unit in the header, with a unit column, of
#: another kind, of risks, of places, without a header, and with a header over two rows.
_FORMS = [
    ([["序号", "物料名称", "年用量（t/a）", "备注"]], "serial name amount note"),
    ([["名称", "数量", "单位", "最近距离"]], "name amount unit distance"),
    ([["序号", "指标名称", "单位", "数量"]], "serial name unit amount"),
    ([["危险物质名称", "最大存在量t", "临界量t", "单位"]], "name amount limit unit"),
    ([["环境保护目标名称", "方位及距离", "数量", "单位"]], "name distance amount unit"),
    ([], "name amount unit distance"),
    ([["序号", "名称", "消耗", "规格"], ["", "", "数量", "单位"]], "serial name amount unit"),
]
#: The cells of an order line as SQL, the same for Spark and DuckDB.
_CELLS = {
    "serial": "CAST(l_orderkey AS STRING)",
    "name": "CASE WHEN l_quantity = 1 THEN '合计名称' WHEN l_quantity = 2 THEN '12.5-3' WHEN l_quantity = 3 THEN '' WHEN l_quantity = 4 THEN '序号' ELSE concat('  ', p_name, CASE WHEN p_size % 3 = 0 THEN '  村 ' WHEN p_size % 3 = 1 THEN '小区' ELSE '森林公园小区' END) END",
    "amount": "CASE WHEN l_returnflag = 'A' THEN concat(CAST(l_linenumber AS STRING), ',', lpad(CAST(CAST(l_quantity AS INT) AS STRING), 3, '0'), ' t') WHEN l_returnflag = 'N' THEN concat('约 ', CAST(CAST(l_quantity AS INT) AS STRING), '.5 万 吨') WHEN l_linenumber = 1 THEN '—' ELSE concat('A-', CAST(CAST(l_quantity AS INT) AS STRING), 'kg/h') END",
    "unit": "CASE WHEN l_linestatus = 'O' THEN '' ELSE ' 吨 /年 ' END",
    "distance": "CASE WHEN l_tax > 0.07 THEN '紧邻' ELSE concat('N，', CAST(CAST(l_quantity AS INT) * 20 + 100 AS STRING), 'm') END",
    "limit": "CASE WHEN l_discount < 0.01 THEN NULL ELSE CAST(CAST(round(l_discount * 100) AS INT) AS STRING) END",
    "note": "p_type",
}


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each supplier, a table for each line number, of a form by both; its rows are the order lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", "p_type"), "l_partkey")
    d = lines.select(F.col("l_suppkey").alias("report"), F.col("l_linenumber").alias("table"), "l_orderkey", "l_partkey", "l_extendedprice", *[F.expr(x).alias(c) for c, x in _CELLS.items()])
    form = (F.col("report") + F.col("table")) % len(_FORMS)
    # a line has the cells of its table's form made, not those of all forms
    cells = F.coalesce(*[F.when(form == k, F.array(*kinds.split())) for k, (_, kinds) in enumerate(_FORMS)])
    heads = F.array(*[F.array(*[F.array(*map(F.lit, row)) for row in head]).cast("array<array<string>>") for head, _ in _FORMS])
    d = d.groupBy("report", "table").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_partkey", "l_extendedprice", cells.alias("cells")))).alias("lines"))
    rows = F.concat(F.get(heads, form.cast("int")), F.transform("lines", lambda x: x["cells"]))
    return d.select("report", "table", (F.floor(F.col("table") * 3 / 2) + F.col("report") % 3).cast("int").alias("page"), rows.alias("rows"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report"))
    found = F.filter(F.array(
        F.when(F.col("report") % 3 == 0, F.struct(F.lit("原辅材料").alias("anchor"), F.lit(9).alias("page"))),
        F.when(F.col("report") % 3 == 0, F.struct(F.lit("原辅材料").alias("anchor"), F.lit(2).alias("page"))),
        F.when(F.col("report") % 4 == 0, F.struct(F.lit("产品方案").alias("anchor"), F.lit(7).alias("page"))),
        F.when(F.col("report") % 2 == 0, F.struct(F.lit("环境敏感目标").alias("anchor"), F.lit(5).alias("page"))),
    ), lambda x: x.isNotNull())
    return s.select("report", F.explode(found).alias("a")).select("report", "a.*")


def _quoted(rows: list[list[str]]) -> str:
    return "CAST([" + ", ".join("[" + ", ".join(f"'{c}'" for c in row) + "]" for row in rows) + "] AS VARCHAR[][])"


_OF = " ".join(f"WHEN {k} THEN [{', '.join(_CELLS[c].replace('STRING', 'VARCHAR') for c in kinds.split())}]" for k, (_, kinds) in enumerate(_FORMS))
_TABLES = f"""
x AS (SELECT l_suppkey AS report, l_linenumber AS tab, l_orderkey, l_partkey, l_extendedprice, CASE (l_suppkey + l_linenumber) % {len(_FORMS)} {_OF} END AS cells FROM lineitem JOIN part ON p_partkey = l_partkey),
y AS (SELECT report, tab, list(cells ORDER BY l_orderkey, l_partkey, l_extendedprice) AS body FROM x GROUP BY report, tab),
t AS (SELECT report, tab, tab * 3 // 2 + report % 3 AS page, list_concat(CASE (report + tab) % {len(_FORMS)} {" ".join(f"WHEN {k} THEN {_quoted(head)}" for k, (head, _) in enumerate(_FORMS))} END, body) AS rows FROM y),
a AS (SELECT s_suppkey AS report, unnest(['原辅材料', '原辅材料', '产品方案', '环境敏感目标']) AS anchor, unnest([9, 2, 7, 5]) AS page, unnest([3, 3, 4, 2]) AS every FROM supplier),
f AS (SELECT report, anchor, min(page) AS page FROM a WHERE report % every = 0 GROUP BY ALL)"""


def _at(words: list[str], cells: str = "head") -> str:
    """SQL: the place of the first cell that holds one of the words, from 1; null if none does."""
    return f"nullif(coalesce(list_position(list_transform({cells}, lambda c: regexp_matches(coalesce(c, ''), '{'|'.join(words)}')), true), 0), 0)"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


_PLAIN = "regexp_replace({0}, '[,，]', '', 'g')"
_PARTS = r"regexp_extract(" + _PLAIN + r", '(?s)^([^0-9]*)([0-9]+(?:\.[0-9]+)?)(.*)$', {1})"


def _number(x: str) -> str:
    many = f"(contains({_PARTS.format(x, 1)}, '万') OR contains({_PARTS.format(x, 3)}, '万'))"
    return f"CAST(nullif({_PARTS.format(x, 2)}, '') AS DOUBLE) * CASE WHEN {many} THEN 10000 ELSE 1 END"


def _behind(x: str) -> str:
    before, after = _clean(_PARTS.format(x, 1)), _clean(_PARTS.format(x, 3))
    return _clean(f"replace(CASE WHEN {before} <> '' AND NOT regexp_matches({before}, '[一-鿿A-Za-z]$') THEN {before} || ' ' || {after} ELSE {after} END, CASE WHEN contains({_PARTS.format(x, 1)} || {_PARTS.format(x, 3)}, '万') THEN '万' ELSE chr(1) END, '')")


_JOINED = "left(array_to_string(list_filter(list_transform({0}, lambda c: " + _clean("c") + "), lambda c: c <> ''), ' | '), {1})"
_EXCLUDED = "指标名称|项目|工程内容|污染物名称|设备名称"


def _materials_sql(roles: str) -> str:
    """From tables with their roles (1-based places, null if absent), the first data row, and the header."""
    return f"""{roles},
c AS (SELECT *, head[n] AS nh, replace(regexp_extract(head[q], '{X.HEADER_UNIT}', 1), ' ', '') AS uh FROM roles WHERE n IS NOT NULL AND q IS NOT NULL),
d AS (SELECT *, CASE WHEN n <= 2 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(nh, '{X.MATERIAL_NAMES}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(array_to_string(head, ' '), '{X.CONSUMPTION}') THEN 2 ELSE 0 END AS alike,
        EXISTS (SELECT 1 FROM f WHERE f.report = c.report AND (anchor = '原辅材料' AND abs(f.page - c.page) <= 2 OR anchor = '产品方案' AND abs(f.page - c.page) <= 1)) AS near
      FROM c WHERE NOT regexp_matches(nh, '{_EXCLUDED}') AND (u IS NOT NULL OR uh <> '')),
e AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY alike DESC, page, tab) AS k FROM (SELECT *, max(near) OVER (PARTITION BY report) AS any_near FROM d) WHERE near OR NOT any_near),
r AS (SELECT *, unnest(rows[body + 1:]) AS w, unnest(range(body, len(rows))) AS j FROM e WHERE k <= 6),
m AS (SELECT report, k, j, page, {_clean("w[n]")} AS name, {_number("w[q]")} AS quantity, coalesce(nullif(CASE WHEN u IS NOT NULL THEN {_clean("w[u]")} END, ''), nullif({_behind("w[q]")}, ''), uh) AS unit,
        {_JOINED.format("w", 200)} AS quote, {_JOINED.format("rows[1]", 120)} AS header FROM r WHERE len(w) >= n AND len(w) >= q)
SELECT report, name, quantity, unit, page, quote, header FROM m WHERE length(name) >= 2 AND NOT regexp_matches(name, '序号|名称') AND NOT regexp_matches(name, '^[\\d.\\s%\\-—/]+$')
QUALIFY row_number() OVER (PARTITION BY report, name ORDER BY k, j) = 1"""


_HEADS = "h AS (SELECT *, list_concat(coalesce(rows[1], []), coalesce(rows[2], [])) AS head FROM t)"


@register("table_materials", f"WITH {_TABLES}, {_HEADS}, " + _materials_sql(f"roles AS (SELECT *, 1 AS body, {_at(X.NAMES)} AS n, {_at(X.QUANTITIES)} AS q, {_at(X.UNITS)} AS u FROM h)"))
def table_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials of each supplier's tables; a header's second row gives no column."""
    return X.materials(_tables(spark, sf_dir), _anchors(spark, sf_dir), ["report"])


def _below(p: str) -> str:
    return f"CASE WHEN {p} > wide THEN {p} - wide ELSE {p} END"


_CARRIED = f"""
g AS (SELECT *, len(rows[1]) AS wide, {_at(X.NAMES)} AS n0, {_at(X.QUANTITIES)} AS q0, {_at(X.UNITS)} AS u0 FROM h),
g1 AS (SELECT *, coalesce(n0 > wide, false) OR coalesce(q0 > wide, false) OR coalesce(u0 > wide, false) AS deep FROM g),
g2 AS (SELECT report, tab, page, rows, wide, {_below("n0")} AS n0, {_below("q0")} AS q0, {_below("u0")} AS u0, CASE WHEN deep THEN list_transform(range(1, len(rows[1]) + 1), lambda i: rows[1][i] || coalesce(rows[2][i], '')) ELSE head END AS head, CASE WHEN deep THEN 2 ELSE 1 END AS body,
         n0 IS NOT NULL AND q0 IS NOT NULL AS own FROM g1),
g3 AS (SELECT *, sum(CASE WHEN own OR prev IS NULL OR page - prev > 1 OR pw <> wide THEN 1 ELSE 0 END) OVER (PARTITION BY report ORDER BY page, tab) AS run
       FROM (SELECT *, lag(page) OVER w AS prev, lag(wide) OVER w AS pw FROM g2 WINDOW w AS (PARTITION BY report ORDER BY page, tab))),
g4 AS (SELECT *, first_value(struct_pack(n := n0, q := q0, u := u0, head := head, own := own)) OVER (PARTITION BY report, run ORDER BY page, tab) AS f FROM g3),
roles AS (SELECT report, tab, page, rows, CASE WHEN own THEN n0 WHEN f.own THEN f.n END AS n, CASE WHEN own THEN q0 WHEN f.own THEN f.q END AS q, CASE WHEN own THEN u0 WHEN f.own THEN f.u END AS u, CASE WHEN own OR NOT f.own THEN head ELSE f.head END AS head, CASE WHEN own OR NOT f.own THEN body ELSE 0 END AS body FROM g4)"""


@register("table_materials_carried", f"WITH {_TABLES}, {_HEADS}, " + _materials_sql(_CARRIED.strip()))
def table_materials_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with headers over two rows, and with tables that go on on the next page without a header."""
    return X.materials(_tables(spark, sf_dir), _anchors(spark, sf_dir), ["report"], merged=True, carried=True)


@register("table_risks", f"""WITH {_TABLES}, {_HEADS},
k AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY page, tab) AS k FROM h WHERE {_at(X.NAMES)} IS NOT NULL AND {_at(X.QUANTITIES)} IS NOT NULL),
c AS (SELECT *, {_at(X.RISK_NAMES)} AS n, {_at(X.RISK_QUANTITIES)} AS q, {_at(X.RISK_LIMITS)} AS l FROM k WHERE k <= 4),
r AS (SELECT *, unnest(rows[2:]) AS w, unnest(range(1, len(rows))) AS j FROM c WHERE n IS NOT NULL AND q IS NOT NULL AND l IS NOT NULL),
m AS (SELECT report, tab, j, {_clean("w[n]")} AS name, {_number("w[q]")} AS quantity, {_number("w[l]")} AS threshold, page, {_JOINED.format("w", 200)} AS quote, {_JOINED.format("rows[1]", 120)} AS header FROM r WHERE len(w) >= greatest(n, q, l))
SELECT report, tab AS "table", CAST(j AS INTEGER) AS row, name, quantity, threshold, page, quote, header FROM m WHERE length(name) >= 2 AND NOT contains(name, '序号')""")
def table_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.risk_materials(_tables(spark, sf_dir), ["report"])


_TARGETS = f"""
c AS (SELECT *, {_at(X.TARGET_NAMES)} AS n, {_at(X.DISTANCES)} AS q, EXISTS (SELECT 1 FROM f WHERE f.report = h.report AND anchor = '环境敏感目标' AND abs(f.page - h.page) <= 2) AS near FROM h WHERE {_at(X.NAMES)} IS NOT NULL AND {_at(X.DISTANCES)} IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY page, tab) AS k FROM (SELECT *, max(near) OVER (PARTITION BY report) AS any_near FROM c) WHERE near OR NOT any_near),
r AS (SELECT *, unnest(rows[2:]) AS w, unnest(range(1, len(rows))) AS j FROM e WHERE k <= 3),
m AS (SELECT report, k, j, {_clean("w[n]")} AS name, {_number("w[q]")} AS distance, {_clean("w[q]")} AS stated, page, {_JOINED.format("w", 200)} AS quote FROM r WHERE len(w) >= greatest(n, q)),
o AS (SELECT report, name, distance, stated, page, quote, row_number() OVER (PARTITION BY report ORDER BY k, j) AS place FROM m WHERE name <> '' AND NOT regexp_matches(name, '序号|名称')),
targets AS (SELECT * FROM o WHERE place <= 60)"""


@register("table_targets", f"WITH {_TABLES}, {_HEADS}, {_TARGETS} SELECT * FROM targets")
def table_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.targets(_tables(spark, sf_dir), _anchors(spark, sf_dir), ["report"])


@register("air_targets", f"""WITH {_TABLES}, {_HEADS}, {_TARGETS},
p AS (SELECT report, arg_min(struct_pack(distance, page, quote), distance * 1000 + place) AS n, count(*) AS known FROM targets WHERE distance IS NOT NULL AND regexp_matches(name, '{X.AIR_TARGETS}') AND NOT regexp_matches(name, '{X.NATURE_TARGETS}') GROUP BY report),
b AS (SELECT report, n.distance <= 500 AS value, n.page AS page, n.quote AS quote FROM p WHERE n.distance <= 500 OR known >= 3)
SELECT s_suppkey AS report, 'air' AS key, CASE WHEN b.report IS NOT NULL THEN b.value::VARCHAR WHEN s_suppkey % 2 = 0 THEN 'unclear' END AS value, coalesce(b.page, 0) AS page, coalesce(b.quote, '') AS quote, CASE WHEN b.report IS NOT NULL THEN 'table' ELSE 'regex' END AS method
FROM supplier LEFT JOIN b ON b.report = s_suppkey WHERE b.report IS NOT NULL OR s_suppkey % 2 = 0""")
def air_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tables of places say, in place of what a text says, which every second report has."""
    found = X.air_targets(X.targets(_tables(spark, sf_dir), _anchors(spark, sf_dir), ["report"]), ["report"])
    found = found.withColumn("key", F.lit("air")).withColumn("value", F.col("value").cast("string"))
    texts = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("report"), F.lit("air").alias("key"), F.lit("unclear").alias("value"), F.lit(0).alias("page"), F.lit("").alias("quote"), F.lit("regex").alias("method"))
    return X.overridden(texts, found, ["report"])


_LABELS = [("小区", "place"), ("村", "place"), ("森林", "forest"), ("约", "about"), ("A-", "rate")]


def _label_sql(labels: list[tuple[str, str]], least: int) -> str:
    hits = " UNION ALL ".join(f"SELECT report, tab, page, j, {k} AS l, '{key}' AS key, list_filter(w[{_at([label], 'w')} + 1:], lambda c: length(c) >= {least})[1] AS value, w FROM r WHERE {_at([label], 'w')} IS NOT NULL" for k, (label, key) in enumerate(labels))
    return f"""r AS (SELECT report, tab, page, list_transform(unnest(rows), lambda c: {_clean("c")}) AS w, unnest(range(0, len(rows))) AS j FROM t),
hits AS ({hits})
SELECT report, key, value, page, {_JOINED.format("w", 200)} AS quote, 'table' AS method FROM hits WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report, key ORDER BY page, tab, j, l) = 1"""


@register("labelled_cells", f"WITH {_TABLES}, {_label_sql(_LABELS, 3)}")
def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each report the first cell behind a label, of two labels for one key the first row's."""
    return X.labelled(_tables(spark, sf_dir), ["report"], _LABELS)


#: Thirty rules on the words of the documents, three values by key.
_RULES = [(f"k{k}", rf"(?:^|[ ,.]){a}[^.]{{0,{20 + k}}} {b}[^ ,.]*", v) for k in range(10) for a, b, v in ((("the", "der", "les", "los", "and", "und", "une", "con", "that", "ist")[k], "[b-m]", True), (("with", "die", "des", "las", "for", "mit", "est", "por", "from", "das")[k], "[n-z]", False), (("of", "zu", "la", "el", "in", "von", "du", "de", "to", "ein")[k], "[a-f][a-f][a-f]", "other"))]
_GUARDS = ("(?:^|[ ,.])(?:not|nicht|pas|que)(?:$|[ ,.])", "[0-9]{3}")
_DOC_PAGES = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)"


def _findings_sql() -> str:
    hits = ", ".join(f"{{'r': {k}, 'h': regexp_extract(text, '{p}')}}" for k, (_, p, _) in enumerate(_RULES))
    keys = ", ".join(f"'{k}'" for k, _, _ in _RULES)
    values = ", ".join(f"'{str(v).lower()}'" for _, _, v in _RULES)
    cut = "instr(text, x.h)"
    # the first place of a match may come after another place of the same letters, so its place is that of the text before it
    before = "length(regexp_extract(text, '(?s)^(.*?)(?:' || ([" + ", ".join(f"'{p}'" for _, p, _ in _RULES) + "])[x.r + 1] || ')', 1))"
    return f"""WITH {_DOC_PAGES},
h AS (SELECT doc_id, page, text, unnest([{hits}]) AS x FROM p),
c AS (SELECT doc_id, page, x.r AS r, {_clean(f"substr(text, greatest({before} + 1 - 40, 1), {before} + 1 - greatest({before} + 1 - 40, 1) + length(x.h) + 40)")} AS quote FROM h WHERE x.h <> ''),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, r ORDER BY page) = 1),
g AS (SELECT * FROM f WHERE NOT regexp_matches(quote, '{_GUARDS[0]}') AND NOT regexp_matches(quote, '{_GUARDS[1]}')),
b AS (SELECT *, ([{keys}])[r + 1] AS key FROM g)
SELECT doc_id, key, ([{values}])[r + 1] AS value, CAST(page AS INTEGER) AS page, quote, 'regex' AS method FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY r) = 1"""


@register("text_findings", _findings_sql())
def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty ordered rules with guards over all lines of all documents, in one pass."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    return X.findings(d.withColumn("page", F.col("page") + 1), ["doc_id"], _RULES, _GUARDS, around=40)


#: A material of a customer's order: a name, what its row says, an amount and a unit.
_MATERIAL = {
    "name": "concat(CASE WHEN o_orderkey % 7 < 2 THEN '热熔胶' WHEN o_orderkey % 7 = 2 THEN '面漆' WHEN o_orderkey % 7 = 3 THEN '粉末涂料' WHEN o_custkey % 5 = 0 AND o_orderkey % 7 = 4 THEN '甲苯' ELSE '钢材' END, ' ', o_orderpriority)",
    "quote": "CASE WHEN o_orderstatus = 'F' THEN concat('水性 | ', o_orderpriority) WHEN o_orderstatus = 'O' THEN '年用 | t' WHEN o_totalprice > 200000 THEN '溶剂型' END",
    "quantity": "CASE WHEN o_totalprice > 15000 THEN floor(o_totalprice / 1000) END",
    "unit": "CASE WHEN o_totalprice > 250000 THEN 't' WHEN o_totalprice > 100000 THEN '' WHEN o_totalprice > 50000 THEN 'kg' END",
}
_TERM_SQL = f"""m AS (SELECT o_custkey, o_orderkey, {", ".join(f"{x} AS {c}" for c, x in _MATERIAL.items())} FROM orders),
s AS (SELECT *, list_sort(list_distinct(list(CASE WHEN regexp_matches(name || coalesce(quote, ''), '{X.SOLVENTS}') THEN name END) OVER (PARTITION BY o_custkey))) AS solvents FROM m),
d AS (SELECT *, name || ' ' || coalesce(quote, '') AS blob FROM s),
t AS (SELECT *, CASE WHEN quantity IS NULL THEN NULL WHEN regexp_matches(name, '{X.GLUE}') THEN CASE WHEN regexp_matches(blob, '{X.LOW_VOC}') THEN '非溶剂型低VOCs含量胶粘剂' WHEN regexp_matches(blob, '溶剂|{X.SOLVENTS}') OR len(solvents) > 0 THEN '溶剂型胶粘剂' END
  WHEN regexp_matches(name, '{X.PAINT}') THEN CASE WHEN regexp_matches(blob, '{X.LOW_VOC}') THEN '非溶剂型低VOCs含量涂料' WHEN regexp_matches(blob, '溶剂|{X.SOLVENTS}') THEN '溶剂型涂料（含稀释剂）' END END AS term FROM d)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", *[F.expr(x).alias(c) for c, x in _MATERIAL.items()])
    return X.mapped_terms(m, ["o_custkey"])


@register("mapped_terms", f"""WITH {_TERM_SQL}
SELECT o_custkey, o_orderkey, name, term, CASE WHEN term IS NULL THEN CASE WHEN quantity IS NULL THEN 'no quantity' WHEN regexp_matches(name, '{X.GLUE}') THEN 'glue of unknown kind' WHEN regexp_matches(name, '{X.PAINT}') THEN 'paint of unknown kind' ELSE 'no such term' END END AS why, array_to_string(solvents, '、') AS solvents FROM t""")
def mapped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("o_custkey", "o_orderkey", "name", "term", "why", F.array_join("solvents", "、").alias("solvents"))


@register("term_totals", f"""WITH {_TERM_SQL}
SELECT o_custkey, term, CAST(sum(quantity) AS DOUBLE) AS total, coalesce(arg_max(unit, o_orderkey) FILTER (WHERE unit <> ''), '') AS unit, count(*) AS materials FROM t WHERE term IS NOT NULL GROUP BY o_custkey, term""")
def term_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.term_totals(_mapped(spark, sf_dir), ["o_custkey"], ["o_orderkey"]).withColumn("total", F.col("total").cast("double"))


def _line(cells: str) -> str:
    return f"left(array_to_string(list_filter(list_transform({cells}, lambda c: {_clean('c')}), lambda c: c <> ''), '  '), 150)"


_HEAD_LINE = f"left(array_to_string(list_transform(rows[1], lambda c: {_clean('c')}), ' | '), 100)"


@register("project_digest", f"""WITH {_TABLES},
n AS (SELECT t.*, f.anchor FROM t JOIN f ON f.report = t.report AND abs(f.page - t.page) <= 2 AND f.anchor IN ('产品方案', '原辅材料')),
b AS (SELECT report, page, tab, anchor, {_HEAD_LINE} AS head, list_filter(list_transform(rows[2:15], lambda r: {_line('r')}), lambda x: x <> '') AS body FROM n),
l AS (SELECT report, CASE anchor WHEN '产品方案' THEN 1 ELSE 2 END AS part, page * 1000000 + tab AS tab, unnest(list_concat([head], body)) AS text, unnest(range(0, len(body) + 1)) AS line, page FROM b WHERE len(body) > 0 AND (anchor = '原辅材料' OR regexp_matches(head, '{X.PRODUCT_TABLE}'))),
g AS (SELECT report, part, tab, line, '【第' || page || '页】' || text AS text FROM l),
m AS (SELECT s_suppkey AS report, 0 AS part, 0 AS tab, 1 AS line, '【第3页】' || s_name AS text FROM supplier UNION ALL
  SELECT s_suppkey, 3, 0, 0, '原辅材料：' || s_name || ' ' || CAST(s_nationkey AS DOUBLE) || 't（P1）' FROM supplier),
al AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY part, tab, line) AS n FROM (SELECT * FROM g UNION ALL SELECT * FROM m))
SELECT report, string_agg(text, chr(10) ORDER BY n) AS digest FROM al WHERE n <= 120 GROUP BY report""")
def project_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each supplier's tables, with its name as a fact and one material."""
    s = table(spark, sf_dir, "supplier")
    facts = s.select(F.col("s_suppkey").alias("report"), F.lit(1).alias("order"), F.col("s_name").alias("value"), F.lit(3).alias("page"))
    found = s.select(F.col("s_suppkey").alias("report"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("double").alias("quantity"), F.lit("t").alias("unit"), F.lit(1).alias("page"))
    return X.project_digest(facts, _tables(spark, sf_dir), _anchors(spark, sf_dir), found, ["report"])
