"""Queries on quotes, cells, sources and names, with tables of the star schema written into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import evidence as E
from docstrata.functions import text as T
from docstrata.plans.registry import register
from docstrata.sources.tables import spread, table

S = lambda c: F.col(c).cast("string")


def _cat(*parts: str | Column) -> Column:
    """Parts side by side; strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@register("latex_text", r"""
SELECT p_partkey, '不大于1.0×10⁻' || translate(CAST(p_size AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' cm/s' AS a, 'a ≠ b, x ≈ ' || p_size || ', 90^°' AS b, '6~' || p_size || ' 1/' || p_size || ' √2 H2O' AS c FROM part""")
def latex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas with symbols, units, powers, ranges, fractions, roots and indices."""
    n = S("p_size")
    a = _cat(r"不大于1.0{\times}10^{\cdot", n, r"}\,\mathrm{cm/s}")
    b = _cat(r"a \neq b, x \approx ", n, r", 90^{\circ}")
    c = _cat(r"6{\sim}", n, r" \frac{1}{", n, r"} \sqrt{2} \unknown H_{2}O")
    return table(spark, sf_dir, "part").select("p_partkey", *[T.latex_to_text(x).alias(k) for k, x in (("a", a), ("b", b), ("c", c))])


@register("inline_formulas", r"""
SELECT p_partkey, '当 ' || p_name || p_size || ' × 10⁻' || translate(CAST(p_size AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' m/s 时，' || p_type || ' ≥ 1/' || p_size || ' ，共' || p_size || '个， 价 ' || p_retailprice AS text FROM part""")
def inline_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two formulas in a sentence, one dollar sign alone, a command outside and brackets that are left empty."""
    n = S("p_size")
    text = _cat("当$", F.col("p_name"), "_{", n, r"} {\times} 10^{-", n, r"}\,\mathrm{m/s}$时，", F.col("p_type"), r"$\geq \frac{1}{", n, "}$，共", n, r"个（$ \unknown $）， 价 \mathrm $", F.col("p_retailprice").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.inline_formulas(text).alias("text"))


@register("cell_cleanup", "SELECT p_partkey, '环境风险' || p_name || ' 评价 A' AS cell FROM part")
def cell_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _cat("  环境 \n 风 险", F.replace("p_name", F.lit(" "), F.lit("\t ")), "  评\n价  A ")
    return table(spark, sf_dir, "part").select("p_partkey", E.cell_text(cell).alias("cell"))


@register("squeezed_find", r"""
WITH n AS (SELECT doc_id, text AS t, regexp_replace(string_split(text, chr(10))[-1], '\s', '', 'g') AS needle, regexp_replace(text, '\s', '', 'g') AS s FROM documents),
p AS (SELECT *, instr(s, needle) AS p, list_filter(range(1, length(t) + 1), lambda i: NOT regexp_matches(t[i], '\s')) AS places FROM n)
SELECT doc_id, CAST(CASE WHEN needle <> '' AND p > 0 THEN places[p] END AS INTEGER) AS a, CAST(CASE WHEN needle <> '' AND p > 0 THEN places[p + length(needle) - 1] END AS INTEGER) AS z FROM p""")
def squeezed_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's last line stands in it first, blanks left out of the question."""
    d = table(spark, sf_dir, "documents").select("doc_id", E.squeezed_find(F.col("text"), F.substring_index("text", "\n", -1)).alias("s"))
    return d.select("doc_id", F.col("s.begin").alias("a"), F.col("s.end").alias("z"))


@register("longest_fragment", """
WITH l AS (SELECT p_partkey, string_split(p_name, ' ') || [p_type] AS l FROM part),
f AS (SELECT p_partkey, arg_max(x, length(x) * 100 - i) AS f FROM (SELECT p_partkey, unnest(l) AS x, unnest(range(len(l))) AS i FROM l) WHERE length(x) >= 6 GROUP BY p_partkey)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '名 录' ELSE coalesce(f, '') END AS fragment FROM part LEFT JOIN f USING (p_partkey)""")
def longest_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of a name and a type; no page, or a page that holds a short anchor whole, or one that holds both parts apart."""
    kind = F.col("p_partkey") % 4
    page = F.when(kind == 0, "").when(kind == 1, "分类管理名录").otherwise(_cat(F.replace("p_type", F.lit("O"), F.lit(" O")), " / ", F.col("p_name")))
    anchor = F.when(kind == 1, "名 录").otherwise(_cat("名录条目：1；", F.col("p_name"), "｜", F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", E.longest_fragment(page, anchor).alias("fragment"))


@register("quote_keywords", """
SELECT p_partkey, '环境风险评价|保护目标|437296226' || '|abc' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '|环境风险评价437296226保护目标abc' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '一' AS words FROM part""")
def quote_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = _cat("环境风险评价 437296226 保护目标 abc", F.lpad(S("p_size"), 3, "0"), " 一")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(E.quote_keywords(quote), "|").alias("words"))


@register("table_match", """
SELECT p_partkey, p_size || '|CO|随烟气排放|7.5' AS cells, CASE WHEN p_size >= 20 AND p_size % 10 <> 7 THEN 1 ELSE 0 END AS found FROM part""")
def table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two tables that holds all cells of a row: sizes of 20 or more stand in the second, or across cells (12|7.5 holds 27)."""
    cells = E.quote_cells(_cat(S("p_size"), " | CO\t随烟气排放  — ｜ 7.5 | / "))
    some = lambda a, b: F.concat(F.array(F.array(F.lit("气体"), F.lit("CO 随烟气 排放"))), F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.array(i.cast("string"), F.lit("7.5"))))
    tables = F.array(some(10, 19), some(10, 60))
    fits = F.filter(F.transform(tables, lambda t, i: F.when(E.holds_cells(t, F.col("row")), i)), lambda i: i.isNotNull())
    d = spread(table(spark, sf_dir, "part")).withColumn("row", cells)
    return d.select("p_partkey", F.array_join("row", "|").alias("cells"), F.get(fits, F.lit(0)).alias("found"))


@register("lead_names", "SELECT p_partkey, CASE WHEN length(p_type) >= 2 THEN '学校|' || p_type || '|批发市场' END AS names FROM part")
def lead_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = _cat("学校 8334*、其他", F.col("p_type"), " 52；含批发市场，第3类、店（建筑面积", S("p_size"), "平方米及以上的）；其他")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(E.lead_names(category), "|").alias("names"))


@register("pre_sql_split", """
SELECT p_partkey, unnest([1, 2]) AS k, unnest(['SELECT ' || p_size, 'with x as (select 1)' || chr(10) || 'select * from x']) AS statement FROM part""")
def pre_sql_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _cat("前置1：查询企业：\nSELECT ", S("p_size"), "\n前置2: with x as (select 1)\nselect * from x \n前置3：说明\n前置：DELETE\nfrom t")
    d = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(E.pre_statements(text)).alias("k", "statement"))
    return d.select("p_partkey", (F.col("k") + 1).alias("k"), "statement")


@register("roman_levels", "SELECT p_partkey, ['Ⅰ', 'Ⅱ', 'Ⅲ', 'Ⅳ', 'Ⅳ+', 'Ⅴ', ''][p_size % 7 + 1] AS level FROM part")
def roman_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.get(F.array(*[F.lit(x) for x in ("i", " II", "Iii ", "IV", "iv+", "Ⅴ", "")]), F.col("p_size") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", E.roman_level(spelled).alias("level"))


@register("general_format", "SELECT o_orderkey, printf('%g', o_totalprice / 7.77) AS price, printf('%g', o_totalprice / 7.1e9) AS small, printf('%g', o_totalprice * 70.7) AS large, CASE WHEN o_orderkey % 2 = 0 THEN printf('%d|%d.0', o_custkey, o_custkey) ELSE printf('%d', o_custkey) END AS forms FROM orders")
def general_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    forms = F.sort_array(E.number_spellings(_cat(S("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.general_format(price / 7.77).alias("price"), E.general_format(price / 7.1e9).alias("small"), E.general_format(price * 70.7).alias("large"), F.array_join(forms, "|").alias("forms"))


@register("column_find", "SELECT p_partkey, 2 AS quantity, CASE WHEN p_size % 2 = 0 THEN 1 END AS kind, p_name AS value FROM part")
def column_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by words of the header, and the first value behind a label and merged, empty cells."""
    header = F.array(F.lit("序号"), F.when(F.col("p_size") % 2 == 0, "类型").otherwise("备注"), F.lit("最大贮存量（t）"), F.lit("年用量"))
    row = F.array(F.lit("表1"), F.lit("建设项目名称"), F.lit(""), F.lit("-"), F.col("p_name"), F.lit("别的"))
    return table(spark, sf_dir, "part").select("p_partkey", E.first_column(header, ["贮存量", "年用量"]).alias("quantity"), E.first_column(header, ["类型"]).alias("kind"), E.value_after(row, "项目名称").alias("value"))


@register("authority_need", """
SELECT p_partkey, p_partkey % 4 = 0 AS authority, p_partkey % 3 = 0 AS abolished, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS need FROM part""")
def authority_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) for v in x]), (F.col("p_partkey") % n).cast("int"))
    source = _cat(pick(4, "环评导则", "案例", "项目", "其他/环评导则"), "/", F.col("p_name"), ".md")
    question = _cat(pick(4, "gb/T 8978 ", "现行名录 ", "这家公司 ", "你好 "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", E.is_authority(source).alias("authority"), E.is_abolished(pick(3, " 已废止 ", "有效", None)).alias("abolished"), E.authority_need(question).alias("need"))


@register("snippet_guards", "SELECT p_partkey, p_partkey % 3 = 2 AS asserts, p_partkey % 2 = 1 AND p_size > 10 AS citable FROM part")
def snippet_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snippets state something, and which facts have a page and a quote."""
    snippet = F.get(F.array(_cat(F.col("p_name"), "无法判断"), _cat("是否", F.col("p_name"), "直排？"), _cat("是否直排：否", F.col("p_name"))), (F.col("p_partkey") % 3).cast("int"))
    page, quote = F.when(F.col("p_partkey") % 2 == 1, F.col("p_size")), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", E.asserts(snippet).alias("asserts"), (F.coalesce(page, F.lit(0)) > 0).__and__(F.trim(quote) != "").alias("citable"))


@register("ecological_rule", """
SELECT p_partkey, contains(p_type, 'E') AND NOT contains(p_name, 'small') AND (contains(p_name, 'widget') OR contains(p_name, 'gear')) AND p_size % 2 = 0 AS applies, contains(p_type, 'O') AS plain FROM part""")
def ecological_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _cat(F.col("p_type"), " ", F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "水库").otherwise("路"))
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    rule = E.applies(text, words("E"), words("widget", "gear"), words("水库", "河"), words("small"))
    return table(spark, sf_dir, "part").select("p_partkey", rule.alias("applies"), E.applies(F.col("p_type"), words("O"), words(), words(), words()).alias("plain"))


@register("path_safe", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'a/' || p_name || '.md' WHEN 1 THEN 'a/../' || p_name || '.MD' END AS path,
  CASE p_size % 4 WHEN 1 THEN 'format' WHEN 2 THEN 'encoding' WHEN 3 THEN CASE WHEN length(p_name) + 23 > 32 THEN 'size' END END AS image FROM part""")
def path_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    pick = lambda n, *x: F.get(F.array(*x), F.col("p_size") % n)
    path = pick(5, _cat(" /a\\", name, ".md"), _cat("a/../", name, ".MD"), _cat("a/../../", name, ".md"), _cat("../a/", name, ".md"), _cat(name, ".pdf"))
    image = pick(4, F.lit(""), _cat("data:text/plain;base64,", name), _cat("data:image/png,", name), _cat(" data:image/png;base64,", name, "x "))
    return table(spark, sf_dir, "part").select("p_partkey", E.safe_path(path).alias("path"), E.image_fault(image, 32).alias("image"))


@register("embed_text", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '【' || p_name || '】 ' || p_type || chr(10) || chr(10) || 'x' WHEN 1 THEN '【' || p_name || '】' || chr(10) || chr(10) || 'x' WHEN 2 THEN p_type || chr(10) || chr(10) || 'x' ELSE 'x' END AS embed,
  '[' || p_size || '] 《' || p_name || '》' || CASE p_size % 4 WHEN 0 THEN '（' || p_brand || '，发布：部，时效状态：已废止 —— 旧）' WHEN 1 THEN '（' || p_brand || '）' WHEN 2 THEN '（时效状态：现行）' ELSE '' END || chr(10) || p_type AS block FROM part""")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    only = lambda value, *kinds: F.when(k.isin(*kinds), value).otherwise("")
    block = E.source_block(F.col("p_size"), F.col("p_name"), only(F.col("p_brand"), 0, 1), F.lit(None), only("部", 0), F.lit(""), F.when(k == 0, "已废止").when(k == 2, " 现行 "), only("旧", 0, 1), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", E.embed_text(only(F.col("p_name"), 0, 1), only(F.col("p_type"), 0, 2), F.lit("x")).alias("embed"), block.alias("block"))


@register("node_views", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE 'n' || p_partkey END AS name, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN '《法》第' || p_size || '条' ELSE '' END AS suggested, CAST(CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS filled, left(p_name, 4) || '…|' || p_type || '|a b|c' AS digest FROM part""")
def node_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nodes, names for suggestions, properties that aren't empty, and a digest of sources."""
    k, e = F.col("p_size") % 4, F.lit("")
    pairs = {"name_zh": F.when(k == 0, F.col("p_name")).otherwise(e), "title": F.when(k < 2, F.col("p_type")).otherwise(e), "parent_doc": F.when(k == 2, "法").otherwise(e), "article_no": F.when(k == 2, _cat("第", S("p_size"), "条")).otherwise(e), "name": e, "full_name": e}
    props = F.create_map(*[x for kv in pairs.items() for x in (F.lit(kv[0]), kv[1])])
    node = _cat("n", S("p_partkey"))
    lines = E.digest(F.array(F.col("p_name"), _cat(" ", F.col("p_type"), "\n"), F.lit("a \n b"), F.lit("c"), F.lit("d")), 4, 4)
    d = table(spark, sf_dir, "part")
    whole = E.digest(F.array(F.col("p_name"), F.lit("a \n b"), F.lit("c"), F.lit("d"), F.lit("e")), 3, 4)
    return d.select("p_partkey", E.node_name(node, props).alias("name"), E.suggested_name(node, props).alias("suggested"), F.size(E.node_props(props)).alias("filled"), F.array_join(F.concat(F.slice(whole, 1, 1), F.array("p_type"), F.slice(lines, 3, 2)), "|").alias("digest"))


@register("citation_warning", """
WITH c AS (SELECT o_custkey, count(*) AS n, string_agg('GB ' || o_orderkey, '、' ORDER BY o_orderkey) FILTER (WHERE r <= 8) AS items FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey)
SELECT o_custkey, chr(10) || chr(10) || '⚠️【依据校验未通过】以下依据没有在本次检索到的资料中逐字出现，请人工核对后再对外使用：' || items || CASE WHEN n > 8 THEN ' 等 ' || n || ' 项' ELSE '' END || '。（本条由系统自动校验生成，不代表正文其他内容有误。）' AS warning FROM c""")
def citation_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return codes.select("o_custkey", E.citation_warning(F.transform("k", lambda x: F.concat(F.lit("GB "), x.cast("string")))).alias("warning"))


@register("bool_evidence", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'topic' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'negated' END WHEN 3 THEN CASE WHEN p_partkey % 2 = 1 THEN 'not negated' END WHEN 4 THEN NULL ELSE CASE WHEN p_partkey % 2 = 0 THEN 'negated' END END AS fault FROM part""")
def bool_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes for a yes (even parts) or a no: none, of another topic, negated, plain, equal to a negation, negated equals."""
    k = F.col("p_size") % 6
    quote = F.when(k == 0, " ").when(k == 1, F.col("p_name")).when(k == 2, "工业废水 不外排").when(k == 3, "工业废水排入河道").when(k == 4, "废水纳管").otherwise("废水不直排")
    return table(spark, sf_dir, "part").select("p_partkey", E.boolean_fault(F.col("p_partkey") % 2 == 0, quote, F.lit("是否新增工业废水直排")).alias("fault"))


@register("negation_facts", "SELECT p_partkey, p_size % 5 IN (0, 1) AS negated FROM part")
def negation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negation close before or behind a condition counts, one further off or in another sentence doesn't."""
    k = F.col("p_size") % 5
    text = F.when(k == 0, "本项目不采用电镀工艺。").when(k == 1, "电镀工艺部分没有").when(k == 2, "没有厂房。电镀工艺").when(k == 3, "本项目采用电镀工艺").otherwise("未建一二三四五六七八九十一二三四五电镀工艺")
    return table(spark, sf_dir, "part").select("p_partkey", E.negated(text, F.lit("电镀工艺的")).alias("negated"))


#: A nested value and a text that bears some of it, as SQL for Spark and DuckDB.
_NESTED = """concat('{"name": "', p_name, '", "sizes": [', CAST(p_size AS STRING), ', ', CAST(p_partkey AS STRING), '], "more": {"brand": "', p_brand, '", "sold": true, "note": ', CASE WHEN p_size % 7 = 0 THEN 'null' WHEN p_size % 7 = 1 THEN '{}' WHEN p_size % 7 = 2 THEN '""' ELSE concat('["', p_type, '"]') END, '}}')"""
_SAID = "concat(CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(p_name, '，') END, CAST(p_size AS STRING), ' 个，', CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE lower(p_brand) END, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS STRING) ELSE '' END, CASE WHEN p_size % 2 = 0 THEN concat('（', p_type, '）') ELSE '' END)"
_BARE = """regexp_replace({0}, '[\\s，。、；：！？,.;:!?（）()\\[\\]【】《》"''“”‘’\\-—~·]', '', 'g')"""


@register("nested_evidence", f"""
WITH d AS (SELECT *, {_BARE.format(_SAID.replace("STRING", "VARCHAR"))} AS t FROM part),
f AS (SELECT p_partkey, list_filter([
  CASE WHEN NOT contains(t, {_BARE.format("p_brand")}) THEN 'more.brand|not said: ' || p_brand END,
  CASE WHEN p_size % 7 = 0 THEN 'more.note|null' END,
  CASE WHEN p_size % 7 > 2 AND NOT contains(t, {_BARE.format("p_type")}) THEN 'more.note[0]|not said: ' || p_type END,
  CASE WHEN NOT contains(t, {_BARE.format("p_name")}) THEN 'name|not said: ' || p_name END,
  CASE WHEN NOT contains(t, CAST(p_size AS VARCHAR)) THEN 'sizes[0]|number ' || p_size END,
  CASE WHEN NOT contains(t, CAST(p_partkey AS VARCHAR)) THEN 'sizes[1]|number ' || p_partkey END], lambda x: x IS NOT NULL) AS f FROM d)
SELECT p_partkey, len(f) = 0 AS ok, array_to_string(f, '; ') AS faults FROM f""")
def nested_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, lists and objects in objects, held leaf by leaf against a text."""
    d = spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_NESTED).alias("value"), F.expr(_SAID).alias("text"))
    out = E.leaf_faults(d, ["p_partkey"], "value", "text")
    return out.select("p_partkey", "ok", F.array_join(F.transform("faults", lambda x: F.concat_ws("|", x["path"], x["reason"])), "; ").alias("faults"))
