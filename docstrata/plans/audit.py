"""Queries on reports: lines of documents and of orders stand in for pages, tables, elements and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import evidence as E
from docstrata.operators import reports as P
from docstrata.operators import rules as R
from docstrata.plans.registry import register
from docstrata.sources.tables import table

_PAGES = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's pages: the lines of a document, numbered from 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    return d.withColumn("page", F.col("page") + 1)


def _pick(n: Column, *values) -> Column:
    """The value whose number is the remainder of ``n``."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (n % len(values)).cast("int"))


@register("monotone_labels", """
WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders),
k AS (SELECT *, m IS NULL OR o_totalprice > m AS k FROM m), s AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (WHERE k) OVER (PARTITION BY o_custkey) AS s FROM k)
SELECT o_custkey, o_orderkey, o_totalprice FROM s WHERE k AND s >= greatest(3, n // 2)""")
def monotone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each customer that are above all before; customers that keep fewer than max(3, half) give none."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.rising(d, ["o_custkey"], [F.col("o_orderkey")], "o_totalprice")


@register("page_offset_mode", f"""
WITH {_PAGES}, o AS (SELECT doc_id, CASE WHEN page % 4 = 0 THEN 1 WHEN page % 3 = 0 THEN 5 ELSE 2 END AS o, count(*) AS n FROM p WHERE page % 5 > 0 GROUP BY ALL)
SELECT doc_id, CAST(arg_max(o, n * 10 - o) AS INTEGER) AS shift FROM o GROUP BY doc_id""")
def page_offset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page")
    shift = F.when(page % 4 == 0, 1).when(page % 3 == 0, 5).otherwise(2)
    labels = _pages(spark, sf_dir).select("doc_id", page.alias("physical"), F.when(page % 5 > 0, page - shift).alias("printed"))
    return P.page_offsets(labels, ["doc_id"])


_QUOTA = """
WITH e AS (SELECT o_orderkey, o_orderpriority, unnest(['大气', '地表水', '地下水', '声环境']) AS element, unnest([0, 1, 2, 3]) AS ord FROM orders),
s AS (SELECT *, CASE (o_orderkey + ord * ord) % 4 WHEN 0 THEN false WHEN 3 THEN NULL ELSE true END AS set FROM e)"""


@register("special_quota", f"""{_QUOTA}
SELECT o_orderkey, count(*) FILTER (WHERE set) AS n_set, count(*) FILTER (WHERE set IS NULL) AS n_unknown, CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 2 END AS most, coalesce(string_agg(element, '、' ORDER BY ord) FILTER (WHERE set), '') AS is_set,
  coalesce(string_agg(element, '、' ORDER BY ord) FILTER (WHERE set IS NULL), '') AS undecided, coalesce(string_agg(element, '、' ORDER BY ord) FILTER (WHERE NOT set), '') AS not_set, count(*) FILTER (WHERE set) > CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 2 END AS exceeds
FROM s GROUP BY o_orderkey, o_orderpriority""")
def special_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders, as reports, say of four elements in words, read and held against two elements or three."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.posexplode(F.array(*[F.lit(x) for x in P.ELEMENTS[:4]])).alias("ord", "element"))
    answer = _pick(F.col("o_orderkey") + F.col("ord") * F.col("ord"), "不设置", "设置专项评价", "需设置/", "见附件")
    return P.special_quota(d.withColumn("set", E.stated_set(answer)), ["o_orderkey"], F.col("o_orderpriority").startswith("1"))


@register("report_kind", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 3 >= o_orderkey % 3 THEN '报告书' ELSE '报告表' END AS kind FROM orders""")
def report_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by how often their names stand on the cover; the first kind wins ties."""
    cover = F.concat(F.repeat(F.lit("环境影响报告书 "), (F.col("o_custkey") % 3).cast("int")), F.lit("验收"), F.repeat(F.lit("环境影响报告表"), (F.col("o_orderkey") % 3).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.report_kind(cover).alias("kind"))


@register("pollutant_list", f"""
WITH {_PAGES}, h AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r, page % 4 AS k FROM p WHERE page % 4 <> 3),
t AS (SELECT * FROM h WHERE r <= 6)
SELECT doc_id, string_agg(DISTINCT CASE k WHEN 0 THEN '甲苯' WHEN 1 THEN '氨' ELSE '颗粒物' END, '|' ORDER BY CASE k WHEN 0 THEN '甲苯' WHEN 1 THEN '氨' ELSE '颗粒物' END) AS names, string_agg(CAST(page AS VARCHAR), '|' ORDER BY page) AS pages, count(*) FILTER (WHERE k = 0) AS strong, count(*) FILTER (WHERE k = 1) AS weak FROM t GROUP BY doc_id""")
def pollutant_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pollutants of the first six hits of a report; water standards and water pollutants beside them are told."""
    text = _pick(F.col("page"), "甲苯 参照 GB 8978", "氨 和氨氮", "颗粒物", "氨氮")
    d = P.pollutants(_pages(spark, sf_dir).withColumn("text", text), ["doc_id"])
    return d.select("doc_id", F.array_join("names", "|").alias("names"), F.array_join("pages", "|").alias("pages"), "strong", "weak")


@register("chapter_headings", f"""
WITH {_PAGES} SELECT doc_id, (page - 1) // 8 AS sheet, arg_min(text, page) AS heading FROM p WHERE (page - 1) % 8 < 6 AND regexp_matches(text, '^[A-Z]\\S* [a-z]') GROUP BY ALL""")
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of eight lines: the first of their first six lines that looks like a heading."""
    lines = _pages(spark, sf_dir).select("doc_id", F.floor((F.col("page") - 1) / 8).alias("sheet"), ((F.col("page") - 1) % 8 + 1).alias("n"), F.col("text").alias("line"))
    return P.headings(lines, ["doc_id", "sheet"], r"^[A-Z]\S* [a-z]")


@register("conclusion_page", f"""
WITH {_PAGES}, b AS (SELECT doc_id, arg_max(page, length(text) * 100000 - page) AS best FROM p GROUP BY doc_id)
SELECT b.doc_id, CAST(best AS INTEGER) AS best, CAST(min(page) FILTER (WHERE contains(text, ' de') AND abs(page - best) <= 10) AS INTEGER) AS page FROM b JOIN p USING (doc_id) GROUP BY b.doc_id, best""")
def conclusion_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.conclusion_pages(_pages(spark, sf_dir), "doc_id", F.length("text"), " de")


@register("page_search", f"""
WITH {_PAGES}, h AS (SELECT doc_id, page, l[i + 1] AS hit, i AS place FROM (SELECT *, unnest(range(len(l))) AS i FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]+[.]') AS l FROM p))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, place) AS rank FROM h) SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(place AS INTEGER) AS place, hit, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hits of a pattern in each report."""
    return P.search(_pages(spark, sf_dir), ["doc_id"], "[A-Z][a-z]+[.]", 5)


@register("candidate_pages", """
WITH c AS (SELECT p_partkey, p_size, list_distinct([p_size, 3]) AS d FROM part)
SELECT p_partkey, array_to_string(list_slice(CASE WHEN p_size = 3 THEN [3] ELSE [p_size, 3] END || CASE WHEN p_size % 2 = 0 THEN list_filter(range(greatest(1, p_size // 2 - 1), least(20, p_size // 2 + 1) + 1), lambda x: x <> p_size AND x <> 3) ELSE [] END, 1, 4), '|') AS pages FROM c""")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") / 2).cast("int"))
    pages = P.candidate_pages(F.array(F.col("p_size"), F.lit(3)), anchor, F.lit(20), 1, 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(pages, "|").alias("pages"))


@register("tier_catch_all", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'not_satisfied' WHEN 2 THEN 'unknown' WHEN 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'not_satisfied' WHEN 1 THEN 'unknown' ELSE 'satisfied' END WHEN 4 THEN 'satisfied' ELSE 'unknown' END AS state, o_orderkey % 6 IN (3, 4) AS residual FROM orders""")
def tier_catch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by the order's number: one true, all false, false and unknown, other cases with an exception, without, unknown alone."""
    k = F.col("o_orderkey") % 6
    row = lambda raw, result, excluded=None: F.struct(F.lit(raw).alias("raw"), F.lit(result).cast("boolean").alias("result"), (excluded if excluded is not None else F.lit(None)).cast("boolean").alias("excluded"))
    exception = F.when(F.col("o_custkey") % 3 == 0, True).when(F.col("o_custkey") % 3 == 2, False)
    conditions = F.when(k == 0, F.array(row("有电镀", True), row("喷漆", None))).when(k == 1, F.array(row("有电镀", False), row("喷漆", False))).when(k == 2, F.array(row("有电镀", False), row("喷漆", None)))
    conditions = conditions.when(k == 3, F.array(row("其他（仅切割的除外）", None, exception), row("喷漆", False))).when(k == 4, F.array(row("其他", None), row("喷漆", None))).otherwise(F.array(row("有电镀", None)))
    return P.tier_states(table(spark, sf_dir, "orders").select("o_orderkey", F.explode(conditions).alias("c")).select("o_orderkey", "c.*"), ["o_orderkey"])


@register("q_items", """
WITH m AS (SELECT l_orderkey, CASE WHEN l_quantity > 3 THEN l_quantity END AS quantity, CASE WHEN l_discount > 0.01 THEN 100.0 * l_suppkey + 10 END AS threshold FROM lineitem),
t AS (SELECT l_orderkey, coalesce(sum(quantity / threshold), 0.0) AS total, max(quantity / threshold) AS largest, count(*) FILTER (WHERE quantity IS NULL) AS lacking FROM m WHERE threshold IS NOT NULL GROUP BY l_orderkey),
s AS (SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN total WHEN 1 THEN total / 50 WHEN 2 THEN total + 0.3 END AS q FROM t)
SELECT l_orderkey, round(total, 6) AS total, lacking, round(q, 6) AS q, CASE WHEN q IS NULL THEN 'suspect' WHEN q + 1e-9 < largest THEN 'problem' WHEN abs(q - total) > greatest(0.005, 0.05 * greatest(total, 1e-9)) THEN 'suspect' ELSE 'ok' END AS verdict FROM t JOIN s USING (l_orderkey)""")
def q_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated sums that are right, too small for one term, too large, or not there."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_discount") > 0.01, 100.0 * F.col("l_suppkey") + 10).alias("threshold"))
    total = m.filter("threshold is not null").groupBy("l_orderkey").agg(F.coalesce(F.sum(F.col("quantity") / F.col("threshold")), F.lit(0.0)).alias("t"))
    k = F.col("l_orderkey") % 4
    stated = total.select("l_orderkey", F.when(k == 0, F.col("t")).when(k == 1, F.col("t") / 50).when(k == 2, F.col("t") + 0.3).alias("q"))
    out = P.q_items(m, stated, "l_orderkey")
    return out.select("l_orderkey", F.round("total", 6).alias("total"), "lacking", F.round("q", 6).alias("q"), "verdict")


_MATRIX = [(r, m, min(4, max(1, 5 - r - (4 - m) // 2))) for r in (1, 2, 3) for m in (1, 2, 3, 4)]
_POTENTIAL = [(p, e, ("Ⅳ+", "Ⅳ", "Ⅲ", "Ⅱ")[min(3, (p + e - 2) // 2 + (p > 2))]) for p in (1, 2, 3, 4) for e in (1, 2, 3)]


@register("hazard_levels", f"""
WITH m(q_row, m, p) AS (VALUES {", ".join(map(str, _MATRIX))}), v(p, e, level) AS (VALUES {", ".join(map(str, _POTENTIAL))}),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity * l_quantity / 10 END AS q, 1 + l_partkey % 4 AS m, 1 + l_suppkey % 4 AS e FROM lineitem),
b AS (SELECT *, CASE WHEN q < 1 THEN 0 WHEN q < 10 THEN 1 WHEN q < 100 THEN 2 WHEN q IS NOT NULL THEN 3 END AS q_row FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(m.p AS INTEGER) AS p, CASE WHEN q_row = 0 THEN 'Ⅰ' ELSE level END AS level FROM b LEFT JOIN m USING (q_row, m) LEFT JOIN v ON v.p = m.p AND v.e = b.e""")
def hazard_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of quantity, process and surroundings through two tables of rules; some have no quantity or no surroundings' class."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") <= 45, F.col("l_quantity") * F.col("l_quantity") / 10).alias("q"), (1 + F.col("l_partkey") % 4).cast("int").alias("m"), (1 + F.col("l_suppkey") % 4).cast("int").alias("e"))
    out = P.hazard_levels(rows, spark.createDataFrame(_MATRIX, "q_row int, m int, p int"), spark.createDataFrame(_POTENTIAL, "p int, e int, level string"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p", "level")


@register("term_buckets", """
WITH m AS (SELECT l_orderkey, l_quantity, l_partkey % 6 AS k FROM lineitem), u AS (SELECT *, max(CAST(k IN (1, 5) AS INT)) OVER (PARTITION BY l_orderkey) = 1 AS uses FROM m)
SELECT l_orderkey, CASE k WHEN 0 THEN '低VOC胶粘剂' WHEN 1 THEN '溶剂型涂料' WHEN 2 THEN CASE WHEN uses THEN '溶剂型胶粘剂' ELSE '未分胶粘剂' END WHEN 3 THEN '低VOC涂料' END AS bucket, sum(l_quantity) AS total FROM u WHERE k < 4 GROUP BY ALL""")
def term_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", _pick(F.col("l_partkey"), "水性胶水", "溶剂型涂料", "白乳胶", "UV漆", "钢材", "稀释剂").alias("name"), F.col("l_quantity").alias("quantity"))
    return P.term_buckets(m, "l_orderkey")


@register("upload_match", """
SELECT o_orderkey AS upload, CASE WHEN o_orderkey % 3 > 0 THEN (SELECT min(f.o_orderkey) FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderstatus = o.o_orderstatus AND f.o_orderkey % 3 = 0) END AS file FROM orders o""")
def upload_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads against held files: sizes first, then digests."""
    o = table(spark, sf_dir, "orders").withColumn("digest", F.sha1(F.concat_ws("|", "o_custkey", "o_orderstatus")))
    uploads = o.select(F.col("o_orderkey").alias("upload"), F.col("o_custkey").alias("size"), F.when(F.col("o_orderkey") % 3 > 0, F.col("digest")).otherwise("new").alias("digest"))
    held = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("size"), "digest")
    return P.matched_uploads(uploads, held)


@register("major_relations", """
WITH e AS (SELECT o_custkey % 50 AS a, o_orderkey % 60 AS b, CASE o_orderkey % 3 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'CASE_VIOLATES' END AS relation FROM orders WHERE o_orderkey % 3 < 2)
SELECT a AS node, b AS other, relation, true AS outgoing FROM e UNION SELECT b, a, relation, false FROM e""")
def major_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by relation and direction, each once, of the major relations."""
    edges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 60).alias("b"), _pick(F.col("o_orderkey"), "SUPERSEDES", "CASE_VIOLATES", "ISSUED_BY").alias("relation"))
    return P.neighbours(edges, major=True)


@register("report_totals", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS skipped, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS done, round(sum(CASE WHEN value > 100 THEN value END), 4) AS ms, count(*) FILTER (WHERE value > 100) AS filled, count(*) AS fields FROM events GROUP BY user_id""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a converter's runs, of a trace's times and of filled fields."""
    kind = F.col("event_type")
    value = F.when(F.col("value") > 100, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "error").alias("failed"), F.count_if(kind == "view").alias("skipped"), F.count_if(~kind.isin("error", "view")).alias("done"),
        F.round(F.sum(value), 4).alias("ms"), F.count(value).alias("filled"), F.count(F.lit(1)).alias("fields"),
    )


@register("photo_items", """
WITH i AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN '符合' WHEN 1 THEN '不符合' WHEN 2 THEN '无法判断' ELSE '无法判断' END AS verdict, turn % 4 = 3 AS coerced, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE length(trim(text)) > 0)
SELECT conv_id, count(*) FILTER (WHERE r <= 8) AS kept, count(*) FILTER (WHERE r > 8) AS dropped, count(*) FILTER (WHERE r <= 8 AND coerced) AS coerced, count(*) FILTER (WHERE r <= 8 AND verdict = '不符合') AS against FROM i GROUP BY conv_id""")
def photo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a photo's checklist: verdicts outside of the three known become undecided, eight are kept."""
    from pyspark.sql import Window

    said = _pick(F.col("turn"), "符合", "不符合", "无法判断", "也许")
    known = said.isin("符合", "不符合", "无法判断")
    d = table(spark, sf_dir, "conversations").filter(F.length(F.trim("text")) > 0)
    d = d.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) <= 8).alias("in"), F.when(known, said).otherwise("无法判断").alias("verdict"), (~known).alias("odd"))
    return d.groupBy("conv_id").agg(F.count_if("in").alias("kept"), F.count_if(~F.col("in")).alias("dropped"), F.count_if(F.col("in") & F.col("odd")).alias("coerced"), F.count_if(F.col("in") & (F.col("verdict") == "不符合")).alias("against"))


@register("rotating_examples", """
SELECT conv_id, unnest([0, 1, 2]) AS k, (conv_id * 3 + unnest([0, 1, 2])) % 7 AS example FROM (SELECT DISTINCT conv_id FROM conversations)""")
def rotating_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of seven examples a session, from a cursor that stays the same within it."""
    d = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    return d.select("conv_id", "k", F.pmod(F.col("conv_id") * 3 + F.col("k"), F.lit(7)).alias("example"))


@register("pinned_first", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS pinned, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, o_orderkey, pinned, 'F' || rank AS fact FROM r WHERE rank <= 20""")
def pinned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest twenty of each customer, pinned ones first, numbered as facts are."""
    from pyspark.sql import Window

    pinned = F.col("o_orderstatus") == "F"
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(pinned.desc(), F.col("o_orderdate").desc(), "o_orderkey"))
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", pinned.alias("pinned"), rank.alias("rank")).filter("rank <= 20")
    return d.select("o_custkey", "o_orderkey", "pinned", F.concat(F.lit("F"), F.col("rank").cast("string")).alias("fact"))


@register("material_tables", """
WITH t AS (SELECT l_orderkey, l_suppkey AS page, max(l_quantity) AS affinity FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY affinity DESC, page) AS rank FROM t)
SELECT l_orderkey, string_agg(CAST(page AS VARCHAR), '|' ORDER BY rank) AS pages, string_agg(DISTINCT CAST(page AS VARCHAR), '|' ORDER BY CAST(page AS VARCHAR)) AS either FROM r WHERE rank <= 6 GROUP BY l_orderkey""")
def material_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's six tables of most affinity, earlier pages first among equals, and the union of the pages of two anchors."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("page")).agg(F.max("l_quantity").alias("affinity"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("affinity"), "page"))).filter("rank <= 6")
    page = F.col("page").cast("string")
    pages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", page.alias("p")))), lambda x: x["p"]), "|")
    odd, even = (F.collect_set(F.when(F.col("rank") % 2 == k, page)) for k in (1, 0))
    return t.groupBy("l_orderkey").agg(pages.alias("pages"), F.array_join(F.array_sort(F.array_union(odd, even)), "|").alias("either"))


@register("page_helpers", f"""
WITH {_PAGES}, n AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM p), r AS (SELECT *, least(greatest(doc_id % 7 - 1, 1), last) AS want FROM n)
SELECT doc_id, CAST(any_value(want) AS INTEGER) AS page, max(CASE WHEN page = want THEN text END) AS text, coalesce(bool_or(page = want AND length(trim(text)) < 20), false) AS empty, string_agg(text, chr(10) ORDER BY page) FILTER (WHERE page BETWEEN 2 AND 3) AS range_text FROM r GROUP BY doc_id""")
def page_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by a number that is brought into range, whether it has next to no text, and the text of pages 2 and 3."""
    d = _pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    page = F.least(F.greatest(F.col("doc_id") % 7 - 1, F.lit(1)), F.size("p")).cast("int")
    text = F.get("p", page - 1)["text"]
    joined = F.array_join(F.transform(F.filter("p", lambda x: x["page"].between(2, 3)), lambda x: x["text"]), "\n")
    return d.select("doc_id", page.alias("page"), text.alias("text"), (F.length(F.trim(text)) < 20).alias("empty"), F.when(F.size("p") > 1, joined).alias("range_text"))


@register("known_fields", """
SELECT doc_id, unnest(['lang', 'source', 'n_chars']) AS field, unnest([lang, CASE WHEN doc_id % 2 = 0 THEN source END, CAST(nullif(n_chars % 3, 0) AS VARCHAR)]) AS value FROM documents""")
def known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a form as rows, empty ones null."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"), F.nullif(F.col("n_chars") % 3, F.lit(0)).cast("string").alias("n_chars"))
    return d.unpivot("doc_id", ["lang", "source", "n_chars"], "field", "value")


@register("evidence_groups", """
SELECT l_orderkey, l_returnflag, count(*) AS n, string_agg(DISTINCT CASE WHEN l_linenumber = 1 THEN '填报' ELSE 'P' || l_linenumber END, '、' ORDER BY CASE WHEN l_linenumber = 1 THEN '填报' ELSE 'P' || l_linenumber END) AS pages, bool_or(l_shipdate > TIMESTAMP '1997-01-01') AS stale, strftime(max(l_shipdate), '%Y-%m-%d %H:%M') AS stamp FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by item with their pages, where page -1 stands for the form, and whether a source is newer than the result."""
    page = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).otherwise(-1)
    shown = F.when(page == -1, "填报").otherwise(F.concat(F.lit("P"), page.cast("string")))
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag")
    return d.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(shown)), "、").alias("pages"), F.bool_or(F.col("l_shipdate") > F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).alias("stale"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd HH:mm").alias("stamp"))
