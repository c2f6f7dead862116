"""Operators on reports: pages, tables, stated elements, materials, levels and gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import evidence as E

# Elements that a special assessment may be set for, and relations shown before all others.
ELEMENTS = ("大气", "地表水", "地下水", "声环境", "土壤", "生态", "环境风险", "海洋")
MAJOR_RELATIONS = (
    "CONTAINS_ARTICLE", "ARTICLE_REGULATES", "ARTICLE_DEFINES_VIOLATION",
    "ARTICLE_DEFINES_PENALTY", "ARTICLE_DEFINES_OBLIGATION", "SOURCE_EMITS_POLLUTANT",
    "CASE_VIOLATES", "CASE_INVOLVES_POLLUTANT", "CASE_INVOLVES_VIOLATION",
    "CASE_INVOLVES_POLLUTION_SOURCE", "CASE_INVOLVES_INDUSTRY", "CASE_INVOLVES_ORGANIZATION",
    "CASE_INVOLVES_ORG", "CASE_INVOLVES_REGION", "CASE_REGULATED_BY",
    "INDUSTRY_USES_TECH", "TECH_TREATS_POLLUTANT", "ORGANIZATION_REGULATES",
    "ORGANIZATION_DRAFTS_LIST", "ORGANIZATION_HANDLES_CASE", "SUPERSEDES",
)


def page_offsets(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent difference of physical and printed page by report, the smallest of equal ones."""
    d = labels.filter("printed is not null").groupBy(*keys, (F.col("physical") - F.col("printed")).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(*keys).agg(F.max_by("o", F.struct("n", -F.col("o"))).alias("shift"))


def special_quota(elements: DataFrame, keys: list[str], boards: Column) -> DataFrame:
    """Elements set, undecided and not set by report, and whether they exceed two, or three for circuit boards.

    ``elements``: keys, ord, element, set (null: undecided) and the columns of ``boards``.
    """
    named = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "element")))), lambda x: x["element"]), "、")
    d = elements.groupBy(*keys).agg(
        F.count_if("set").alias("n_set"), F.count_if(F.col("set").isNull()).alias("n_unknown"), F.max(F.when(boards, 3).otherwise(2)).alias("most"),
        named(F.col("set")).alias("is_set"), named(F.col("set").isNull()).alias("undecided"), named(~F.col("set")).alias("not_set"),
    )
    return d.withColumn("exceeds", F.col("n_set") > F.col("most"))


def pollutants(pages: DataFrame, keys: list[str], most: int = 6, around: int = 60) -> DataFrame:
    """Air pollutants of the first ``most`` hits of a report by page and place: names, pages, quotes and what hints at water.

    ``pages``: keys, page, text.
    """
    found = F.regexp_extract_all("text", F.lit(rf"(?s)(.{{0,{around}}}{E.POLLUTANTS}.{{0,{around}}})"), F.lit(1))
    hits = pages.select(*keys, "page", F.posexplode(found).alias("place", "quote"))
    w = Window.partitionBy(*keys).orderBy("page", "place")
    hits = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    hits = hits.withColumn("quote", F.trim(F.regexp_replace("quote", r"\s+", " ")))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("quote", F.lit(E.POLLUTANTS), F.lit(1))))))
    strong = F.col("quote").rlike(E.WATER_STANDARD)
    return hits.groupBy(*keys).agg(names.alias("names"), F.array_sort(F.collect_set("page")).alias("pages"), F.count_if(strong).alias("strong"), F.count_if(~strong & F.col("quote").rlike(E.WATER_ONLY)).alias("weak"))


def headings(lines: DataFrame, keys: list[str], pattern: str, first: int = 6) -> DataFrame:
    """The first line of each page, among its first ones, that is a heading. ``lines``: keys, n from 1, line."""
    return lines.filter((F.col("n") <= first) & F.col("line").rlike(pattern)).groupBy(*keys).agg(F.min_by("line", "n").alias("heading"))


def conclusion_pages(pages: DataFrame, key: str, score: Column, phrase: str, reach: int = 10) -> DataFrame:
    """First page with the phrase at most ``reach`` pages from the best-scored one, the first of equal ones."""
    d = pages.select(key, "page", score.alias("s"), F.contains("text", F.lit(phrase)).alias("has"))
    best = d.groupBy(key).agg(F.max_by("page", F.struct("s", -F.col("page"))).alias("best"))
    near = d.filter("has").join(best, key).filter(F.abs(F.col("page") - F.col("best")) <= reach)
    return best.join(near.groupBy(key).agg(F.min("page").alias("page")), key, "left")


def search(pages: DataFrame, keys: list[str], pattern: str, most: int) -> DataFrame:
    """The first hits of a pattern by report: page, place and match, in order of pages and places."""
    hits = pages.select(*keys, "page", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("place", "hit"))
    w = Window.partitionBy(*keys).orderBy("page", "place")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def candidate_pages(hints: Column, anchor: Column, last: Column, reach: int, most: int) -> Column:
    """Pages to ask about: those of hints first, then those around the anchor, each once, so many at most."""
    low, high = F.greatest(F.lit(1), anchor - reach), F.least(last, anchor + reach)
    around = F.when(anchor.isNotNull() & (low <= high), F.sequence(low, high))  # a sequence counts down where low is above high
    return F.slice(F.array_distinct(F.concat(hints, F.coalesce(around, F.slice(hints, 1, 0)))), 1, most)


def tier_states(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """State of a tier from its conditions: keys, raw, result (true, false, null for unknown), excluded (the same, of its exception).

    One satisfied condition is enough; a catch-all of other cases is satisfied by itself. An exception that holds
    takes the tier away; one that can't be decided makes a satisfied tier unknown.
    """
    catch_all = F.col("raw").startswith("其他")
    result = F.when(catch_all, True).otherwise(F.col("result"))
    d = conditions.groupBy(*keys).agg(
        F.max(F.when(result, 2).when(result.isNull(), 1).otherwise(0)).alias("state"),
        F.max(F.when(F.col("raw").rlike("[（(][^）)]*除外[^）)]*[）)]"), F.when(F.col("excluded"), 2).when(F.col("excluded").isNull(), 1).otherwise(0))).alias("exception"),
        F.bool_or(catch_all).alias("residual"),
    )
    name = F.when((F.col("state") == 0) | (F.coalesce("exception", F.lit(0)) == 2), "not_satisfied").when((F.col("state") == 1) | (F.coalesce("exception", F.lit(0)) == 1), "unknown").otherwise("satisfied")
    return d.select(*keys, name.alias("state"), "residual")


def q_items(materials: DataFrame, stated: DataFrame, key: str) -> DataFrame:
    """Sums of quantity over threshold by report against the stated one.

    materials: key, quantity, threshold; stated: key, q. A stated sum below one of its terms is a problem, one that
    differs too much or isn't there, or nothing to sum, is suspect.
    """
    term = F.col("quantity") / F.col("threshold")
    d = materials.filter("threshold is not null").groupBy(key).agg(F.sum(term).alias("total"), F.max(term).alias("largest"), F.count_if(F.col("quantity").isNull()).alias("lacking"))
    d = d.withColumn("total", F.coalesce("total", F.lit(0.0))).join(stated, key, "left")
    verdict = F.when(F.col("q").isNull(), "suspect").when(F.col("q") + 1e-9 < F.col("largest"), "problem").when(E.differs(F.col("q"), F.col("total"), F.col("total")), "suspect").otherwise("ok")
    return d.select(key, "total", "lacking", "q", verdict.alias("verdict"))


def hazard_levels(rows: DataFrame, matrix: DataFrame, potential: DataFrame) -> DataFrame:
    """Hazard class and potential of rows with q, m, e; below 1 the potential is the first level whatever the rest.

    matrix: q_row, m, p; potential: p, e, level: two small tables of rules.
    """
    q_row = F.when(F.col("q") < 1, 0).when(F.col("q") < 10, 1).when(F.col("q") < 100, 2).otherwise(3)
    d = rows.withColumn("q_row", F.when(F.col("q").isNotNull(), q_row)).join(matrix, ["q_row", "m"], "left").join(potential, ["p", "e"], "left")
    return d.withColumn("level", F.when(F.col("q_row") == 0, "Ⅰ").otherwise(F.col("level")))


def term_buckets(materials: DataFrame, key: str) -> DataFrame:
    """Materials by the catalogue's terms: key, bucket, total; what is neither glue nor paint has no bucket.

    A glue or paint that says nothing of its solvent counts as solvent-based if the report uses a solvent anywhere.
    materials: key, name, quantity.
    """
    uses = F.max(F.col("name").rlike("稀释剂|溶剂型").cast("int")).over(Window.partitionBy(key)) > 0
    low = F.col("name").rlike("水性|低VOC|UV")
    kind = F.when(F.col("name").rlike("胶"), "胶粘剂").when(F.col("name").rlike("漆|涂料"), "涂料")
    solvent = F.when(low, "低VOC").when(F.col("name").rlike("溶剂型|油性") | uses, "溶剂型").otherwise("未分")
    d = materials.withColumn("bucket", F.concat(solvent, kind))
    return d.filter("bucket is not null").groupBy(key, "bucket").agg(F.sum("quantity").alias("total"))


def matched_uploads(uploads: DataFrame, held: DataFrame) -> DataFrame:
    """The held file (smallest name) with an upload's size and digest; sizes are joined first, digests only of equal sizes."""
    pairs = uploads.select("upload", "size", F.col("digest").alias("d")).join(held.select("file", "size", "digest"), "size")
    same = pairs.filter(F.col("d") == F.col("digest")).groupBy("upload").agg(F.min("file").alias("file"))
    return uploads.select("upload").join(same, "upload", "left")


def neighbours(edges: DataFrame, major: bool = False) -> DataFrame:
    """Each node's neighbours, one a relation and direction: node, other, relation, outgoing. ``major``: of those relations alone."""
    e = edges.filter(F.col("relation").isin(*MAJOR_RELATIONS)) if major else edges
    out = e.select(F.col("a").alias("node"), F.col("b").alias("other"), "relation", F.lit(True).alias("outgoing"))
    return out.unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "relation", F.lit(False).alias("outgoing"))).distinct()
