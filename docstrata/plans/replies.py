"""Queries on replies, failed reranks and evidence after hits, with parts written into texts and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.replies import reply_fields
from docstrata.operators import search
from docstrata.plans.registry import register
from docstrata.sources.tables import table


@register("reply_parse", """
SELECT p_partkey, CASE k WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' END AS value, CASE WHEN k < 3 THEN p_size END AS page,
  CASE k WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN p_name || ' is used' WHEN 3 THEN p_name ELSE '' END AS anchor,
  CASE k WHEN 0 THEN '' WHEN 1 THEN '是' WHEN 2 THEN '否' WHEN 3 THEN '无法确定' ELSE '' END AS reason,
  CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'labels' WHEN 4 THEN 'fail' ELSE 'split' END AS parsed_by
FROM (SELECT *, p_partkey % 5 AS k FROM part)""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as JSON, in labelled lines, in pieces, unsure, and empty."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit('So: {"value": true, "page": '), size, F.lit(', "quote": "'), "p_type", F.lit('"}')))
        .when(k == 1, F.concat(F.lit("结论：是\n页码: 第"), size, F.lit("页；定位短语：: "), "p_name"))
        .when(k == 2, F.concat(F.lit("否；"), size, F.lit("； "), "p_name", F.lit(" is used")))
        .when(k == 3, F.concat(F.lit("无法确定\n"), "p_name"))
    )
    return reply_fields(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text").select("p_partkey", "reply.*")


@register("rerank_fallback", """
WITH h AS (SELECT p_size AS qid, p_partkey AS id, round(p_retailprice / 10000.0, 6) AS sim, CASE WHEN p_size % 3 = 0 AND p_partkey % 7 = 0 THEN NULL ELSE round(1 / (1 + p_partkey % 11), 6) END AS s FROM part),
f AS (SELECT *, CASE WHEN bool_and(s IS NOT NULL) OVER (PARTITION BY qid) THEN s END AS score FROM h)
SELECT qid, id, sim, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, sim DESC, id) AS BIGINT) AS place FROM f QUALIFY place <= 5""")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five parts of each size by a second score; where one part's score is lacking, by similarity."""
    p = table(spark, sf_dir, "part")
    hits = p.select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") / 10000.0, 6).alias("sim"))
    lacking = (F.col("p_size") % 3 == 0) & (F.col("p_partkey") % 7 == 0)
    scores = p.filter(~lacking).select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("id"), F.round(1 / (1 + F.col("p_partkey") % 11), 6).alias("score"))
    return search.reranked(hits, scores, 5)


@register("evidence_append", """
WITH h AS (SELECT p_size AS qid, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS BIGINT) AS index, p_name AS title, round(p_retailprice, 2) AS score FROM part WHERE p_size % 4 <> 0),
k AS (SELECT * FROM h WHERE index <= 4), n AS (SELECT qid, max(index) AS last FROM k GROUP BY qid),
e AS (SELECT DISTINCT p_size AS qid, p_brand AS title FROM part WHERE p_size <= 20)
SELECT * FROM k UNION ALL SELECT qid, coalesce(last, 0) + row_number() OVER (PARTITION BY qid ORDER BY title), title, NULL FROM e LEFT JOIN n USING (qid)""")
def evidence_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as evidence after up to four parts of each size; some sizes have no hit, some no evidence."""
    p = table(spark, sf_dir, "part")
    hits = search.numbered(p.filter("p_size % 4 <> 0").select(F.col("p_size").alias("qid"), "p_partkey", F.col("p_name").alias("title"), F.round("p_retailprice", 2).alias("score")), "p_partkey")
    evidence = p.filter("p_size <= 20").select(F.col("p_size").alias("qid"), F.col("p_brand").alias("title")).distinct()
    return search.appended(hits.filter("index <= 4").drop("p_partkey"), evidence, "title")
