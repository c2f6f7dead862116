"""Queries on rule texts and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import conditions as C
from docstrata.plans.registry import register
from docstrata.sources.tables import spread, table


@register("condition_parse", """
SELECT p_partkey, 'threshold' AS kind, '年产' || p_type AS keyword, CAST(p_size AS DOUBLE) AS value, '吨' AS unit, CASE WHEN p_size % 3 = 0 THEN '<=' ELSE '>=' END AS cmp FROM part
UNION ALL SELECT p_partkey, 'threshold', '或仓库', 10, '平方米', '<=' FROM part
UNION ALL SELECT p_partkey, 'qualitative', unnest(['其他', '二', '有电镀工艺的']), NULL, NULL, NULL FROM part
UNION ALL SELECT p_partkey, 'threshold', lower(p_type), p_size + 0.5, '万立方米', '>' FROM part""")
def condition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of rule texts that parts' types and sizes are written into: several a clause, with and without a rest."""
    word = F.when(F.col("p_size") % 3 == 0, "及以下").when(F.col("p_size") % 3 == 1, "及以上").otherwise("")
    text = F.concat(F.lit("年产"), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("吨（约）"), word, F.lit("或仓库10平方米以下；其他；二;"), F.lower("p_type"), (F.col("p_size") + 0.5).cast("string"), F.lit("万立方米大于，有电镀工艺的"))
    d = spread(table(spark, sf_dir, "part")).select("p_partkey", F.explode(C.conditions_of(text)).alias("c"))
    return d.select("p_partkey", "c.kind", "c.keyword", "c.value", "c.unit", "c.cmp")


@register("industry_codes", r"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '5000' ELSE '' END || '|' || CASE WHEN p_size >= 10 THEN CAST(p_size * 100 AS VARCHAR) ELSE CAST(p_size * 100 AS VARCHAR) END AS codes FROM part""")
def industry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in names that also hold an amount: 5000 counts for even parts, where no unit follows it."""
    size = (F.col("p_size") * 100).cast("string")
    text = F.concat(F.lit("代码"), size, F.lit("、"), F.when(F.col("p_partkey") % 2 == 0, "5000类").otherwise("5000平方米"))
    codes = C.industry_codes(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.array_contains(F.slice(codes, 2, 1), "5000"), "5000").otherwise(""), F.lit("|"), codes[0]).alias("codes"))


@register("form_validate", """
WITH v AS (SELECT o_orderkey AS form, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL
  SELECT o_orderkey, 'price', CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END FROM orders UNION ALL
  SELECT o_orderkey, 'note', o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
SELECT form, key, 'invalid' AS fault FROM v WHERE key = 'status' AND value NOT IN ('F', 'O') UNION ALL
SELECT form, key, 'invalid' FROM v WHERE key = 'price' AND TRY_CAST(value AS DOUBLE) IS NULL UNION ALL
SELECT o_orderkey, 'clerk', 'missing' FROM orders UNION ALL SELECT form, key, 'unknown' FROM v WHERE key = 'note'""")
def form_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    field = lambda key, value: o.select(F.col("o_orderkey").alias("form"), F.lit(key).alias("key"), value.alias("value"))
    values = field("status", F.col("o_orderstatus")).unionByName(field("price", F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))))
    values = values.unionByName(field("note", F.col("o_orderpriority")).filter("form % 2 = 0"))
    schema = spark.createDataFrame([("status", "enum", True, ["F", "O"]), ("price", "float", True, None), ("clerk", "str", True, None), ("remark", "str", False, None)], "key string, type string, required boolean, choices array<string>")
    return C.form_faults(values, schema)
