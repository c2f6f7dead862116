"""Queries on the graph of regions, nations, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import graph
from docstrata.plans.registry import register
from docstrata.sources.tables import table

_N = """
WITH nodes AS (
  SELECT 'r' || r_regionkey AS id, 'region' AS label, r_name AS name FROM region UNION ALL
  SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL
  SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier),
edges AS (
  SELECT 'n' || n_nationkey AS from_id, 'r' || n_regionkey AS to_id, 'in' AS rel FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, 'of' FROM customer UNION ALL
  SELECT 's' || s_suppkey, 'n' || s_nationkey, 'of' FROM supplier),
e2 AS (SELECT from_id AS id, to_id AS other FROM edges UNION ALL SELECT to_id, from_id FROM edges),
deg AS (SELECT n.*, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM e2 GROUP BY id) d USING (id))"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: table(spark, sf_dir, name)
    node = lambda name, p, key, shown: t(name).select(F.concat(F.lit(p), key).alias("id"), F.lit(name).alias("label"), F.col(shown).alias("name"))
    edge = lambda name, p, key, q, to, rel: t(name).select(F.concat(F.lit(p), key).alias("from_id"), F.concat(F.lit(q), to).alias("to_id"), F.lit(rel).alias("rel"))
    nodes = node("region", "r", "r_regionkey", "r_name").unionByName(node("nation", "n", "n_nationkey", "n_name")).unionByName(node("customer", "c", "c_custkey", "c_name")).unionByName(node("supplier", "s", "s_suppkey", "s_name"))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey", "in").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey", "of")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey", "of"))
    return graph.degrees(nodes, edges), edges


@register("graph_degree", f"{_N} SELECT id, label, degree FROM deg")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("id", "label", "degree")


@register("graph_suggest", f"""{_N},
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) AS n FROM deg WHERE degree > 0 AND length(name) >= 2)
SELECT d.label, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (WHERE coalesce(length(name), 0) = 0) AS BIGINT) AS unnamed, max(degree) AS max_degree,
       coalesce(any_value(x.examples), '') AS examples
FROM deg d LEFT JOIN (SELECT label, string_agg(name, '|' ORDER BY n) AS examples FROM o WHERE n <= 5 GROUP BY label) x ON x.label = d.label GROUP BY d.label""")
def graph_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.suggestions(_graph(spark, sf_dir)[0], 5)


_QUERY = "nation_1"
_SCORE = f"""CASE WHEN lower(name) = '{_QUERY}' THEN 200 WHEN contains(lower(name), '{_QUERY}') THEN 140
  WHEN name <> '' AND contains('{_QUERY}', lower(name)) THEN least(length(name), 30) + 120 WHEN contains(lower(name || ' ' || label), '{_QUERY}') THEN 18 ELSE 0 END"""


@register("graph_search", f"""{_N},
sc AS (SELECT id, degree, {_SCORE} AS score FROM deg),
rt AS (SELECT id, row_number() OVER (ORDER BY score DESC, degree DESC, id DESC) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 8),
h1 AS (SELECT e2.other AS id, min(rank) AS rank FROM rt JOIN e2 USING (id) GROUP BY e2.other HAVING e2.other NOT IN (SELECT id FROM rt)),
h2 AS (SELECT e2.other AS id, min(rank) AS rank FROM h1 JOIN e2 USING (id) GROUP BY e2.other HAVING e2.other NOT IN (SELECT id FROM rt UNION ALL SELECT id FROM h1)),
a AS (SELECT id, 0 AS depth, rank FROM rt UNION ALL SELECT id, 1, rank FROM h1 UNION ALL SELECT id, 2, rank FROM h2)
SELECT id, CAST(depth AS INTEGER) AS depth, CAST(rank AS BIGINT) AS rank, CAST(row_number() OVER (ORDER BY depth, rank, degree DESC, id) AS BIGINT) AS place
FROM a JOIN deg USING (id) QUALIFY place <= 60""")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood, two edges wide and of 60 nodes, of the eight nodes that fit a query best."""
    from pyspark.sql import Window

    nodes, edges = _graph(spark, sf_dir)
    scored = nodes.withColumn("score", graph.score(F.col("name"), F.concat_ws(" ", "name", "label"), _QUERY)).filter("score > 0")
    top = scored.orderBy(F.desc("score"), F.desc("degree"), F.desc("id")).limit(8)
    roots = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("degree"), F.desc("id"))))
    return graph.within(nodes, edges, roots, 60)


@register("graph_induced", f"""{_N}, k AS (SELECT id FROM deg WHERE degree >= 2)
SELECT from_id, to_id, rel FROM edges WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k)""")
def graph_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.induced(edges, nodes.filter("degree >= 2"))


@register("graph_spot", """
WITH w AS (SELECT DISTINCT lower(p_type) AS name FROM part), n AS (SELECT 'x' AS k, name FROM w UNION SELECT 'y', substring(name, 1, 4) FROM w),
v AS (SELECT name, min(k || name) AS node FROM n WHERE length(name) >= 2 GROUP BY name),
t AS (SELECT conv_id * 1000 + turn AS id, lower(text) || ' ' || (SELECT min(name) FROM w) AS text FROM conversations),
h AS (SELECT t.id, v.name, v.node FROM t JOIN v ON contains(t.text, v.name)),
k AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.id = h.id AND length(g.name) > length(h.name) AND contains(g.name, h.name)))
SELECT id, node, name, CAST(row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, node DESC) AS BIGINT) AS place FROM k QUALIFY place <= 40""")
def graph_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types, and their first four letters, named in turns; the first type is written into each turn."""
    w = table(spark, sf_dir, "part").select(F.lower("p_type").alias("name")).distinct()
    n = w.select(F.lit("x").alias("k"), "name").unionByName(w.select(F.lit("y").alias("k"), F.substring("name", 1, 4).alias("name"))).distinct()
    nodes = n.filter(F.length("name") >= 2).groupBy("name").agg(F.min(F.concat("k", "name")).alias("id"))
    first = w.agg(F.min("name").alias("first"))  # one row
    turns = table(spark, sf_dir, "conversations").join(F.broadcast(first)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lower("text"), F.lit(" "), "first").alias("text"))
    return graph.spotted(turns, nodes)
