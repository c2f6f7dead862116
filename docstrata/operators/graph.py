"""Operators on a property graph: nodes (id, label, name), edges (from_id, to_id, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.operators.phrases import holding


def ends(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: id, other, rel, out (whether it leaves ``id``)."""
    a = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "rel", F.lit(True).alias("out"))
    return a.unionByName(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "rel", F.lit(False).alias("out")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with degree: incident edges, a loop counting twice, 0 without any."""
    counts = ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def suggestions(nodes: DataFrame, k: int) -> DataFrame:
    """Each label's nodes, those without a name, the largest degree, and the k names of largest degree.

    nodes: id, label, name, degree. Nodes without edges or with a name of one character are no examples.
    """
    totals = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce(F.length("name"), F.lit(0)) == 0).alias("unnamed"), F.max("degree").alias("max_degree"))
    order = Window.partitionBy("label").orderBy(F.col("degree").desc(), "id")
    shown = nodes.filter((F.col("degree") > 0) & (F.length("name") >= 2)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    names = shown.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), "|").alias("examples"))
    return totals.join(names, "label", "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def score(name: Column, text: Column, query: str) -> Column:
    """Rank of a node for a query: its name equals it 200, holds it 140, is in it 120 and up to 30 more; else 18 a term."""
    q = query.lower()
    n = F.lower(F.coalesce(name, F.lit("")))
    terms = sum((F.when(F.contains(F.lower(text), F.lit(t)), 18).otherwise(0) for t in dict.fromkeys(q.split())), F.lit(0))
    return F.when(n == q, 200).when(F.contains(n, F.lit(q)), 140).when((n != "") & F.contains(F.lit(q), n), F.least(F.length(n), F.lit(30)) + 120).otherwise(terms)


def within(nodes: DataFrame, edges: DataFrame, roots: DataFrame, most: int, hops: int = 2) -> DataFrame:
    """Nodes up to ``hops`` edges from the roots, ``most`` of them: id, depth, nearest root's rank, in order of both.

    nodes: id, degree; roots: id, rank. Each hop is one join, deduplicated to a node's best (depth, rank). Within a
    depth, nodes of better roots come first, then those of larger degree, then smaller ids.
    """
    both = ends(edges).select("id", "other").distinct()
    seen = roots.select("id", F.lit(0).alias("depth"), F.col("rank").cast("long").alias("rank"))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(both, "id").select(F.col("other").alias("id"), F.lit(k).alias("depth"), "rank")
        front = front.groupBy("id").agg(F.min("depth").alias("depth"), F.min("rank").alias("rank")).join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(front)
    d = seen.join(nodes.select("id", "degree"), "id")
    place = F.row_number().over(Window.orderBy("depth", "rank", F.col("degree").desc(), "id"))
    top = d.orderBy("depth", "rank", F.col("degree").desc(), "id").limit(most)  # the cut is the operator's own
    return top.withColumn("place", place.cast("long")).select("id", "depth", "rank", "place")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among ``chosen`` (id)."""
    ids = chosen.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", F.coalesce("rel", F.lit("related")).alias("rel"))


def spotted(texts: DataFrame, nodes: DataFrame, most: int = 40) -> DataFrame:
    """Names in each text, longest first, without those inside a longer one that is there: id, node, name, place."""
    names = nodes.filter(F.length("name") >= 2)
    found = holding(texts, names.select(F.col("name").alias("phrase")))
    held = found.select("id", F.col("phrase").alias("name"))
    longer = held.select("id", F.col("name").alias("long"))
    inner = held.join(longer, "id").filter((F.length("long") > F.length("name")) & F.contains("long", F.col("name"))).select("id", "name").distinct()
    kept = held.join(inner, ["id", "name"], "left_anti").join(names.select("name", F.col("id").alias("node")), "name")
    order = Window.partitionBy("id").orderBy(F.length("name").desc(), F.col("node").desc())
    return kept.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most).select("id", "node", "name", "place")
