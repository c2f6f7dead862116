"""Queries on vector recall and selection. Searches ask with every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.operators import search
from docstrata.plans.registry import register
from docstrata.sources.tables import table

TOP_K = 16
POOL = search.budget(TOP_K)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label"))


_SIM = """
WITH s AS (
  SELECT q.vec_id AS qid, e.vec_id AS id, e.label,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS sim
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"""

#: Rows that each label is sure of; labels stand for corpora.
_QUOTA = "CASE label WHEN 0 THEN 16 WHEN 1 THEN 24 WHEN 2 THEN 8 WHEN 3 THEN 6 WHEN 4 THEN 6 ELSE 4 END"
_RECALL = f"""{_SIM},
g AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY sim DESC, id) <= {_QUOTA} AS picked FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY picked DESC, sim DESC, id) AS fill FROM g),
r AS (SELECT qid, id, label, sim, picked FROM f WHERE picked OR fill <= {POOL})"""


@register("knn_plain", f"""{_SIM}
SELECT qid, id, sim, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS BIGINT) AS place FROM s) WHERE place <= {TOP_K}""")
def knn_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _vectors(spark, sf_dir)
    return search.nearest(queries, corpus.select("id", "vec"), TOP_K).select("qid", "id", "sim", "place")


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = _vectors(spark, sf_dir)
    return search.quota_recall(queries, corpus, "label", F.expr(_QUOTA), 24, POOL)


@register("recall_quota", f"{_RECALL} SELECT * FROM r")
def recall_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir)


@register("recall_quota_topk", f"""{_RECALL}
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS BIGINT) AS place FROM r) WHERE place <= {TOP_K}""")
def recall_quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "id")
    return _recall(spark, sf_dir).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= TOP_K)


@register("relevance_gate", f"""{_RECALL},
h AS (SELECT *, max(sim) FILTER (WHERE id <> qid) OVER (PARTITION BY qid) AS best FROM r)
SELECT qid, id, sim FROM h WHERE id <> qid AND best >= 0.35""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gate(_recall(spark, sf_dir).filter("id != qid").select("qid", "id", "sim"), 0.35, score="sim")


_CANDIDATES = f"""{_RECALL},
c AS (
  SELECT r.qid, r.id, r.sim AS score,
         r.sim + CASE WHEN d.lang = 'en' AND regexp_matches(d.text, '[0-9]') THEN 0.15 ELSE 0 END - CASE WHEN l.toxic = 1 THEN 0.35 ELSE 0 END AS eff0,
         d.lang = 'en' AS authority, d.source AS dkey
  FROM r JOIN documents d ON d.doc_id = r.id LEFT JOIN labels l ON l.doc_id = r.id),
e AS (SELECT *, round(eff0, 6) AS eff FROM c),
n AS (SELECT *, authority AND score >= greatest(0.2, max(eff) OVER (PARTITION BY qid) - 0.25) AS strong FROM e),
a1 AS (SELECT *, row_number() OVER (PARTITION BY qid, dkey, strong ORDER BY eff DESC, id) AS nth FROM n),
a2 AS (SELECT *, strong AND nth <= 2 AS sure FROM a1),
a3 AS (SELECT *, sure AND row_number() OVER (PARTITION BY qid, sure ORDER BY eff DESC, id) <= 2 AS pa FROM a2),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, dkey ORDER BY pa DESC, eff DESC, id) AS nth2 FROM a3),
p AS (SELECT *, CASE WHEN pa THEN 0 WHEN nth2 <= CASE WHEN authority THEN 2 ELSE 3 END THEN 1 ELSE 2 END AS phase FROM b),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY phase, eff DESC, id) AS BIGINT) AS pick FROM p)
SELECT qid, id, score, eff, authority, dkey, phase, pick FROM o WHERE pick <= {TOP_K}"""


@register("select_cap_guarantee", _CANDIDATES)
def select_cap_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").rlike("[0-9]").alias("numeric"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    c = _recall(spark, sf_dir).join(docs, "id").join(labels, "id", "left")
    bonus = F.when((F.col("lang") == "en") & F.col("numeric"), 0.15).otherwise(0.0)
    penalty = F.when(F.col("toxic") == 1, 0.35).otherwise(0.0)
    c = c.select("qid", "id", F.col("sim").alias("score"), F.round(F.col("sim") + bonus - penalty, 6).alias("eff"), (F.col("lang") == "en").alias("authority"), F.col("source").alias("dkey"))
    return search.selected(c, TOP_K)


@register("copy_collapse", """
SELECT key, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies, CAST(max(n_chars) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, n_chars, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key FROM documents) GROUP BY key""")
def copy_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "").cast("binary")).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n_chars").alias("n_chars"))


_PARTS = """
WITH p AS (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS position FROM documents),
h AS (SELECT source, position, round(length(line) / 1000.0, 6) AS sim, source % 20 AS qid FROM p WHERE regexp_matches(line, '[0-9]{2}'))"""


@register("neighbour_expand", f"""{_PARTS},
n0 AS (SELECT h.qid, h.source, h.position + s.step AS position, h.sim, h.position AS p0, s.o FROM h, (VALUES (1, 0), (-1, 1)) s(step, o)),
n1 AS (SELECT n0.* FROM n0 JOIN p USING (source, position) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = n0.qid AND h.source = n0.source AND h.position = n0.position)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY qid, source, position ORDER BY sim DESC, p0, o) AS n FROM n1),
n3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, source, p0, o) AS BIGINT) AS added FROM n2 WHERE n = 1)
SELECT qid, source, CAST(position AS BIGINT) AS position, sim, added FROM n3 WHERE added <= 12""")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines beside those that hold a number, at most 12 for each residue of the document's id."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("position", "line")).withColumn("position", F.col("position").cast("long"))
    hits = lines.filter(F.col("line").rlike("[0-9]{2}")).select((F.col("source") % 20).alias("qid"), "source", "position", F.round(F.length("line") / 1000.0, 6).alias("sim"))
    return search.neighbours(hits, lines, 12)


@register("code_pin", """
WITH b AS (SELECT p_partkey, p_brand, p_type, p_retailprice, regexp_extract(p_brand, '#(\\d+)', 1) AS code FROM part),
o AS (SELECT DISTINCT regexp_extract(p_brand, '#(\\d+)', 1) AS code FROM part WHERE p_size >= 45),
r AS (SELECT b.*, CAST(row_number() OVER (PARTITION BY code ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS place FROM b SEMI JOIN o USING (code))
SELECT code, p_partkey, place FROM r WHERE place <= 6""")
def code_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six dearest parts of every code that a large part names."""
    from docstrata.functions.text import code_of

    p = table(spark, sf_dir, "part").withColumn("code", code_of(F.col("p_brand"), pattern=r"#(\d+)", group=1))
    asked = p.filter("p_size >= 45").select("code").distinct()
    order = Window.partitionBy("code").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return p.join(asked, "code", "left_semi").withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 6").select("code", "p_partkey", "place")
