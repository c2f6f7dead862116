"""Queries on rules, units, verdicts and metrics, with the star schema standing in for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import rules as R
from docstrata.plans.registry import register
from docstrata.sources.tables import table

_UNITS = "units AS (SELECT * FROM (VALUES ('A', 'mass', 1.0), ('N', 'mass', 0.001), ('R', 'area', 666.6666666666666)) u(unit, dim, factor))"


def _units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "mass", 1.0), ("N", "mass", 0.001), ("R", "area", 666.6666666666666)], "unit string, dim string, factor double")


@register("unit_convert", f"""
WITH {_UNITS}
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN l_quantity WHEN a.dim = b.dim THEN l_quantity * a.factor / b.factor END, 6) AS quantity
FROM lineitem LEFT JOIN units a ON a.unit = l_returnflag LEFT JOIN units b ON b.unit = 'A'""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("to", F.lit("A"))
    out = R.converted(d, _units(spark), "l_quantity", "l_returnflag", "to", "q")
    return out.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("quantity"))


_TIERS = """
WITH c AS (SELECT * FROM (VALUES (1, 1, 'A', '>=', 45.0), (2, 1, 'N', '>', 49.0), (3, 2, 'R', '<', 5.0), (4, 2, 'A', '>=', 20.0), (5, 3, 'N', '>=', 10.0)) v(cond, tier, keyword, cmp, threshold)),
f AS (SELECT l_orderkey AS o, l_returnflag AS keyword, l_linenumber AS ord, CASE WHEN l_quantity = 7 THEN NULL ELSE l_quantity END AS value FROM lineitem),
h AS (SELECT o, cond, min(CASE WHEN value IS NULL THEN ord END) AS stop, min(CASE WHEN CASE cmp WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold END THEN ord END) AS good FROM f JOIN c USING (keyword) GROUP BY o, cond),
r AS (SELECT s.o, c.cond, c.tier, CASE WHEN h.o IS NULL THEN NULL WHEN stop IS NULL THEN good IS NOT NULL WHEN good < stop THEN true END AS result FROM (SELECT DISTINCT o FROM f) s CROSS JOIN c LEFT JOIN h ON h.o = s.o AND h.cond = c.cond),
t AS (SELECT o, tier, CASE WHEN max(CASE WHEN result THEN 1 ELSE 0 END) = 1 THEN true WHEN count(*) > count(result) THEN NULL ELSE false END AS result FROM r GROUP BY o, tier)"""


@register("tri_state_tier", f"""{_TIERS},
d AS (SELECT o, min(tier) AS decided, arg_min(coalesce(CAST(result AS VARCHAR), 'unknown'), tier) AS state FROM t WHERE coalesce(result, true) GROUP BY o)
SELECT s.o, CAST(decided AS INTEGER) AS decided, state FROM (SELECT DISTINCT o FROM t) s LEFT JOIN d USING (o)""")
def tri_state_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of orders by conditions on the quantities of their lines; a quantity of 7 can't be converted."""
    conditions = spark.createDataFrame([(1, 1, "A", ">=", 45.0), (2, 1, "N", ">", 49.0), (3, 2, "R", "<", 5.0), (4, 2, "A", ">=", 20.0), (5, 3, "N", ">=", 10.0)], "cond int, tier int, keyword string, cmp string, threshold double")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("keyword"), F.col("l_linenumber").alias("ord"), F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("value"))
    return R.tiers(R.condition_results(facts, conditions, ["o"]), ["o"])


_RISK = "r AS (SELECT l_suppkey, l_quantity AS quantity, CASE WHEN p_size <= 2 THEN NULL ELSE p_size * 40.0 END AS threshold FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 2, F.col("p_size") * 40.0).alias("threshold"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").alias("quantity")).join(part, "l_partkey")


@register("risk_q_sum", f"""
WITH {_RISK}, s AS (SELECT l_suppkey, round(sum(quantity / threshold), 6) AS q, count(*) FILTER (WHERE threshold IS NULL) AS lacking, count(*) AS items FROM r GROUP BY l_suppkey)
SELECT l_suppkey, q, CAST(lacking AS BIGINT) AS lacking, CAST(items AS BIGINT) AS items,
  CASE WHEN lacking > 0 AND coalesce(q < 1, true) THEN NULL WHEN q < 1 THEN 0 WHEN q < 10 THEN 1 WHEN q < 100 THEN 2 ELSE 3 END AS level FROM s""")
def risk_q_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.q_sum(_risk(spark, sf_dir), ["l_suppkey"])


@register("risk_threshold", f"""
WITH {_RISK}, s AS (SELECT l_suppkey, CASE WHEN max(CASE WHEN quantity > threshold THEN 1 ELSE 0 END) = 1 THEN true WHEN count(*) FILTER (WHERE threshold IS NULL) > 0 THEN NULL ELSE false END AS over FROM r GROUP BY l_suppkey)
SELECT s_suppkey AS l_suppkey, s.over FROM supplier LEFT JOIN s ON s.l_suppkey = s_suppkey""")
def risk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.over_threshold(_risk(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")


@register("substance_cascade", """
WITH t AS (SELECT p_partkey AS ord, p_brand || '/' || p_partkey AS code, lower(p_name) AS name FROM part),
q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN lower(p_name) WHEN 2 THEN upper(p_type) ELSE substring(lower(p_name), 2, 5) END AS ask, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '/' || p_partkey END AS code FROM part),
al AS (SELECT p_type AS alias, min(lower(p_name)) AS name FROM part GROUP BY p_type),
f AS (SELECT ask, q.code, ord, 0 AS step FROM q JOIN t ON t.code = q.code UNION ALL
  SELECT ask, q.code, ord, 1 FROM q JOIN t ON t.name = ask UNION ALL
  SELECT ask, q.code, ord, 2 FROM q JOIN al ON al.alias = ask JOIN t ON t.name = al.name UNION ALL
  SELECT ask, q.code, ord, 3 FROM q JOIN al ON al.alias = upper(ask) JOIN t ON t.name = al.name UNION ALL
  SELECT ask, q.code, ord, 4 FROM q JOIN al ON al.alias = lower(ask) JOIN t ON t.name = al.name UNION ALL
  SELECT ask, q.code, ord, 5 FROM q JOIN t ON length(ask) >= 3 AND contains(t.name, ask)),
b AS (SELECT ask, code, min(struct_pack(step := step, ord := ord)) AS b FROM f GROUP BY ask, code)
SELECT q.ask, q.code, b.b.ord AS ord, ['code', 'name', 'alias', 'alias', 'alias', 'part'][b.b.step + 1] AS how FROM q LEFT JOIN b ON b.ask IS NOT DISTINCT FROM q.ask AND b.code IS NOT DISTINCT FROM q.code""")
def substance_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("ord"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("code"), F.lower("p_name").alias("name"))
    k = F.col("p_partkey") % 4
    ask = F.when(k == 0, "x").when(k == 1, F.lower("p_name")).when(k == 2, F.upper("p_type")).otherwise(F.substring(F.lower("p_name"), 2, 5))
    q = p.select(ask.alias("ask"), F.when(k == 0, F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))).alias("code"))
    aliases = p.groupBy(F.col("p_type").alias("alias")).agg(F.min(F.lower("p_name")).alias("name"))
    return R.resolve(q, t, aliases)


@register("catalog_score", """
WITH i AS (SELECT p_partkey AS item, list_distinct(string_split(lower(p_name), ' ') || [lower(p_type)]) AS terms, regexp_extract(p_brand, '#(\\d+)', 1) AS code FROM part),
q AS (SELECT n_nationkey AS ask, list_distinct(string_split((SELECT string_agg(lower(p_name), ' ') FROM part WHERE p_partkey = n_nationkey + 1), ' ') || [CAST(n_nationkey + 10 AS VARCHAR)]) AS terms FROM nation),
qt AS (SELECT ask, unnest(terms) AS term FROM q),
w AS (SELECT item, unnest(terms) AS term, NULL AS x FROM i),
p AS (SELECT item, term, length(term) * length(term) AS points FROM w UNION ALL SELECT item, code, 60 FROM i),
s AS (SELECT ask, item, sum(points) AS score FROM qt JOIN p USING (term) GROUP BY ask, item)
SELECT ask, item, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, item) AS BIGINT) AS place FROM s QUALIFY place <= 5 AND max(score) OVER (PARTITION BY ask) >= 16""")
def catalog_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("item"), F.array_append(F.split(F.lower("p_name"), " "), F.lower("p_type")).alias("terms"), F.array(F.regexp_extract("p_brand", r"#(\d+)", 1)).alias("codes"))
    n = table(spark, sf_dir, "nation").join(p, F.col("n_nationkey") + 1 == F.col("p_partkey"))
    asked = n.select(F.col("n_nationkey").alias("ask"), F.array_append(F.split(F.lower("p_name"), " "), (F.col("n_nationkey") + 10).cast("string")).alias("terms"))
    return R.catalog_scores(asked, items)


@register("standard_suggest", """
WITH f AS (SELECT DISTINCT l_suppkey AS key, p_type AS word FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT p_brand AS code, p_type AS word, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS citations FROM part GROUP BY p_brand, p_type HAVING count(*) >= 1),
h AS (SELECT key, code, sum(CASE WHEN word IN ('STANDARD', 'SMALL') THEN 1 ELSE 5 END) + least(max(citations), 7) AS score FROM f JOIN s USING (word) GROUP BY key, code)
SELECT key, code, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, code) AS BIGINT) AS place FROM h QUALIFY place <= 8""")
def standard_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("p_partkey"))
    features = lines.join(part.select("p_partkey", F.col("p_type").alias("word")), "p_partkey").select("key", "word")
    words = part.groupBy(F.col("p_brand").alias("code"), F.col("p_type").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    standards = words.withColumn("citations", F.sum("n").over(Window.partitionBy("code"))).drop("n")
    return R.suggested(features, standards, ("STANDARD", "SMALL"), 8)


@register("merge_inputs_conflict", """
WITH a AS (SELECT doc_id, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS value FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, quality AS value, toxic = 1 AS verified FROM labels)
SELECT doc_id, CAST(CASE WHEN coalesce(verified, false) THEN coalesce(b.value, a.value) ELSE coalesce(a.value, b.value) END AS INTEGER) AS value, coalesce(a.value <> b.value, false) AS conflict FROM a FULL JOIN b USING (doc_id)""")
def merge_inputs_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").filter("lang != 'de'").select("doc_id", F.when(F.length("text") > 1500, 1).otherwise(0).alias("value"))
    return R.merged(a, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"), (F.col("toxic") == 1).alias("verified")), "doc_id")


@register("gold_metrics", """
WITH p AS (SELECT d.lang, length(d.text) > 300 AS said, l.quality = 1 AS truth FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE said AND truth) AS tp, count(*) FILTER (WHERE said AND NOT truth) AS fp, count(*) FILTER (WHERE NOT said AND truth) AS fn, count(*) FILTER (WHERE NOT said AND NOT truth) AS tn, count(truth) AS judged, count(*) AS total FROM p GROUP BY lang)
SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall, round((tp + tn) / nullif(judged, 0), 3) AS agreement, round(judged / total, 3) AS coverage FROM c""")
def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") > 300).alias("said"))
    return R.agreement(d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id", "left"), ["lang"])


@register("review_upsert", """
WITH e AS (SELECT doc_id, CASE quality WHEN 1 THEN 'ok' ELSE 'bad' END AS state, doc_id % 7 AS stamp FROM labels UNION ALL SELECT doc_id, 'typo', 9 FROM labels UNION ALL SELECT doc_id, '', 8 FROM labels WHERE toxic = 1),
l AS (SELECT doc_id, arg_max(state, stamp) AS human FROM e WHERE state IN ('ok', 'bad', '') GROUP BY doc_id)
SELECT doc_id, lang AS machine, human, coalesce(nullif(human, ''), lang) AS final FROM documents LEFT JOIN l USING (doc_id)""")
def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    edits = labels.select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("bad").alias("state"), (F.col("doc_id") % 7).alias("stamp"))
    edits = edits.unionByName(labels.select("doc_id", F.lit("typo").alias("state"), F.lit(9).cast("long").alias("stamp"))).unionByName(labels.filter("toxic = 1").select("doc_id", F.lit("").alias("state"), F.lit(8).cast("long").alias("stamp")))
    return R.upserted(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("state")), edits, "doc_id", ("ok", "bad", ""))


@register("verdict_stats", """
SELECT o_orderpriority AS category, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS "F", CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS "O", CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS "P", CAST(count(*) FILTER (WHERE o_orderstatus = 'X') AS BIGINT) AS "X" FROM orders GROUP BY o_orderpriority""")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and state over a fixed domain of states, zeros included."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOPX"])


@register("worst_severity", """
SELECT o_custkey, CAST(max(CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 0 END) AS INTEGER) AS severity, min(o_orderkey) AS first_order, arg_max(o_orderkey, o_totalprice) AS largest FROM orders GROUP BY o_custkey""")
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("severity"), F.min("o_orderkey").alias("first_order"), F.max_by("o_orderkey", "o_totalprice").alias("largest"))


@register("round_robin", """
SELECT p_partkey, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS turn FROM part ORDER BY turn, p_type LIMIT 14""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), "p_type", [F.col("p_retailprice").desc(), F.col("p_partkey")], 14).select("p_partkey", "p_type", "turn")


@register("question_quota", """
WITH b AS (SELECT o_custkey, o_orderkey, left(o_orderpriority, 1) AS b FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, b ORDER BY o_orderkey) AS n FROM b),
k AS (SELECT * FROM n WHERE b = '5' OR n <= CASE b WHEN '1' THEN 1 WHEN '2' THEN 1 WHEN '3' THEN 3 ELSE 0 END)
SELECT o_custkey, o_orderkey, b AS bucket, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN b = '5' THEN 1 ELSE 0 END, b, o_orderkey) AS BIGINT) AS place FROM k QUALIFY place <= 5""")
def question_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("bucket"))
    return R.quota_buckets(d, "o_custkey", "bucket", {"1": 1, "2": 1, "3": 3}, "5", 5, [F.col("o_orderkey")])


@register("span_overlap", r"""
WITH RECURSIVE h AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[a-z]{3,}')) AS w, text FROM benchmark),
s AS (SELECT item_id, strpos(text, x) - 1 AS b, strpos(text, x) - 1 + length(x) AS e FROM (SELECT item_id, text, unnest(w) AS x FROM h)),
o AS (SELECT item_id, b, max(e) AS e, row_number() OVER (PARTITION BY item_id ORDER BY b) AS k FROM s GROUP BY item_id, b),
g AS (SELECT item_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT item_id FROM o)
  UNION ALL SELECT g.item_id, o.k, CASE WHEN o.b >= g.last THEN o.e ELSE g.last END, g.n + CASE WHEN o.b >= g.last THEN 1 ELSE 0 END FROM g JOIN o ON o.item_id = g.item_id AND o.k = g.k + 1)
SELECT item_id, max(n) AS taken, max(last) AS last_end FROM g GROUP BY item_id""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First places of the lower-case words of passages, taken left to right without overlap."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{3,})"), F.lit(1)))
    places = F.transform(words, lambda w: F.struct((F.call_function("position", w, F.col("text")) - 1).alias("begin"), (F.call_function("position", w, F.col("text")) - 1 + F.length(w)).alias("end")))
    taken = R.spans_without_overlap(places)
    d = table(spark, sf_dir, "benchmark").select("item_id", taken.alias("s")).filter(F.size("s") > 0)
    return d.select("item_id", F.size("s").cast("long").alias("taken"), F.element_at("s", -1)["end"].cast("long").alias("last_end"))


@register("nearest_target", """
SELECT o_custkey, min(o_totalprice) AS nearest, CAST(count(o_totalprice) AS BIGINT) AS known, CASE WHEN min(o_totalprice) <= 20000 THEN true WHEN count(o_totalprice) >= 3 THEN false END AS sensitive FROM orders GROUP BY o_custkey""")
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_target(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", 20000.0)


@register("provenance_gate", r"""
WITH s AS (SELECT doc_id AS key, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, unnest(string_split(text, chr(10))) AS text FROM documents),
n AS (SELECT key, k, list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS numbers, CASE WHEN k % 3 = 0 THEN [] ELSE [k % 5] END AS refs FROM s),
f AS (SELECT doc_id AS key, unnest([1, 2, 3]) AS fact, [CAST(doc_id % 10 AS VARCHAR), CAST(n_chars % 100 AS VARCHAR)] AS known FROM documents),
j AS (SELECT n.*, f.known, len(refs) > 0 AND f.key IS NULL AS unknown FROM n LEFT JOIN f ON f.key = n.key AND len(refs) > 0 AND f.fact = refs[1])
SELECT key, k, CASE WHEN unknown THEN 'unknown reference' WHEN len(numbers) > 0 AND len(refs) = 0 THEN 'number without reference'
  WHEN len(list_filter(numbers, lambda x: NOT list_contains(coalesce(known, []), x))) > 0 THEN 'number not in facts' END AS reason FROM j""")
def provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for sentences; each third one refers to nothing, the others to fact k modulo 5, of which 1 to 3 exist."""
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("k", "text")).withColumn("k", (F.col("k") + 1).cast("long"))
    s = s.withColumn("refs", F.when(F.col("k") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("k") % 5)))
    facts = d.select(F.col("doc_id").alias("key"), F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("fact"), F.array((F.col("doc_id") % 10).cast("string"), (F.col("n_chars") % 100).cast("string")).alias("numbers"))
    return R.supported_sentences(s, facts)
