"""Queries on events, reply streams, JSON and gold statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import jsontext
from docstrata.functions import text as T
from docstrata.plans.registry import register
from docstrata.sources.tables import gold_answers, table
from docstrata.streaming import events as E
from docstrata.streaming import pieces as P

_NOW = "2024-01-15 12:00:00"


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed(table(spark, sf_dir, "events"), "1 hour", keys=("event_type",)).withColumn("total", F.round("total", 6))


@register("event_sliding", """
SELECT s AS start, s + INTERVAL 2 HOUR AS "end", CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total
FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s, value FROM events) GROUP BY s""")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed(table(spark, sf_dir, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 6))


@register("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "2 hours")


@register("step_timeline", """
WITH b AS (SELECT *, event_type IN ('click', 'view') AS begins, event_type = 'purchase' AS ends FROM events),
f AS (SELECT *, lead(ts) OVER w AS closed, coalesce(lead(ends) OVER w, false) AS done FROM b WHERE begins OR ends WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(date_sub('second', ts, closed) AS BIGINT) AS seconds, done FROM f WHERE begins""")
def step_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins, ends = F.col("event_type").isin("click", "view"), F.col("event_type") == "purchase"
    out = E.timeline(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], begins, ends)
    return out.select("user_id", "event_id", "seconds", "done")


@register("progress_throttle", """
WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, t AS last, CAST(1 AS BIGINT) AS kept FROM e WHERE k = 1
  UNION ALL SELECT w.user_id, e.k, CASE WHEN e.t - w.last >= 86400 THEN e.t ELSE w.last END, w.kept + CASE WHEN e.t - w.last >= 86400 THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, max(kept) AS kept FROM w GROUP BY user_id""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a user that are a day or more after the last one kept."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kept = E.throttled(table(spark, sf_dir, "events"), "user_id", seconds, 86400.0)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@register("cache_ttl_lru", f"""
WITH u AS (SELECT user_id, event_type, max(ts) AS used FROM events WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY user_id, event_type)
SELECT * FROM u WHERE used >= TIMESTAMP '{_NOW}' - INTERVAL 600 MINUTE ORDER BY used DESC, user_id, event_type LIMIT 300""")
def cache_ttl_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cache_entries(table(spark, sf_dir, "events"), ["user_id", "event_type"], _NOW, 600, 300)


@register("cache_hit_rate", """
WITH h AS (SELECT event_type, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 1440 MINUTE, false) AS hit FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS lookups, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 3) AS rate FROM h GROUP BY event_type""")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 1440)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into pieces of seven characters, with the marker after their first third."""
    t = F.concat(F.left("text", F.floor(F.length("text") / 3).cast("int")), F.lit(P.END_OF_THOUGHT), F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.length("text")))
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request"), t.alias("t"))
    n = F.ceil(F.length("t") / 7).cast("int")
    d = d.select("request", "t", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return d.select("request", F.col("seq").cast("long").alias("seq"), F.substring("t", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"))


@register("split_think", """
SELECT conv_id * 1000 + turn AS request, left(text, length(text) // 3) AS reasoning, substring(text, length(text) // 3 + 1) AS answer FROM conversations""")
def split_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_batch(_pieces(spark, sf_dir))


@register("tail_guard", r"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
l AS (SELECT *, regexp_extract_all(text, '[^。！？!?\n.]{0,119}[。！？!?\n.]|[^。！？!?\n.]{1,120}') AS l FROM t),
u AS (SELECT id, length(text) AS n, unnest(l) AS s, unnest(range(len(l))) AS k FROM l),
v AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM u),
c AS (SELECT id, min(place) AS cut FROM v WHERE contains(s, 'the') AND n - place <= 400 GROUP BY id)
SELECT id, CAST(coalesce(cut, length(text)) AS BIGINT) AS n_chars FROM t LEFT JOIN c USING (id)""")
def tail_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return P.guard_batch(d, "the").select("id", F.length("text").cast("long").alias("n_chars"))


@register("json_extract", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN lower(json_extract_string(props, '$.k')) IN ('true', '1', 'yes') THEN true WHEN lower(json_extract_string(props, '$.k')) IN ('false', '0', 'no') THEN false END AS flag FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", jsontext.coerced(k, "int").alias("k"), jsontext.coerced(k, "bool").alias("flag"))


@register("json_in_text", """SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' AS object FROM events""")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object found inside a reply that frames it in words and a broken brace."""
    d = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Reply {not json} "), "props", F.lit(" done }")).alias("reply"))
    return jsontext.with_first_object(d, "reply", "object").select("event_id", "object")


@register("sse_parse", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0""")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, "data: [DONE]").otherwise(F.concat(F.lit("data: "), "props"))
    d = table(spark, sf_dir, "events").select("event_id", jsontext.sse_data(line).alias("data")).filter("data is not null")
    return d.select("event_id", F.get_json_object("data", "$.k").cast("long").alias("k"))


#: Statements of a gold set as they are written down, with comments and more than one statement.
GOLD = (
    ("g1", "-- all regions\nSELECT r_regionkey, r_name FROM region ORDER BY r_regionkey;"),
    ("g2", "/* customers */ WITH c AS (SELECT count(*) AS n FROM customer)\nSELECT n FROM c; SELECT 1"),
    ("g3", "SELECT missing FROM region"),
    ("g4", "说明：no statement"),
)


@register("sql_gold_build", """
SELECT 'g1' AS id, 'SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey' AS sql, true AS ok, unnest(['r_regionkey', 'r_name']) AS field, r_regionkey AS row, unnest([CAST(r_regionkey AS VARCHAR), r_name]) AS value FROM region
UNION ALL SELECT 'g2', 'WITH c AS (SELECT count(*) AS n FROM customer) SELECT n FROM c', true, 'n', 0, CAST(count(*) AS VARCHAR) FROM customer
UNION ALL SELECT 'g3', 'SELECT missing FROM region', false, NULL, NULL, NULL UNION ALL SELECT 'g4', NULL, false, NULL, NULL, NULL""")
def sql_gold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers: each question's first statement, cleaned and run, with the fields of its rows, or that it can't run."""
    for name in ("region", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    gold = spark.createDataFrame(list(GOLD), "id string, written string").withColumn("sql", T.first_statement(F.col("written")))
    return gold_answers(gold)
