"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import dialogue
from docstrata.plans.registry import register
from docstrata.sources.tables import table

_KEY = r"regexp_replace(lower(coalesce({0}, '')), '[\s\p{{P}}]+', '', 'g')"


@register("history_trim", """
SELECT conv_id, turn, role, left(text, 200) AS text, back FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS back FROM conversations) WHERE back <= 4""")
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.recent_turns(table(spark, sf_dir, "conversations"), 4, 200)


@register("reask_drop", f"""
WITH u AS (SELECT conv_id, turn, {_KEY.format('lead(text) OVER (PARTITION BY conv_id ORDER BY turn)')} = {_KEY.format('text')} AS again FROM conversations WHERE role = 'user'),
m AS (SELECT c.*, last_value(CASE WHEN c.role = 'user' THEN coalesce(u.again, false) END IGNORE NULLS) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS d
      FROM conversations c LEFT JOIN u USING (conv_id, turn))
SELECT conv_id, turn, role FROM m WHERE NOT coalesce(d, false) OR role = 'system'""")
def reask_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.without_reasked(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@register("last_user_turn", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations""")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.last_question(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "previous")


@register("image_turns_drop", """
WITH m AS (SELECT *, role = 'user' AND regexp_matches(text, '[0-9]') AS m FROM conversations),
p AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY conv_id ORDER BY turn), false) AS p FROM m)
SELECT conv_id, turn, role FROM p WHERE NOT m AND NOT (p AND role = 'assistant')""")
def image_turns_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a digit stand for those with an image."""
    return dialogue.without_marked(table(spark, sf_dir, "conversations"), F.col("text").rlike("[0-9]")).select("conv_id", "turn", "role")


#: Stand-ins in the test data's words for the word lists of a deployment.
DIRECT = ("hi", "hello", "thanks", "theof")
PROFESSIONAL, GENERAL, ANAPHORA, SHORT = "(tion|ness)", "(the|and)", "^(it|this|that)", "[?]$"


@register("route_rules", f"""
SELECT conv_id, turn, CASE WHEN {_KEY.format('q')} IN {DIRECT} THEN 'direct'
  WHEN length(q) > 0 AND length(q) <= 120 AND NOT regexp_matches(lower(q), '{PROFESSIONAL}') AND regexp_matches(q, '{GENERAL}') THEN 'general' ELSE 'rag' END AS route,
  length(q) > 0 AND (regexp_matches(q, '{ANAPHORA}') OR length(q) <= 8 OR (length(q) <= 16 AND regexp_matches(q, '{SHORT}'))) AS needs_context
FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS q FROM conversations WHERE role = 'user')""")
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", dialogue.route(F.col("text"), DIRECT, PROFESSIONAL, GENERAL, ANAPHORA, SHORT).alias("r")).select("conv_id", "turn", "r.*")


@register("conversation_export", r"""
SELECT conv_id, regexp_replace(string_agg('**' || role || '**' || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), '\n{3,}', chr(10) || chr(10), 'g') AS markdown, CAST(count(*) AS BIGINT) AS turns
FROM conversations GROUP BY conv_id""")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.exported(table(spark, sf_dir, "conversations"))
