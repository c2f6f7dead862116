"""Operators on conversations (conv_id, turn, role, text): history, routing, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import question_key


def recent_turns(turns: DataFrame, most: int = 12, chars: int = 4000) -> DataFrame:
    """The last ``most`` turns of each conversation, each cut to ``chars`` characters."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("back", F.row_number().over(order).cast("long")).filter(F.col("back") <= most).withColumn("text", F.left("text", F.lit(chars)))


def without_reasked(turns: DataFrame) -> DataFrame:
    """Conversations without a user turn, and its answer, that the next user turn asks again."""
    user = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.filter("role = 'user'").withColumn("again", question_key(F.lead("text").over(user)) == question_key(F.col("text")))
    marked = turns.join(asked.select("conv_id", "turn", "again"), ["conv_id", "turn"], "left")
    before = F.last(F.when(F.col("role") == "user", F.coalesce("again", F.lit(False))), ignorenulls=True).over(user)
    return marked.withColumn("_d", F.coalesce(before, F.lit(False))).filter(~F.col("_d") | (F.col("role") == "system")).drop("_d", "again")


def last_question(turns: DataFrame) -> DataFrame:
    """Each turn with the last user text before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))


def without_marked(turns: DataFrame, marked: Column) -> DataFrame:
    """Conversations without the user turns that are marked and the assistant turns that follow them at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.withColumn("_m", F.coalesce(marked & (F.col("role") == "user"), F.lit(False)))
    d = d.withColumn("_p", F.coalesce(F.lag("_m").over(w), F.lit(False)))
    return d.filter(~F.col("_m") & ~(F.col("_p") & (F.col("role") == "assistant"))).drop("_m", "_p")


def route(query: Column, direct: tuple[str, ...], professional: str, general: str, anaphora: str, short: str) -> Column:
    """direct, general or rag, and whether the query needs its context.

    direct: the key is one of the given texts. general: at most 120 characters, a word of the general list and none of
    the professional one. A query needs context if it refers back, has at most 8 characters, or at most 16 and the
    form of a short question.
    """
    q = F.trim(F.coalesce(query, F.lit("")))
    key = question_key(q)
    is_general = (F.length(q) > 0) & (F.length(q) <= 120) & ~F.lower(q).rlike(professional) & q.rlike(general)
    needs = (F.length(q) > 0) & (q.rlike(anaphora) | (F.length(q) <= 8) | ((F.length(q) <= 16) & q.rlike(short)))
    return F.struct(F.when(key.isin(*direct), "direct").when(is_general, "general").otherwise("rag").alias("route"), needs.alias("needs_context"))


def exported(turns: DataFrame) -> DataFrame:
    """One Markdown text a conversation, turns in order; more than one empty line in a row becomes one."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**\n\n"), F.coalesce("text", F.lit(""))).alias("t"))))
    whole = F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n")
    return turns.groupBy("conv_id").agg(F.regexp_replace(whole, "\n{3,}", "\n\n").alias("markdown"), F.count(F.lit(1)).alias("turns"))
