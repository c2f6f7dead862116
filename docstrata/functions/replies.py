"""Fields of a model's reply: from JSON in it, else from labelled lines, else from its pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions.jsontext import with_first_object
from docstrata.functions.text import strip

#: Labels of a reply's fields, and how answers read.
CONCLUSION, PAGE, PHRASE, EXCERPT = "结论", "页码", "定位短语", "原文摘录"
ANSWER = "^(是|否|不确定|无法确定|不能确定|未提及|无)"
UNSURE = "不确定|无法确定|不能确定"
ANSWER_MOST = 30


def _labelled(text: Column, label: str) -> Column:
    pattern = rf"{label}\s*[:：]\s*([^\n；;]+)"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def _verdict(answer: Column) -> Column:
    """true, false or null of an answer in words."""
    outside = F.contains(F.left(answer, F.lit(8)), F.lit("不属于"))
    within = F.contains(F.left(answer, F.lit(6)), F.lit("属于")) & ~outside
    return F.when(answer.rlike(UNSURE), None).when(answer.rlike("^(是|属于)") | within, "true").when(answer.rlike("^(否|不是)") | outside, "false")


def reply_fields(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with reply: struct of value ('true', 'false', as written in JSON, or null), page, anchor, reason, parsed_by.

    JSON counts if it has value or found. Labels count if conclusion and phrase have one; else the pieces between line
    feeds and semicolons fill what is lacking: the first that reads like an answer (or the first at all), the first
    bare number, and the longest of the rest as anchor. A null or empty text has parsed_by 'fail'.
    """
    d = with_first_object(rows.withColumn("_t", strip(F.coalesce(text_col, F.lit("")))), "_t", "_json")
    keys = F.json_object_keys(F.coalesce("_json", F.lit("{}")))
    field = lambda k: F.nullif(F.get_json_object("_json", f"$.{k}"), F.lit(""))
    from_json = F.struct(
        F.when(F.array_contains(keys, "value"), F.get_json_object("_json", "$.value")).otherwise(F.get_json_object("_json", "$.found")).alias("value"),
        F.get_json_object("_json", "$.page").try_cast("int").alias("page"),
        F.coalesce(field("quote"), field("anchor"), F.lit("")).alias("anchor"),
        F.coalesce(field("reason"), F.lit("")).alias("reason"),
        F.lit("json").alias("parsed_by"),
    )
    t = F.col("_t")
    pieces = F.filter(F.transform(F.split(t, r"[\n；;]+"), strip), lambda p: p != "")
    d = d.withColumn("_pieces", pieces).withColumn("_told", _labelled(t, CONCLUSION)).withColumn("_phrase", F.coalesce(_labelled(t, PHRASE), _labelled(t, EXCERPT)))
    split = F.col("_told").isNull() | F.col("_phrase").isNull()
    places = F.filter(F.transform("_pieces", lambda p, i: F.when(p.rlike(ANSWER) & (F.length(p) <= ANSWER_MOST), i)), lambda i: i.isNotNull())
    d = d.withColumn("_at", F.when(F.col("_told").isNull(), F.coalesce(F.get(places, F.lit(0)), F.lit(-1))).otherwise(-1))
    number = lambda p: p.rlike(r"^\d{1,4}$")
    page = F.coalesce(_labelled(t, PAGE), F.when(split, F.get(F.filter("_pieces", number), F.lit(0))))
    d = d.withColumn("_page", page)
    rest = F.filter("_pieces", lambda p, i: (i != F.col("_at")) & ~p.eqNullSafe(F.col("_page")) & ~number(p))
    longest = F.array_max(F.transform(rest, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    anchor = F.when(split, F.coalesce(longest, F.col("_phrase"))).otherwise(F.col("_phrase"))
    answer = F.coalesce("_told", F.when(F.col("_at") >= 0, F.get("_pieces", F.col("_at"))), F.get("_pieces", F.lit(0)))
    d = d.withColumn("_answer", answer).withColumn("_anchor", strip(F.regexp_replace(F.coalesce(anchor, F.lit("")), r"^\s*[:：]?\s*", "")))
    in_words = F.struct(
        _verdict(F.col("_answer")).alias("value"),
        F.regexp_extract(F.coalesce("_page", F.lit("")), r"(\d{1,4})", 1).try_cast("int").alias("page"),
        F.when(F.col("_answer").isNull(), "").otherwise(F.col("_anchor")).alias("anchor"),
        F.coalesce("_answer", F.lit("")).alias("reason"),
        F.when(F.col("_answer").isNull(), "fail").when(split, "split").otherwise("labels").alias("parsed_by"),
    )
    told = F.coalesce(F.array_contains(keys, "value") | F.array_contains(keys, "found"), F.lit(False))
    return d.withColumn("reply", F.when(told, from_json).otherwise(in_words)).drop("_t", "_json", "_pieces", "_told", "_phrase", "_at", "_page", "_answer", "_anchor")
