"""JSON inside free text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text, braces in strings not counted; null if there is none that parses."""
    decoder, t = json.JSONDecoder(), text or ""
    at = t.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(t, at)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            at = t.find("{", at + 1)
    return None


def with_first_object(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with the first JSON object of a text column."""
    schema = StructType([f for f in rows.schema if f.name != name]).add(name, StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [first_object(x) for x in b[text_col]]})[schema.names]

    return rows.mapInPandas(run, schema)


def coerced(text: Column, kind: str) -> Column:
    """A value of the declared type str, int, float or bool from its text; null if it isn't one."""
    t = F.trim(text)
    if kind == "bool":
        return F.when(F.lower(t).isin("true", "1", "yes", "是"), True).when(F.lower(t).isin("false", "0", "no", "否"), False)
    if kind in ("int", "float"):
        return t.try_cast("bigint" if kind == "int" else "double")
    return F.nullif(t, F.lit(""))


def sse_data(line: Column) -> Column:
    """The payload of a ``data:`` line of an event stream; null for other lines and the closing one."""
    return F.nullif(F.nullif(F.regexp_extract(line, r"^data:\s*(.*)$", 1), F.lit("")), F.lit("[DONE]"))
