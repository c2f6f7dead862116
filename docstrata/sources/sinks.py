"""Writers: index tables, JSON lines, review tables, event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_index(chunks: DataFrame, path: str, corpus: str = "corpus") -> None:
    """Chunks with their vectors, one folder a corpus, so a search of one corpus reads that folder alone."""
    chunks.write.mode("overwrite").partitionBy(corpus).parquet(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text, binary as UTF-8 with invalid bytes replaced."""
    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "binary":
            c = F.make_valid_utf8(c.cast("string"))
        return c.alias(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    json_ready(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def review_lines(items: DataFrame, comment: str, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of a review export in order: a byte order mark and comment, the heading, then quoted rows. value, k."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    rows = items.select(F.concat_ws(",", *quoted).alias("value"), F.lit(2).alias("part"), F.struct(*order).cast("string").alias("k"))
    head = items.sparkSession.createDataFrame([("﻿# " + comment, 0, ""), (",".join(columns), 1, "")], "value string, part int, k string")
    return head.unionByName(rows).orderBy("part", "k").select("value")


def event_frame(event: Column, payload: Column) -> Column:
    """An event-stream frame."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))
