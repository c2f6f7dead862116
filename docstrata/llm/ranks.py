"""Places of rows in an order, over all rows or within groups, without a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.store import materialize

_ROW_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b`` by an inner join in which nulls equal each other."""
    b = b.withColumnsRenamed({c: f"_of_{c}" for c in on})
    equal = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on], F.lit(True))
    return a.join(b, equal).drop(*[f"_of_{c}" for c in on])


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``_index``, each row's place in its group from 0, and ``_total``, the rows of the group.

    Rows are sorted by ranges and written once; what is counted afterwards is one row a partition and group met there,
    so a group of any size spreads over many tasks. Rows that are equal in ``order`` are told apart by where they were
    read. Null groups are one group.
    """
    keys = [*[F.col(c) for c in group], *order, F.monotonically_increasing_id()]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), name, "zstd")
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    found = joined(rows, counts, ["_part", *group])
    return found.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias("_index"), "_total")
