"""Mixing sources to target weights by pivotal dependent rounding.

Every document is expected floor(f) copies plus one more with a fractional probability, where f is its source's
target over its source's size. Documents meet in small leaf groups of one source. There the pivotal method pairs two
open documents and randomly moves expected words from one to the other until one of them is certain; expectations
and the group's expected words stay as they are. A group's one open document goes up a tree of groups of groups, so
each source ends with a single open document, which a last draw decides. The words that a source's copies hold
therefore differ from its target by less than one document.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from docstrata.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Rows of a leaf group, and groups that meet one level up.
LEAF_ROWS, FAN_IN = 2048, 32


def word_count(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources from (source, source_size): one row a source, so windows over them are small.

    Sources in order of code point, null last, weigh as ``weights`` repeated. They share ``share`` of all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared again. With ratios
    most * size / weight in ascending order, the common level is the first one not above its own ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), turn.cast("int") + 1)
    d = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("all", F.sum("source_size").over(whole) * F.lit(share))
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    d = d.withColumns({"level": left / rest, "n": F.row_number().over(by_ratio)})
    d = d.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("n", "level"))).over(whole)["level"])
    return d.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def settle(sizes: np.ndarray, p: np.ndarray, seed: int, last: bool) -> tuple[np.ndarray, int, float]:
    """Pivotal rounding in the given order: 0 or 1 for each row, the row left open or -1, and its probability.

    ``last`` decides the open row as well. Rows without words are decided alone: they move no words.
    """
    draw = np.random.Generator(np.random.PCG64(seed)).random(len(p) + 1)
    picked, held, q = np.zeros(len(p), np.int64), -1, 0.0
    for j in range(len(p)):
        if sizes[j] <= 0 or p[j] <= 0.0:
            continue
        if held < 0:
            held, q = j, float(p[j])
            continue
        zi, zj, pj = float(sizes[held]), float(sizes[j]), float(p[j])
        up, down = min((1 - q) * zi, pj * zj), min(q * zi, (1 - pj) * zj)  # words that may move to or from the held row
        if draw[j] * (up + down) < down:
            if (1 - q) * zi <= pj * zj:
                picked[held], held, q = 1, j, pj - (1 - q) * zi / zj
            else:
                q += pj * zj / zi
        elif q * zi <= (1 - pj) * zj:
            held, q = j, pj + q * zi / zj
        else:
            picked[j] = 1
            q -= (1 - pj) * zj / zi
        if q <= 1e-12 or q >= 1 - 1e-12:
            picked[held], held = int(q > 0.5), -1
    if held >= 0 and last:
        picked[held], held = int(draw[-1] < q), -1
    return picked, held, q


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row a document: id, size (words), source, source_size, target (its source's), copies, taken (size * copies).

    ``row_col`` names a unique number of the rows, which is carried along: it tells rows of one id, or of none, apart.

    A null text has size 0 and is never taken; a null source is a source of its own. The draws depend on the
    documents and the seed alone, so reruns agree. Repeated rows are drawn one by one. An empty table gives no row.
    """
    # rows of one id and size, and those without an id, are told apart by their text before their number, so that the
    # draws don't depend on it; ids stay whole in pandas only if none is null
    own = [F.xxhash64(docs[text_col]).alias("tie"), *([docs[row_col].alias("row")] if row_col else [])]
    ties = ["none", "tie", *(["row"] if row_col else [])]
    kind = docs.schema[id_col].dataType
    filler = F.lit(0).cast(kind) if isinstance(kind, NumericType) else F.lit(None).cast(kind)
    sized = materialize(docs.select(F.coalesce(docs[id_col], filler).alias("id"), docs[id_col].isNull().alias("none"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *own), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = by_source.join(source_targets(by_source.drop("rows"), share, weights, most).withColumnRenamed("source", "s").drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = materialize(targets.withColumn("groups", F.ceil(F.col("rows") / LEAF_ROWS).cast("long")), "mix-targets").withColumnRenamed("source", "s")
    levels = math.ceil(math.log(max(2, targets.agg(F.max("groups")).first()[0] or 1), FAN_IN))
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = sized.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumns({"base": F.floor(f).cast("long"), "p": f - F.floor(f), "bucket": F.pmod(F.xxhash64("none", "id", "size", "tie"), F.col("groups"))})
    columns = ", ".join(["id, source, size, source_size, target, base, p, bucket", *ties])
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in columns.split(", "))

    def level(open_rows: DataFrame, last: bool, step: int) -> DataFrame:
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["none", "id", "size", "bucket", *ties[1:]], kind="stable", ignore_index=True)
            own = zlib.crc32(f"{seed}|{step}|{g['source'][0]}|{g['node'][0]}".encode())
            p = g["p"].to_numpy(float, copy=True)
            picked, held, q = settle(g["size"].to_numpy(), p, own, last)
            if held >= 0:
                p[held] = q
            return g.drop(columns=["node"]).assign(p=p, picked=picked, open=np.arange(len(g)) == held)

        node = F.floor(F.col("bucket") / F.lit(FAN_IN**step)) if step else F.col("bucket")
        return open_rows.select(*columns.split(", "), node.cast("long").alias("node")).groupBy("source", "node").applyInPandas(run, f"{kinds}, picked long, open boolean")

    done = []
    for step in range(levels + 1):
        rows = materialize(level(d, step == levels, step), f"mix-level{step}")
        done.append(rows.filter(~F.col("open")))
        d = rows.filter("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.col("picked")
    return out.select(F.when(~F.col("none"), F.col("id")).alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *([F.col("row").alias(row_col)] if row_col else []))
