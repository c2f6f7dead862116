"""Connected components of links, and helpers for tasks that go through sorted blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.store import drop_table, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v: two long columns); label is the component's smallest node.

    Large-star and small-star steps alternate: each joins the links with every node's smallest neighbour, so a node
    of very many links is summed before it is shuffled and its join may be split. Each round is written to the shared
    folder; the last one is that after which every node is linked to its component's smallest alone. Links of a node
    to itself and null ends are left out; no links give no rows.
    """
    low, high = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    held = materialize(links.filter("u != v").select(high, low).distinct(), "links")
    while not _stars(held):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        new = materialize(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u != v").distinct(), "links")
        drop_table(held)
        held = new
    roots = held.select("v").distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, which has none itself."""
    if links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0] > 1:
        return False
    return links.select("v").distinct().join(links.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty()


def sorted_blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows in runs that share the first ``keys`` columns, from batches sorted by them; many whole runs at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = np.ones(b.num_rows, bool)
        for k in range(keys):
            c = np.asarray(b.column(k))
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        same = held and all(held[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in range(keys))
        if cut or held and not same:
            if cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
            else:
                yield pa.Table.from_batches(held)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def tiles(rows: DataFrame, keys: list[str], salt: str, most: int) -> DataFrame:
    """Rows of each key dealt into tiles of at most about 2 * ``most`` rows so that any two rows meet in one tile.

    Adds own (the row's part of its key) and tile: a key of n rows has ceil(n / most) parts, and a tile is a pair of
    parts. Two rows of the same part meet in several tiles; tile_of() tells which one counts.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    d = rows.join(counts, keys).withColumn("parts", F.ceil(F.col("_n") / most).cast("int")).drop("_n")
    d = d.withColumn("own", F.pmod(F.xxhash64(salt), F.col("parts")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return d.withColumn("tile", F.least("own", "_o") * F.col("parts") + F.greatest("own", "_o")).drop("_o")


#: Hot keys up to this number are sent to every task; beyond, Spark joins them.
SENT_KEYS = 1_000_000
COUNTED = 16


def hot_tiles(rows: DataFrame, keys: list[str], salt: str, most: int) -> DataFrame:
    """As tiles(), but only keys of more than about ``most`` rows are joined, so other rows are shuffled once, to their tile.

    Keys of a single row stay. ``rows`` is read twice. A key's rows are reckoned from those of one in COUNTED salts; that
    decides into how many tiles all its rows are dealt, and nothing else.
    """
    some = rows.filter(F.pmod(F.xxhash64(salt), F.lit(COUNTED)) == 0).groupBy(*keys).agg((F.count(F.lit(1)) * COUNTED).alias("_n"))
    hot = materialize(some.filter(F.col("_n") > most), "hot-keys")
    d = rows.join(F.broadcast(hot) if hot.count() <= SENT_KEYS else hot, keys, "left")
    d = d.withColumn("parts", F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("int")).drop("_n")
    d = d.withColumn("own", F.pmod(F.xxhash64(salt, F.lit(1)), F.col("parts")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return d.withColumn("tile", F.least("own", "_o") * F.col("parts") + F.greatest("own", "_o")).drop("_o")
