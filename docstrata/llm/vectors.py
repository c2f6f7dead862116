"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors are one class. A class's vector is hashed into a bucket of each table: two rotations, each giving the
largest coordinate and its sign. It also enters the buckets of the next best coordinates. Pairs of a bucket are
compared in double precision, block by block; a pair that meets in several buckets counts in the first one, which
either side's codes tell, so no pairs are written: a block gives each vector its number of links and a local root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.components import components, run_starts, sorted_blocks, tiles
from docstrata.llm.store import materialize

LEAST = 0.9
TABLES, PROBES = 10, 4
ROUNDS = 3
#: Rows of a part of a bucket.
PART_ROWS = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    x, step = x.copy(), 1
    while step < x.shape[1]:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
        step *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket codes (rows, tables, 1 + probes): the own bucket, then the next best ones.

    With a second best coordinate for either rotation the probes are, in order of the margin given up: one of the two
    replaced, then both; further ones replace by the third best.
    """
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    wide = np.zeros((len(x), d))
    wide[:, : x.shape[1]] = x
    rng = np.random.Generator(np.random.PCG64(seed))
    signs = rng.choice([-1.0, 1.0], (tables, 2, ROUNDS, d))
    out = np.empty((len(x), tables, 1 + probes), np.int32)
    depth = min(3, d)
    pairs = [(i, j) for i in range(depth) for j in range(depth)]
    for t in range(tables):
        best, loss = [], []
        for f in range(2):
            y = wide
            for r in range(ROUNDS):
                y = hadamard(y * signs[t, f, r])
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :depth]
            value = np.take_along_axis(y, top, 1)
            best.append(top * 2 + (value < 0))
            loss.append((np.abs(value[:, :1]) - np.abs(value)) / np.maximum(np.linalg.norm(y, axis=1), 1e-300)[:, None])
        cost = np.stack([loss[0][:, i] ** 2 + loss[1][:, j] ** 2 for i, j in pairs], 1)
        cost[:, 0] = -1
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        every = np.stack([best[0][:, i] * (2 * d) + best[1][:, j] for i, j in pairs], 1)
        found = np.take_along_axis(every, order, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether pairs of code rows (pairs, tables, 1 + probes), which meet in this bucket, meet in none before it.

    They meet where the own bucket of either side is among the buckets of the other; in order of table, then bucket.
    """
    left = np.ones(len(a), bool)
    for t in range(table + 1):
        k = np.flatnonzero(left)
        x, y = a[k, t], b[k, t]
        xy, yx = (x[:, :1] == y).any(1), (y[:, :1] == x).any(1)
        if t < table:
            left[k] = ~(xy | yx)
        else:
            earlier = xy & (x[:, 0] < bucket) | yx & (y[:, 0] < bucket)
            left[k] = ~earlier
    return left


def near_vectors(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors of a cosine of ``least`` or more: one row a vector with n_links, component_id and kept.

    n_links counts other rows linked directly; component_id is the smallest id reachable, its own included; kept says
    that this is the row's id. Null, zero, non-finite vectors and those with null components link with nothing, nor
    do vectors of different widths. Equal vectors are linked without being compared. Rows without an id are linked
    but name no component; if none of a component has an id, component_id is null and kept true. Finite vectors of any
    size are compared, however large or small. Only the id and the
    vector are read, so other columns can't clash; an empty table gives no row. Vectors of any width are held whole.
    """
    key = vectors.schema[id_col].dataType
    v = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.col("v")))
    classes = v.filter("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = np.diff(b.column(1).offsets.to_numpy())
            for w in np.unique(width):
                own = b.filter(pa.array(width == w))
                for at in range(0, own.num_rows, 1024):
                    part = own.slice(at, 1024)
                    x = part.column(1).flatten().to_numpy().reshape(-1, int(w))
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by a power of two: exact, and squares stay finite
                    c = codes(x, tables, probes)
                    m = len(x)
                    rows = np.repeat(np.arange(m), tables * (1 + probes))
                    table = np.tile(np.repeat(np.arange(tables), 1 + probes), m)
                    bucket, first = c.reshape(-1), np.tile(np.arange(1 + probes), m * tables) == 0
                    keep = first | (bucket != np.repeat(c[:, :, 0].reshape(-1), 1 + probes))
                    rows, table, bucket, first = rows[keep], table[keep], bucket[keep], first[keep]
                    blobs = pa.array([r.tobytes() for r in c.reshape(m, -1)], pa.binary())
                    whole = pa.array([r.tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(bucket, pa.int32()), pa.array(np.full(len(rows), w, np.int32)), part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows)), pa.array(first), blobs.take(pa.array(rows)), whole.take(pa.array(rows))], ["t", "b", "w", "node", "n", "first", "codes", "x"])

    entered = classes.select("node", "v", "n").mapInArrow(enter, "t int, b int, w int, node long, n long, first boolean, codes binary, x binary")
    dealt = tiles(entered, ["t", "b", "w"], "node", PART_ROWS)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("t", "b", "w", "tile", "node", "n", "first", "codes", "x", "own", "parts").repartition(n, "t", "b", "w", "tile").sortWithinPartitions("t", "b", "w", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_blocks(batches, 4):
            starts = run_starts(block, 4)
            t, b, w, tile, node, own, parts = (block.column(k).to_numpy() for k in ("t", "b", "w", "tile", "node", "own", "parts"))
            count, first = block.column("n").to_numpy(), block.column("first").to_numpy()
            out = []
            for i, j in zip(starts[:-1], starts[1:]):
                if j - i < 2 or not first[i:j].any():
                    continue
                r = slice(int(i), int(j))
                x = np.frombuffer(b"".join(block.column("x").slice(i, j - i).to_pylist())).reshape(j - i, -1)
                c = np.frombuffer(b"".join(block.column("codes").slice(i, j - i).to_pylist()), np.int32).reshape(j - i, tables, -1)
                out.append(_block(x / np.linalg.norm(x, axis=1)[:, None], c, node[r], count[r], first[r], own[r], int(parts[i]), int(tile[i]), int(t[i]), int(b[i]), least))
            if out:
                found = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["node", "links", "root"])

    part = materialize(dealt.mapInArrow(compare, "node long, links long, root long"), "vector-links")
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(part.select(F.col("node").alias("u"), F.col("root").alias("v")))
    c = classes.select("node", "v", "low", "n").join(links, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lows = c.groupBy("label").agg(F.min("low").alias("component_id"))
    c = c.join(lows, "label").select(F.col("v").alias("cv"), "n", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    c = materialize(c, "vector-labels")
    # vectors that link with nothing stay out of the join: they would all have one key
    d = v.filter("v is not null").withColumn("h", F.xxhash64("v")).join(c.withColumn("h", F.xxhash64("cv")), "h").filter("v = cv")
    component = F.col("component_id").cast(key)
    linked = d.select(F.col("id").alias(id_col), (F.col("n") - 1 + F.col("links")).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    alone = v.filter("v is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def _block(x: np.ndarray, c: np.ndarray, node: np.ndarray, count: np.ndarray, first: np.ndarray, own: np.ndarray, parts: int, tile: int, table: int, bucket: int, least: float, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one tile: the linked nodes, the rows they link with, and the smallest node each reaches here."""
    m = len(x)
    links, root = np.zeros(m, np.int64), node.copy()
    edges = []
    for at in range(0, m, step):
        i, j = np.nonzero(x[at : at + step] @ x.T >= least)
        i += at
        ok = (i < j) & (first[i] | first[j])
        # rows of one part meet in every tile of the part; the one with itself counts
        ok &= (own[i] != own[j]) | (own[i] * parts + own[j] == tile)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            new = _first_meeting(c[a], c[b], table, bucket)
            a, b = a[new], b[new]
            np.add.at(links, a, count[b])
            np.add.at(links, b, count[a])
            edges.append((a, b))
    if not edges:
        return node[:0], links[:0], root[:0]
    a, b = (np.concatenate(z) for z in zip(*edges))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    some = links > 0
    return node[some], links[some], root[some]
