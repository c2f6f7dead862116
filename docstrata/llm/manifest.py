"""Merkle manifest of a dataset: a tree of digests by source, one over the sources, and a proof for every row.

Leaves get their place in their source by a distributed sort. Aligned blocks of a power of the fanout are contiguous
digest matrices: rows of 64 hex bytes, reshaped by the fanout and hashed level by level; a leaf's siblings are found by
index arithmetic. Blocks' roots are the leaves of the next tree, until a source has one block, so a source of any size
spreads over tasks. On the way down each block gets the path above it and adds its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from docstrata.llm.ranks import joined, ranked
from docstrata.llm.store import materialize
from docstrata.llm.textbytes import gather, string_array

FANOUT = 3
#: Levels of the tree in one block: a block has at most FANOUT ** HEIGHT leaves.
HEIGHT = 7
#: Bytes of proofs that a task gathers before it sends them on.
SEND_BYTES = 8 << 20
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)
PATH = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))


def framed(*names: str) -> Column:
    """The columns one after the other, each ``-`` if null, else its UTF-8 bytes' number, a colon and itself."""
    texts = [F.col(c).cast("string") for c in names]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(proof, leaf, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


def parents_of(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of a digest matrix: one row for every ``fanout`` rows, the last ones may be fewer."""
    whole = len(nodes) // fanout * fanout
    runs = [*nodes[:whole].reshape(-1, fanout * 64)]
    if whole < len(nodes):
        runs.append(nodes[whole:].ravel())
    return np.frombuffer("".join([hashlib.sha256(x).hexdigest() for x in runs]).encode(), np.uint8).reshape(-1, 64)


def levels_of(leaves: np.ndarray, fanout: int, height: int | None) -> list[np.ndarray]:
    """All levels over the leaves: ``height`` of them, or as many as lead to one node."""
    out = [leaves]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append(parents_of(out[-1], fanout))
    return out


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All levels' bytes, and for each leaf and level the first byte and the length of what stands left and right of it there.

    Starts and lengths have the shape (leaves, levels, 2).
    """
    n, tall = len(levels[0]), len(levels) - 1
    starts, sizes = np.zeros((n, tall, 2), np.int64), np.zeros((n, tall, 2), np.int64)
    own, base = np.arange(n), 0
    for k in range(tall):
        first = own - own % fanout
        last = np.minimum(first + fanout, len(levels[k]))
        starts[:, k, 0], starts[:, k, 1] = base + first * 64, base + (own + 1) * 64
        sizes[:, k, 0], sizes[:, k, 1] = (own - first) * 64, (last - own - 1) * 64
        own, base = own // fanout, base + len(levels[k]) * 64
    return np.concatenate([x.ravel() for x in levels]), starts, sizes


def _leaves(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's members, and their digests as a matrix of hex bytes in that order."""
    order = np.argsort(members.field("index").to_numpy(zero_copy_only=False))
    raw = np.frombuffer(b"".join(members.field("digest").to_pylist()), np.uint8).reshape(-1, 32)
    return order, _HEX[raw[order]].reshape(-1, 64)


def _forest(nodes: DataFrame, group: list[str], fanout: int, height: int, name: str) -> list[DataFrame]:
    """Tables of blocks, from the leaves' up to the one that has a single block a group.

    ``nodes`` has the group, ``_index``, ``_total``, ``digest`` (binary) and ``data``. A block has the group, block,
    blocks (of its group), members and root (hex).
    """
    size, tables = fanout**height, []
    while True:
        members = F.collect_list(F.struct(F.col("_index").alias("index"), "digest", "data")).alias("members")
        blocks = nodes.groupBy(*group, F.floor(F.col("_index") / size).alias("block")).agg(F.first("_total").alias("total"), members)
        blocks = blocks.select(*group, "block", F.ceil(F.col("total") / size).alias("blocks"), "members")
        schema = StructType([*blocks.schema.fields, StructField("root", StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                roots = []
                for k in range(len(b)):
                    tall = None if b.column("blocks")[k].as_py() == 1 else height
                    roots.append(levels_of(_leaves(b.column("members")[k].values)[1], fanout, tall)[-1].tobytes().decode())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], [*b.schema.names, "root"])

        tables.append(materialize(blocks.mapInArrow(run, schema), name, "zstd"))
        if (tables[-1].agg(F.max("blocks")).head()[0] or 1) == 1:
            return tables
        nodes = tables[-1].select(*group, F.col("block").alias("_index"), F.col("blocks").alias("_total"), F.unhex("root").alias("digest"), F.lit(None).cast("string").alias("data"))


def _descend(tables: list[DataFrame], group: list[str], above: DataFrame | None, fanout: int, height: int) -> DataFrame:
    """Every leaf's data, its digest and its path to the top: siblings left and right by level, then its group's in ``above``.

    ``above`` has the group, ``path`` and ``head``, a struct that comes along; without it the top is the root.
    """
    paths = above
    for k in reversed(range(len(tables))):
        blocks, on = tables[k].drop("root"), group if k == len(tables) - 1 else [*group, "block"]
        if paths is None:
            blocks = blocks.select("*", F.array().cast(PATH).alias("path"), F.struct(F.lit(0)).alias("head"))
        else:
            blocks = joined(blocks, paths, on)
        fields = {f.name: f for f in blocks.schema.fields}
        member = {f.name: f.dataType for f in fields["members"].dataType.elementType.fields}
        schema = StructType([*[fields[c] for c in group], StructField("index", member["index"]), StructField("digest", BinaryType()), StructField("data", member["data"]), StructField("path", PATH), StructField("head", fields["head"].dataType)])

        def run(batches: Iterator[pa.RecordBatch], schema: StructType = schema) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            out = to_arrow_schema(schema)
            found, held = [], 0
            for b in batches:
                for k in range(len(b)):
                    members, path = b.column("members")[k].values, b.column("path")[k].values
                    order, leaves = _leaves(members)
                    source, starts, sizes = siblings(levels_of(leaves, fanout, None if b.column("blocks")[k].as_py() == 1 else height), fanout)
                    n, tall, over = len(order), starts.shape[1], len(path)
                    upper = [x.encode() for pair in zip(path.field("left").to_pylist(), path.field("right").to_pylist()) for x in pair]
                    lengths = np.array([len(x) for x in upper], np.int64)
                    begins = len(source) + np.cumsum(lengths) - lengths
                    source = np.concatenate([source, np.frombuffer(b"".join(upper), np.uint8)])
                    starts = np.concatenate([starts, np.broadcast_to(begins.reshape(1, over, 2), (n, over, 2))], axis=1)
                    sizes = np.concatenate([sizes, np.broadcast_to(lengths.reshape(1, over, 2), (n, over, 2))], axis=1)
                    sides = [string_array(gather(source, starts[:, :, s].ravel(), sizes[:, :, s].ravel()), np.append(0, np.cumsum(sizes[:, :, s].ravel()))).cast(pa.string()) for s in (0, 1)]
                    pairs = pa.StructArray.from_arrays(sides, ["left", "right"])
                    proofs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (tall + over), pa.int32()), pairs)
                    same_for_all = pa.array(np.full(n, k))
                    columns = {**{c: b.column(c).take(same_for_all) for c in group}, "index": members.field("index").take(pa.array(order)), "digest": members.field("digest").take(pa.array(order)), "data": members.field("data").take(pa.array(order)), "path": proofs, "head": b.column("head").take(same_for_all)}
                    found.append(pa.table({f.name: columns[f.name] for f in out}).cast(out))
                    held += int(sizes.sum())
                    if held > SEND_BYTES:
                        yield from pa.concat_tables(found).combine_chunks().to_batches()
                        found, held = [], 0
            if found:
                yield from pa.concat_tables(found).combine_chunks().to_batches()

        paths = blocks.mapInArrow(run, schema)
        if k:
            paths = paths.select(*group, F.col("index").alias("block"), "path", "head")
    return paths


def merkle_proofs(rows: DataFrame, leaf_col: str, group_col: str, order: list[str], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """The rows with ``subroot`` (their group's), ``root`` and ``proof``, an array of (left, right) siblings from the leaf to the root.

    ``leaf_col`` has digests in hex. In each group leaves ascend by ``order`` (nulls first), then by digest; every
    ``fanout`` nodes are hashed to one while a group has several, the last ones may be fewer, and a lone leaf is its
    subroot. Subroots in the order of their groups, null first, are joined likewise. Rows that are equal in all columns
    stay rows of their own, null groups are one group, an empty table gives no row. Columns may have any names but
    subroot, root and proof.
    """
    data = F.struct(*[F.col(c) for c in rows.columns if c not in (leaf_col, group_col)]) if len(rows.columns) > 2 else F.lit(None).cast("string")
    nodes = rows.select(F.col(group_col).alias("group"), F.unhex(leaf_col).alias("digest"), F.struct(*order).alias("order"), data.alias("data"))
    placed = ranked(nodes, ["group"], [*[F.col(f"order.{c}") for c in order], F.col("digest")], "manifest-leaves")
    trees = _forest(placed.drop("order"), ["group"], fanout, height, "manifest-blocks")
    tops = trees[-1].select("group", F.col("root").alias("subroot"))
    heads = ranked(tops, [], [F.col("group").asc_nulls_first()], "manifest-groups")
    crown = _forest(heads.select(F.lit(0).alias("all"), "_index", "_total", F.unhex("subroot").alias("digest"), F.struct("group").alias("data")), ["all"], fanout, height, "manifest-crown")
    top = crown[-1].select("root").head()
    above = _descend(crown, ["all"], None, fanout, height)
    above = above.select("data.group", "path", F.struct(F.lower(F.hex("digest")).alias("subroot"), F.lit(top[0] if top else None).cast("string").alias("root")).alias("head"))
    found = _descend(trees, ["group"], above, fanout, height)
    own = {leaf_col: F.lower(F.hex("digest")), group_col: F.col("group")}
    return found.select(*[own.get(c, F.col("data")[c]).alias(c) for c in rows.columns], "head.subroot", "head.root", F.col("path").alias("proof"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """A leaf for each document: the digest of doc_id, source, lang, n_chars and text, and ``tampered``.

    ``tampered`` is the digest with the text's line feeds deleted, where 2 divides the unsigned crc32 of the decimal
    doc_id, else null; a null id is never tampered with, a null text stays null. Other columns are left out.
    """
    before, text = framed("doc_id", "source", "lang", "n_chars"), framed("text")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    docs = docs.select("doc_id", "source", F.sha2(F.concat(before, text), 256).alias("leaf"), before.alias("before"), even.alias("even"), F.regexp_replace("text", "\n", "").alias("text"))
    return docs.select("doc_id", "source", "leaf", F.when(F.col("even"), F.sha2(F.concat("before", text), 256)).alias("tampered"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what the proofs say of the tampered texts.

    One row a document: doc_id, source, leaf, subroot, root, proof, proof_sha256 (digest of the siblings from left to
    right, level by level; of nothing where a tree has one leaf), folded_root and verified.
    """
    found = merkle_proofs(document_leaves(docs), "leaf", "source", ["doc_id"])
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = F.sha2(F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    return found.select("doc_id", "source", "leaf", "subroot", "root", "proof", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
