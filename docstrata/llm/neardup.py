"""Near-dedup by Order MinHash: minimum occurrence-labelled shingles in text order, verified by banded alignment.

A sketch of a document takes the shingles of the smallest hash values, each occurrence of a shingle having a value of
its own, and hashes them in the order in which they stand in the text. Documents that share a sketch are compared in
blocks: an alignment of their shingle sequences within a band finds the shingles they have in common in the same
order. The first tables of sketches join most groups; later ones only compare documents that no link joins yet.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from docstrata.llm.components import components, run_starts, sorted_blocks, tiles
from docstrata.llm.store import materialize
from docstrata.llm.textbytes import RangeHash, gather, hash_bytes, mixed, row_blocks, text_bytes, word_spans

SHINGLE = 5
LEAST = 0.8
#: Sketches a document, shingles a sketch, and how many sketches each pass looks at.
SKETCHES, DEPTH = 12, 3
PASSES = (2, 10)
BLOCK_BYTES = 2 << 20
#: Documents of a part of a bucket, and of a tile from which on all its pairs are counted at once.
PART_ROWS, MATRIX_ROWS = 256, 6


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of rows of word hashes, and each row's number; a row shorter than a shingle is one."""
    lengths = np.diff(first)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    at = gather(np.arange(len(words)), first[:-1], counts)
    row = np.repeat(np.arange(len(lengths)), counts)
    return mixed(RangeHash(words)(at, np.minimum(at + size, first[1:][row]))), counts


def order_minhash(hashes: np.ndarray, counts: np.ndarray, sketches: int = SKETCHES, depth: int = DEPTH, seed: int = 5) -> np.ndarray:
    """Sketch keys (rows, sketches) of rows of shingle hashes; rows without shingles give zeros."""
    keys = np.zeros((len(counts), sketches), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return keys
    counts = counts[some]
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    # label each occurrence of a shingle in its row with the number of the same before it
    order = np.lexsort((hashes, row))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    k = np.arange(len(order))
    nth = np.empty(len(order), np.uint64)
    nth[order] = k - np.maximum.accumulate(np.where(same, 0, k))
    labelled = mixed(hashes + nth * np.uint64(0xA24BAED4963EE407))
    rng = np.random.Generator(np.random.PCG64(seed))
    factors = rng.integers(0, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for s in range(sketches):
        values = labelled * factors[s]
        picked = np.full((depth, len(counts)), len(hashes))
        for d in range(depth):
            least = np.minimum.reduceat(values, starts)
            hit = np.flatnonzero(values == np.repeat(least, counts))
            if d:
                hit = hit[counts[row[hit]] > d]
            picked[d, row[hit]] = hit
            values[hit] = np.uint64(0xFFFFFFFFFFFFFFFF)
        picked.sort(axis=0)
        padded = np.append(hashes, np.uint64(0))
        key = np.full(len(counts), s + 1, np.uint64)
        for d in range(depth):
            key = mixed(key * np.uint64(0x9FB21C651E98DF25) + padded[picked[d]])
        keys[some, s] = key
    return keys


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence over alignments that stay within ``band`` of the diagonal.

    Bit-parallel: a window of 2 * band + 1 bits moves down the rows; a zero bit is a row that raised the length.
    """
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    v, low, total = full, 0, 0
    for j, x in enumerate(b):
        if j - band > low:
            total += 1 - (v & 1)
            v, low = (v >> 1) | (1 << (width - 1)), low + 1
        rows = where.get(x)
        if rows:
            m = 0
            for i in rows[bisect_left(rows, low) :] if len(rows) > 1 else rows:
                if i >= low + width:
                    break
                if i >= low:
                    m |= 1 << (i - low)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
    return total + width - v.bit_count()


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the shingles in common, in order, are ``least`` or more of all shingles of both."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return False
    band = int((n + m) * (1 - 2 * least / (1 + least)) + 1e-9)  # shingles that both may have alone
    need = least * (n + m) / (1 + least) - 1e-9
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[n - (k - head) :][::-1] != b[m - (k - head) :][::-1])
    tail = int(differ[0]) if len(differ) else k - head
    x, y = a[head : n - tail], b[head : m - tail]
    if head + tail + min(len(x), len(y)) < need:
        return False
    if len(x) and len(y) and head + tail < need:
        if head + tail + min(int(np.isin(x, y).sum()), int(np.isin(y, x).sum())) < need:
            return False
        return head + tail + banded_lcs(x.tolist(), y.tolist(), band) >= need
    return head + tail >= need


def common_shingles(seqs: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Shingles that each two sequences have in common, as multisets: a matrix product over occurrences that two share."""
    labels = []
    for s in seqs:
        order = np.argsort(s, kind="stable")
        k = np.arange(len(s))
        same = np.zeros(len(s), bool)
        same[1:] = s[order][1:] == s[order][:-1]
        nth = (k - np.maximum.accumulate(np.where(same, 0, k))).astype(np.uint64)
        labels.append(mixed(s[order] + nth * np.uint64(0xA24BAED4963EE407)))
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    _, of, count = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    column = (np.cumsum(count > 1) - 1)[of]
    some = count[of] > 1
    owner, column = owner[some], column[some]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(seqs), len(seqs)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [begin, begin + columns])
        m = np.zeros((len(seqs), columns), np.float32)
        m[owner[a:b], column[a:b] - begin] = 1
        out += m @ m.T
    return out


def sketch(docs: DataFrame, size: int = SHINGLE, sketches: int = SKETCHES, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (unique), node (a hash of the word sequence, null without words), keys (array) and words (packed hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = word_spans(part, own)
                words = hash_bytes(part, starts, ends)
                hashes, counts = shingle_hashes(words, first, size)
                keys = order_minhash(hashes, counts, sketches, depth)
                n = np.diff(first)
                node = mixed(RangeHash(words)(first[:-1], first[1:]) + n.astype(np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * sketches), pa.array(keys.view(np.int64).ravel()))
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(first * 4), pa.py_buffer(words.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.arange(at, at + j - i)), pa.array(node, mask=n == 0), lists, packed.cast(pa.binary())], ["id", "row", "node", "keys", "words"])
                at += j - i

    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("row", LongType()), StructField("node", LongType()), StructField("keys", ArrayType(LongType())), StructField("words", BinaryType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def _linked(rows: DataFrame, words: DataFrame, size: int, least: float, partitions: int, begin: int) -> DataFrame:
    """Links (u, v) that join all documents of a bucket (s, key) that verified pairs join. rows: s, key, node, label.

    Documents of one label are joined already, and so are those that a link of the block has joined. Pairs that share
    a sketch before ``begin`` were compared in an earlier pass and aren't compared again.
    """
    dealt = tiles(rows, ["s", "key"], "node", PART_ROWS).join(words, "node")
    dealt = dealt.select("s", "key", "tile", "node", "label", "own", "parts", "words", "keys").repartition(partitions, "s", "key", "tile").sortWithinPartitions("s", "key", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_blocks(batches, 3):
            starts = run_starts(block, 3)
            tile, node, label, own, parts = (block.column(k).to_numpy() for k in ("tile", "node", "label", "own", "parts"))
            blobs, keys = block.column("words"), block.column("keys").combine_chunks()
            keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(block.num_rows, -1)[:, :begin]
            us, vs = [], []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                root = np.unique(label[i:j], return_inverse=True)[1]
                if not root.any():
                    continue
                seqs: dict[int, np.ndarray] = {}

                def sequence(k: int, i: int = i, seqs: dict = seqs) -> np.ndarray:
                    if k not in seqs:
                        w = np.frombuffer(blobs[i + k].as_buffer(), "<u4").astype(np.uint64)
                        seqs[k] = shingle_hashes(w, np.array([0, len(w)]), size)[0]
                    return seqs[k]

                o, grid = own[i:j], parts[i]
                # two rows of one part meet in every tile of the part; the one with itself counts
                open_ = np.triu(root[:, None] != root[None, :], 1) & ((o[:, None] != o[None, :]) | ((o * grid + o)[:, None] == tile[i]))
                for k in range(begin):
                    open_ &= keys[i:j, k][:, None] != keys[i:j, k][None, :]
                if j - i >= MATRIX_ROWS and open_.any():
                    lengths = np.array([len(sequence(k)) for k in range(j - i)])
                    shared = common_shingles([sequence(k) for k in range(j - i)])
                    open_ &= shared >= least * (lengths[:, None] + lengths[None, :]) / (1 + least) - 1e-3
                for x, y in zip(*(z.tolist() for z in np.nonzero(open_))):
                    if root[x] != root[y] and alike(sequence(x), sequence(y), least):
                        us.append(node[i + x])
                        vs.append(node[i + y])
                        root[root == root[y]] = root[x]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: float = LEAST, sketches: int = SKETCHES, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, class_id (the smallest id of its group) and kept (whether that is its own).

    Two documents are linked if their sequences of shingles of ``size`` words have ``least`` or more in common, in
    order, out of all shingles of both; a group is what links join. Equal word sequences are one without comparing. A
    document shorter than a shingle is one shingle. Documents without words (null, empty) are alone. Rows without
    an id are grouped but name no class; a group of such rows alone has class_id null and is kept. Rows that share
    the smallest id are all kept. Word sequences are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = materialize(sketch(docs, size, sketches, depth, id_col, text_col), "sketches", "zstd")
    known = sketched.filter("node is not null")
    rows = known.select("node", F.posexplode("keys").alias("s", "key")).distinct()
    counts = rows.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = materialize(rows.join(counts, ["s", "key"]), "shared-sketches")
    # one row of each word sequence, by its unique number: the words of copies are not shuffled to one place
    chosen = known.groupBy("node").agg(F.min("row").alias("row")).join(rows.select("node").distinct(), "node", "left_semi")
    words = materialize(known.select("row", "node", "words", "keys").join(chosen.select("row"), "row", "left_semi").select("node", "words", "keys"), "shared-words")
    links, label, begin = None, None, 0
    for many in PASSES:
        own = rows.filter(F.col("s").between(begin, begin + many - 1))
        if label is None:
            own = own.withColumn("label", F.col("node"))
        else:
            own = own.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
            open_ = own.groupBy("s", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("s", "key")
            own = own.join(open_, ["s", "key"], "left_semi")
        found = materialize(_linked(own.select("s", "key", "node", "label"), words, size, least, n, begin), "near-links")
        links = found if links is None else links.unionByName(found)
        label = materialize(components(links), "near-labels")
        begin += many
    d = sketched.select("id", "row", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = d.filter("label is not null").groupBy("label").agg(F.min("id").alias("class_id"))
    out = d.join(classes, "label", "left")
    class_id = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), class_id.eqNullSafe(F.col("id")).alias("kept"))
