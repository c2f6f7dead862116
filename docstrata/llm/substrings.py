"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Documents are dealt into parts. A part's distinct window hashes go, sorted and packed, to the buckets of the hash
range; a bucket finds the hashes that more than one window has and sends each part its own of them. The part then
hashes its windows again, marks the words that repeated windows cover and merges them into maximal intervals. What
is shuffled is the text once and some six bytes a window, whatever the repeats; a passage that very many documents
share counts once a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docstrata.llm.textbytes import RangeHash, distinct, gather, hash_bytes, mixed, row_blocks, string_array, text_bytes, word_spans

WINDOW = 35
BLOCK_BYTES = 4 << 20
#: Parts for each shuffle partition, so that no partition is much larger than others; buckets are so many times fewer
#: than partitions, so the packed rows, one a part and bucket, are no more than the blocks of any shuffle.
PARTS = 2


def packed(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first one, and how far the others stand from it.

    That is the steps between them in so many bytes each; or, where it is shorter, so many low bytes of each distance,
    and the rest of them as a string of bits in which the k-th one stands at k and the rest of the k-th key together.
    """
    if not len(sorted_keys):
        return b""
    first, steps = sorted_keys[:1].astype("<u8").tobytes(), np.diff(sorted_keys)
    n, most = len(sorted_keys), int(sorted_keys[-1] - sorted_keys[0])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    low = min(range(1, 8), key=lambda w: n * w + (n + (most >> 8 * w)) // 8)
    if n * low + (n + (most >> 8 * low)) // 8 + 9 >= len(steps) * width:
        return first + bytes([width]) + _low_bytes(steps, width)
    far = sorted_keys - sorted_keys[0]
    ones = np.zeros(n + (most >> 8 * low), bool)
    ones[(far >> np.uint64(8 * low)).view(np.int64) + np.arange(n)] = True
    return first + bytes([128 + low]) + n.to_bytes(8, "little") + _low_bytes(far, low) + np.packbits(ones).tobytes()


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low_bytes(raw: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.view("<u8").ravel()


def unpacked(blob: bytes | memoryview) -> np.ndarray:
    """The keys of ``packed``."""
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    first, width = raw[:8].view("<u8")[0], int(raw[8])
    if width > 128:
        width, n = width - 128, int(raw[9:17].view("<u8")[0])
        ones = np.flatnonzero(np.unpackbits(raw[17 + n * width :]).view(bool))
        return ((ones - np.arange(n)).view(np.uint64) << np.uint64(8 * width) | _from_low_bytes(raw[17 : 17 + n * width], width)) + first
    steps = _from_low_bytes(raw[9:], width)
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = first
    np.cumsum(steps, out=out[1:])
    out[1:] += first
    return out


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Hashes of all windows of ``window`` words within a row, the word each begins with, and all words' spans."""
    starts, ends, first = word_spans(data, offsets)
    words = hash_bytes(data, starts, ends)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    at = gather(np.arange(len(words)), first[:-1], counts)
    return mixed(RangeHash(words)(at, at + window)), at, starts, ends, first


def _blobs(table: pa.Table, name: str) -> list[np.ndarray]:
    return [unpacked(x.as_buffer()) for chunk in table.column(name).chunks for x in chunk]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words whose word sequence also starts anywhere else.

    One row a document: its id, n_words, n_removed, kept_text (the kept words joined by one space) and removed, the
    maximal intervals (first word, word after the last). Repeats within a document count, the first occurrence goes
    as well, and windows are judged on the input. Null or empty text: no words, empty kept_text. Documents shorter
    than a window lose nothing. Repeated rows are repeats of each other. Hashes have 64 bits and are not verified:
    two different ones among n windows meet with a probability of about n^2 / 2^65.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, buckets = n * PARTS, max(8, n // PARTS)
    key = docs.schema[id_col].dataType
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    d = d.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")).repartition(n, "part")
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def emit(t: pa.Table) -> pa.Table:
        found = []
        data, offsets = text_bytes(t.column("text"))
        for i, j in row_blocks(offsets, BLOCK_BYTES):
            found.append(window_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)[0])
        keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        once, more = keys[counts == 1], keys[counts > 1]
        rows = []
        a, b = np.append(np.searchsorted(once, edges), len(once)), np.append(np.searchsorted(more, edges), len(more))
        for k in range(buckets):
            x, y = once[a[k - 1] if k else 0 : a[k]], more[b[k - 1] if k else 0 : b[k]]
            if len(x) or len(y):
                rows.append((k, packed(x), packed(y)))
        part = t.column("part")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "once": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        once, more = _blobs(t, "once"), _blobs(t, "more")
        keys = np.sort(np.concatenate(once + more))
        again = distinct(np.concatenate([keys[1:][keys[1:] == keys[:-1]], *more]))
        out = []
        for x, y in zip(once, more):
            at = np.searchsorted(again, x)
            at[at == len(again)] = 0
            mine = x[again[at] == x] if len(again) else x[:0]
            out.append(packed(np.sort(np.concatenate([mine, y]))))
        sent = pa.table({"part": t.column("part"), "again": pa.chunked_array([pa.array(out, pa.binary())])})
        return sent.filter(pa.array([bool(x) for x in out]))

    def cut(t: pa.Table, r: pa.Table) -> pa.Table:
        again = np.sort(np.concatenate([np.zeros(0, np.uint64), *_blobs(r, "again")]))
        if not len(t):
            return empty
        data, offsets = text_bytes(t.column("text"))
        out = [_cut_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], again, window) for i, j in row_blocks(offsets, BLOCK_BYTES)]
        return pa.table({"id": t.column("id"), **{k: pa.chunked_array([x[k] for x in out]) for k in ("n_words", "n_removed", "kept_text", "removed")}})

    whole = StructType([StructField("id", key), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), StructField("removed", ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())])))])
    empty = pa.table({"id": pa.array([], pa.null()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "removed": pa.array([], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))})
    hashes = d.groupBy("part").applyInArrow(emit, "bucket int, part int, once binary, more binary")
    again = hashes.groupBy("bucket").applyInArrow(count, "part int, again binary").repartition(n, "part")
    out = d.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(cut, whole)
    return out.withColumnRenamed("id", id_col)


def _cut_block(data: np.ndarray, offsets: np.ndarray, again: np.ndarray, window: int) -> dict[str, pa.Array]:
    keys, at, starts, ends, first = window_hashes(data, offsets, window)
    place = np.searchsorted(again, keys)
    place[place == len(again)] = 0
    at = at[again[place] == keys] if len(again) else at[:0]
    steps = np.zeros(len(starts) + window + 1, np.int32)
    steps[at] += 1  # each word begins one window at most
    steps[at + window] -= 1
    gone = np.cumsum(steps)[: len(starts)] > 0
    sums = np.append(0, np.cumsum(gone))
    removed = sums[first[1:]] - sums[first[:-1]]
    # kept words, each but a row's last followed by a space
    kept = np.flatnonzero(~gone)
    kept_first = np.searchsorted(kept, first)
    sizes = ends[kept] - starts[kept]
    lasts = kept_first[1:][np.diff(kept_first) > 0] - 1
    gaps = np.ones(len(kept), np.int64)
    gaps[lasts] = 0
    ends_at = np.cumsum(sizes + gaps)
    text = np.full(int(ends_at[-1]) if len(ends_at) else 0, 0x20, np.uint8)
    into = ends_at - gaps - sizes
    text[gather(np.arange(len(text)), into, sizes)] = gather(data, starts[kept], sizes)
    kept_offsets = np.append(0, ends_at)[kept_first]
    # maximal intervals of removed words, counted from the row's first word
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.ones(len(gone) + 1, bool)
    edge[1:-1] = (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])
    begins = np.flatnonzero(edge[:-1] & gone)
    finish = np.flatnonzero(edge[1:] & gone) + 1
    own = first[row[begins]] if len(begins) else begins
    spans = pa.StructArray.from_arrays([pa.array(begins - own, pa.int64()), pa.array(finish - own, pa.int64())], ["begin", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, first), pa.int32()), spans)
    return {"n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed), "kept_text": string_array(text, kept_offsets).cast(pa.string()), "removed": lists}
