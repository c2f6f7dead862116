"""Packing by concatenate and cut: two passes of prefix sums give every document a global token offset.

Pass one tokenizes each partition and stores, per document, its ids and its offset within the partition. The
partitions' totals (one small row each) are summed into base offsets. Pass two cuts the ids at the multiples of
the window length, which needs no shuffle of ids: a document's pieces follow from its own global offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.store import materialize
from docstrata.llm.textbytes import gather, hash_bytes, row_blocks, text_bytes

WINDOW = 2048
END_ID = 1
#: Bytes of text that a task tokenizes at once.
BLOCK_BYTES = 4 << 20
#: Distinct words whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 1_500_000

_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
#: Lead bytes of characters that are never white space: U+00C0-U+07FF and U+4000 on.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE4:0xF0] = True


def _chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a row starts, or a single space stands between two characters that aren't white space.

    A byte-level BPE's pre-tokenizer always cuts before such a space, so chunks are tokenized independently.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 2) & (at + 1 < len(data))]
    after = data[at + 1]
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    before = _GRAPH[one] | (one >= 0x80) & ((two >= 0xC0) & _LEAD2[two] | (two >= 0x80) & (two < 0xC0) & _LEAD3[three])
    at = at[before & (_GRAPH[after] | _LEAD[after])]
    return np.union1d(at, offsets[:-1][np.diff(offsets) > 0])


class WordEncoder:
    """Tokenizes each distinct chunk of text once and keeps its ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Add new chunks, whose sorted keys are not known yet."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum()))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin (one more than rows)."""
        starts = _chunk_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, of = np.unique(hash_bytes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != keys[at < len(self.keys)]
        if new.any():
            self._learn(keys[new], [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[of]
        sizes = self.sizes[at]
        sums = np.append(0, np.cumsum(sizes))
        return gather(self.ids, self.starts[at], sizes), sums[np.searchsorted(starts, offsets, "left")]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, its partition, its offset there, and its token ids followed by ``end_id``.

    ids is binary, little-endian unsigned 32-bit. A null text counts as empty and yields ``end_id`` alone. Rows keep
    their order; documents that share an id stay apart. The tokenizer must be a byte-level BPE; its file must be
    readable at the same path on every executor.
    """
    key = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, base = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                ids, at = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = at + np.arange(j - i + 1)
                out = np.full(at[-1], end_id, "<u4")
                keep = np.ones(at[-1], bool)
                keep[at[1:] - 1] = False
                out[keep] = ids
                blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at * 4), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(base + at[:-1]), pa.array(np.diff(at)), blob.cast(pa.binary())], ["id", "part", "at", "n", "ids"])
                base += int(at[-1])

    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    schema = StructType([StructField("id", key), StructField("part", IntegerType()), StructField("at", LongType()), StructField("n", LongType()), StructField("ids", BinaryType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens, whole but for the last.

    One row a piece: doc_id, start (its document's ids before it), length, ids (binary), doc_tokens, sequence_id,
    offset (in the sequence), sequence_tokens, padded_length. A sequence is padded to ``window`` unless the number
    of its tokens is a power of two. Rows are ordered by the input's partitions; each document's ids, the end id
    included, lie in consecutive pieces. Null or empty texts give a piece of one id; documents that share an id are
    packed one by one; an empty table gives no row.
    """
    tokens = materialize(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "tokens", "zstd")
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    # one row a partition of the input: its size is bounded by the number of tasks
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"), F.sum("total").over(Window.partitionBy()).alias("all_tokens"))
    at = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("at") + F.col("base"))
    last = F.floor((F.col("at") + F.col("n") - 1) / window)
    cut = at.select("*", F.explode(F.sequence(F.floor(F.col("at") / window), last)).alias("sequence_id"))
    begin = F.greatest("at", F.col("sequence_id") * window)
    length = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * window) - begin
    held = F.least(F.lit(window), F.col("all_tokens") - F.col("sequence_id") * window)
    return cut.select(
        F.col("id").alias(id_col),
        (begin - F.col("at")).alias("start"),
        length.alias("length"),
        F.expr(f"substring(ids, int(greatest(at, sequence_id * {window}) - at) * 4 + 1, int(least(at + n, (sequence_id + 1) * {window}) - greatest(at, sequence_id * {window})) * 4)").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (begin - F.col("sequence_id") * window).alias("offset"),
        held.alias("sequence_tokens"),
        F.when(F.bit_count(held) == 1, held).otherwise(F.lit(window).cast("long")).alias("padded_length"),
    )
