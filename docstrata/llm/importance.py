"""Importance resampling towards a target corpus by hashed n-gram features.

Blocks of documents become inverted postings: ascending (bucket, document) with counts, cut by ranges of buckets and
packed. Both corpora's totals of each bucket are gathered beforehand, so a range's postings go, with the totals of its
buckets, to groups of one range and a few partitions of the input: a bucket that every document holds is spread over
such groups. A group works out its buckets' gains and sends one sum a document and range; the sums meet again by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from docstrata.llm.ranks import ranked
from docstrata.llm.store import drop_table, materialize
from docstrata.llm.substrings import packed, unpacked
from docstrata.llm.textbytes import crc32_ranges, gather, lower_ascii, row_blocks, text_bytes, word_spans

BUCKETS, MAX_N, PERCENT, MIN_WORDS, SEED = 10000, 1, 10, 20, 2024
RANGES = 16
#: Partitions of the input whose postings of one range form a group.
SPAN = 8
BLOCK_BYTES = 4 << 20
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(data: np.ndarray, offsets: np.ndarray, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the words of each row: runs of 1 to ``max_n`` words of one row."""
    starts, ends, first = word_spans(data, offsets, _OUTSIDE)
    sizes = ends - starts
    if max_n > 1:  # words one space apart, so that a run of them is a range of bytes
        begins = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
        joined[gather(np.arange(len(joined)), begins, sizes)] = gather(data, starts, sizes)
        data, starts, ends = joined, begins, begins + sizes
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    found, rows = [], []
    for n in range(1, max_n + 1):
        runs = gather(np.arange(len(starts)), first[:-1], np.maximum(words - n + 1, 0))
        found.append(crc32_ranges(data, starts[runs], ends[runs + n - 1]) % np.uint32(buckets))
        rows.append(row[runs])
    return np.concatenate(found), np.concatenate(rows), words


def postings(texts: DataFrame, max_n: int, buckets: int, ranges: int) -> DataFrame:
    """Packed postings of the columns id and text: a row for each block and range of buckets, and one of range -1 with the block's ids."""
    width = -(-buckets // ranges)
    key = texts.schema["id"].dataType
    schema = StructType([StructField("span", IntegerType()), StructField("block", LongType()), StructField("range", IntegerType()), StructField("rows", IntegerType()), StructField("keys", BinaryType()), StructField("counts", BinaryType()), StructField("ids", ArrayType(key)), StructField("words", ArrayType(LongType())), StructField("features", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, part, block = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                bucket, row, words = features(lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], max_n, buckets)
                n = j - i
                number = (part << 32) + block
                keys, counts = np.unique(bucket.astype(np.uint64) * np.uint64(n) + row.astype(np.uint64), return_counts=True)
                wide = "<u1" if not len(counts) or counts.max() < 256 else "<u4"
                cuts = np.searchsorted(keys, np.arange(ranges + 1).astype(np.uint64) * np.uint64(width * n))
                found = [{"span": part // SPAN, "block": number, "range": k, "rows": n, "keys": packed(keys[x:y]), "counts": counts[x:y].astype(wide).tobytes()} for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                if found:
                    yield from pa.Table.from_pylist(found, out).to_batches()
                held = [pa.array([x]) for x in (part // SPAN, number, -1, n)] + [pa.nulls(1), pa.nulls(1)]
                held += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (b.column(0).slice(i, n), pa.array(words), pa.array(np.bincount(row, minlength=n)))]
                yield from pa.table(held, out.names).cast(out).to_batches()
                block += 1

    return texts.mapInArrow(run, schema)


def _counted(keys: memoryview, counts: memoryview) -> tuple[np.ndarray, np.ndarray]:
    found = unpacked(keys)
    return found, np.frombuffer(counts, "<u1" if len(counts) == len(found) else "<u4").astype(np.int64)


def bucket_totals(found: DataFrame, buckets: int, name: str) -> DataFrame:
    """The features of each bucket, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for n, keys, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                at, times = _counted(keys.as_buffer(), counts.as_buffer())
                sums += np.bincount((at // np.uint64(n)).astype(np.int64), times, buckets).astype(np.int64)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], ["bucket", name])

    return found.filter("range >= 0").select("rows", "keys", "counts").mapInArrow(run, f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """1000 times the logarithm of how much likelier the target's features fall in each bucket, floored; one is added to each count."""
    return np.floor(1000 * np.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_features and weight, the floored mean of its features' gains (0 without any)."""
    width = -(-buckets // ranges)
    key = docs.schema[id_col].dataType
    found = materialize(postings(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), max_n, buckets, ranges), "postings", "zstd")
    other = postings(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), max_n, buckets, ranges)
    both = bucket_totals(found, buckets, "s").join(bucket_totals(other, buckets, "t"), "bucket", "full").fillna(0, ["s", "t"])
    # at most one row a bucket
    whole = Window.partitionBy()
    both = both.select("bucket", "s", "t", F.sum("s").over(whole).alias("all_s"), F.sum("t").over(whole).alias("all_t"))
    by_range = both.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.collect_list("bucket").alias("bucket"), F.collect_list("s").alias("s"), F.collect_list("t").alias("t"), F.first("all_s").alias("all_s"), F.first("all_t").alias("all_t"))
    lists = found.filter("range >= 0").select("span", "range", "block", "rows", "keys", "counts")
    sides = lists.select(F.col("span").alias("of_span"), "range").distinct().join(by_range, "range").withColumnRenamed("range", "of_range")

    def contribute(ours: pa.Table, totals: pa.Table) -> pa.Table:
        first = totals.column("of_range")[0].as_py() * width
        s, t = np.zeros(width, np.int64), np.zeros(width, np.int64)
        at = totals.column("bucket")[0].values.to_numpy() - first
        s[at], t[at] = totals.column("s")[0].values.to_numpy(), totals.column("t")[0].values.to_numpy()
        gain = gains(s, t, totals.column("all_s")[0].as_py(), totals.column("all_t")[0].as_py(), buckets)
        sums = []
        for n, keys, counts in zip(ours.column("rows").to_pylist(), ours.column("keys"), ours.column("counts")):
            places, times = _counted(keys.as_buffer(), counts.as_buffer())
            bucket, row = np.divmod(places.astype(np.int64), n)
            out = np.zeros(n, np.int64)
            order = np.argsort(row, kind="stable")
            begins = np.flatnonzero(np.diff(row[order], prepend=-1))
            out[row[order][begins]] = np.add.reduceat((gain[bucket - first] * times)[order], begins)
            sums.append(out.astype("<i8").tobytes())
        return pa.table({"block": ours.column("block"), "sums": pa.array(sums, pa.binary())})

    def reduce(ours: pa.Table, parts: pa.Table) -> pa.Table:
        ids, words, n = ours.column("ids")[0].values, ours.column("words")[0].values, ours.column("features")[0].values.to_numpy()
        total = np.zeros(len(n), np.int64)
        for x in parts.column("sums"):
            total += np.frombuffer(x.as_buffer(), "<i8")
        return pa.table({"id": ids, "n_words": words, "n_features": n, "weight": np.floor_divide(total, np.maximum(n, 1))})

    sums = lists.groupBy("span", "range").cogroup(sides.groupBy("of_span", "of_range")).applyInArrow(contribute, "block long, sums binary")
    schema = StructType([StructField("id", key), StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("weight", LongType())])
    blocks = found.filter("range = -1").select("block", "ids", "words", "features")
    out = materialize(blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(reduce, schema), "weights", "zstd")
    drop_table(found)
    return out.withColumnRenamed("id", id_col)


def drawn_score(doc_id: Column, weight: Column, seed: int) -> Column:
    """The weight and a Gumbel draw of the id, in thousandths: the highest scores are a sample without replacement."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, max_n: int = MAX_N, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents with at least ``min_words`` words towards the texts of ``target``.

    One row a document: id, n_words, n_features, weight, score and rank (1, 2, 3... of the drawn ones from the highest
    score, ties to the smaller id, null last; undrawn null). Features are runs of 1 to ``max_n`` words of a-z, digits
    and characters beyond ASCII, with A-Z lowered and repeats counted. A null or empty text has none and weight 0; an
    empty target gives gains by the documents alone; rows that share an id are each weighed by their own text and have
    the same draw; a null id draws as an empty one. Texts are read whole; other columns are left out.
    """
    found = weights(docs, target, max_n, buckets, id_col=id_col, text_col=text_col)
    found = found.withColumn("score", drawn_score(F.col(id_col), F.col("weight"), seed)).withColumn("_fit", F.col("n_words") >= min_words)
    placed = ranked(found, ["_fit"], [F.col("score").desc(), F.col(id_col).asc_nulls_last()], "resample-ranks")
    rank = F.when(F.col("_fit") & (F.col("_index") < F.floor(percent * F.col("_total") / 100)), F.col("_index") + 1)
    return placed.select(id_col, "n_words", "n_features", "weight", "score", rank.alias("rank"))
