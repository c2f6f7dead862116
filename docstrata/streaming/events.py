"""Operators on event tables and streams (ts, user_id, event_type, value): windows, sessions, timelines, caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Events with a watermark if they may come late; a watermark needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; a stream needs ``late``, the time it waits for late rows."""
    d = _timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = d.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """A user's sessions: events less than ``gap`` apart."""
    d = _timed(events, late)
    out = d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def timeline(events: DataFrame, key: str, order: list[Column], begins: Column, ends: Column) -> DataFrame:
    """Steps of each key: an event that begins one, closed by the next one that ends or begins one; else open."""
    w = Window.partitionBy(key).orderBy(*order)
    d = events.filter(begins | ends).withColumn("closed", F.lead("ts").over(w)).withColumn("done", F.coalesce(F.lead(ends).over(w), F.lit(False)))
    return d.filter(begins).withColumn("seconds", F.timestamp_diff("SECOND", F.col("ts"), F.col("closed")))


def throttled(events: DataFrame, key: str, seconds: Column, least: float) -> DataFrame:
    """(key, seconds) of the events kept: each key's first, and each one ``least`` or more after the last kept.

    A key's events pass by in order of time, so a task holds one batch and the last time kept, however many events a
    key has. Events without a time take no part; those without a key are one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for b in batches:
            keys, t = b.column(0), b.column(1).to_numpy()
            coded = keys.dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes)) if len(codes) else []
            kept = []
            for i, j in zip(starts[:-1], starts[1:]):
                value = coded.dictionary[int(codes[i])].as_py()
                if last is None or value != now:
                    now, last = value, -np.inf
                at = i + np.searchsorted(t[i:j], last + least)
                while at < j:
                    kept.append(at)
                    last = t[at]
                    at += np.searchsorted(t[at:j], last + least)
            yield b.take(pa.array(kept, pa.int64()))

    d = events.select(key, seconds.cast("double").alias("seconds")).filter("seconds is not null")
    return d.repartition(key).sortWithinPartitions(key, "seconds").mapInArrow(run, d.schema)


def cache_entries(events: DataFrame, key: list[str], now: str, minutes: int, most: int) -> DataFrame:
    """Entries still cached at ``now``: last used within ``minutes``, the ``most`` latest."""
    d = events.filter(F.col("ts") <= F.to_timestamp_ntz(F.lit(now))).groupBy(*key).agg(F.max("ts").alias("used"))
    d = d.filter(F.col("used") >= F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {minutes} MINUTES"))
    return d.orderBy(F.desc("used"), *key).limit(most)  # the size of the cache


def cache_hits(events: DataFrame, key: list[str], order: list[Column], minutes: int) -> DataFrame:
    """Lookups, hits and hit rate per event type: a hit repeats a key within ``minutes`` of its last use."""
    w = Window.partitionBy(*key).orderBy(*order)
    hit = F.coalesce(F.col("ts") <= F.lag("ts").over(w) + F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))
    d = events.withColumn("hit", hit).groupBy("event_type").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"))
    return d.withColumn("rate", F.round(F.try_divide("hits", "lookups"), 3))
