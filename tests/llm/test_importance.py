"""Importance resampling against a direct computation: n-grams, nulls, ties, long texts, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, block int, range int, span int, ids int, words int, bucket int, s int, t int, weight int, rank int"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words_of(text) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def corpus() -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcÉéß0Z") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", "-", "\n"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "!?"), (503, "the " * 30000 + text(5)), (504, "w" * 5000), (None, text(40)), (3, text(40)), (7, docs[7][1]), (7, docs[7][1])]
    target = [(k, text(30)) for k in range(9)] + [(10, None)]
    return [(*d, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for d in docs], target


def direct(docs, target, n, buckets, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    held = [(d[0], words_of(d[1])) for d in docs]
    s = Counter(bucket(g) for _, w in held for g in grams(w, n))
    t = Counter(bucket(g) for _, x in target for g in grams(words_of(x), n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for i, w in held:
        g = grams(w, n)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    places = {}
    for k, r in enumerate(drawn):
        places.setdefault(r, []).append(k + 1)
    return sorted([(*r, places[r].pop() if places.get(r) else None) for r in rows], key=repr)


def test_matches_direct(spark):
    from docstrata.llm.importance import resample

    docs, target = corpus()
    d, t = spark.createDataFrame(docs, SCHEMA).repartition(11), spark.createDataFrame(target, "item_id long, text string")
    for n, buckets, percent in ((1, 10000, 10), (2, 97, 50)):
        found = resample(d, t, percent=percent, max_n=n, buckets=buckets).collect()
        assert sorted([tuple(r) for r in found], key=repr) == direct(docs, target, n, buckets, percent)


def test_empty_tables(spark):
    from docstrata.llm.importance import resample

    docs, target = corpus()
    t = spark.createDataFrame(target, "item_id long, text string")
    assert resample(spark.createDataFrame([], SCHEMA), t).count() == 0
    found = resample(spark.createDataFrame(docs[:30], SCHEMA), t.limit(0)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == direct(docs[:30], [], 1, 10000, 10)


def test_crc_of_ranges():
    from docstrata.llm.textbytes import crc32_ranges

    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    starts = rnd.integers(0, 4000, 300)
    ends = starts + np.append(rnd.integers(0, 200, 299), 0)
    assert crc32_ranges(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(crc32_ranges(data, starts[:0], ends[:0])) == 0
