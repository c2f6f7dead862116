"""Operators against brute force on small made-up documents, with nulls, empty and long texts, copies and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names operators might use themselves.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, part int, node long, label int, key string, words string, n_words int, bucket int, kept boolean, size int, _row int"


def corpus() -> list[tuple]:
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = sentence(60)
    texts: list = [None, "", " \n\t ", "one", "two words", "a\n\nb\n"]
    for k in range(30):
        texts.append("\n".join(sentence(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 6))))
    texts += [texts[10]] * 4 + [texts[12] + " " + shared, sentence(20) + " " + shared + "\n" + sentence(9), shared + shared]
    words = texts[15].split(" ")
    words[len(words) // 2] = "changed"
    texts += [" ".join(words), texts[20].replace("a", "b", 1), sentence(4000)]
    texts += ["\n".join([sentence(12)] * 3), " ".join([sentence(9)] * 4)]
    rnd.shuffle(texts)
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", None]), len(t or ""), 1, 2, 3, 4, 5, "k", "w", 6, 7, True, 8, 9) for i, t in enumerate(texts)]


ROWS = corpus()
TEXTS = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_substring_dedup(docs, none):
    from docstrata.llm.substrings import remove_repeats

    words = {i: WORD.findall(t) for i, t in TEXTS.items()}
    seen: dict = {}
    for i, w in words.items():
        for k in range(len(w) - 34):
            seen.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, k + j) for places in seen.values() if len(places) > 1 for i, k in places for j in range(35)}
    expected = {i: (len(w), sum((i, k) in gone for k in range(len(w))), " ".join(x for k, x in enumerate(w) if (i, k) not in gone)) for i, w in words.items()}
    got = remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == expected and len(got) == len(ROWS)
    for r in got:
        assert {k for s in r["removed"] for k in range(s["begin"], s["end"])} == {k for i, k in gone if i == r["doc_id"]}
    assert any(v[1] for v in expected.values()) and remove_repeats(none).count() == 0


def test_packed_keys():
    from docstrata.llm.substrings import packed, unpacked

    for keys in ([], [5], [0, 1, 2**64 - 1], sorted(random.Random(1).randrange(2**64) for _ in range(500))):
        assert unpacked(packed(np.array(keys, np.uint64))).tolist() == keys


def test_suffix_dedup(docs, none):
    from docstrata.llm.suffixes import remove_repeated_bytes

    seen: set = set()
    expected = {}
    for i in sorted(TEXTS):
        b = TEXTS[i].encode()
        hit = [b[k : k + 50] in seen for k in range(max(0, len(b) - 49))]
        gone = {k + j for k, h in enumerate(hit) if h for j in range(50)}
        seen |= {b[k : k + 50] for k in range(max(0, len(b) - 49))}
        expected[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), bytes(c for k, c in enumerate(b) if k not in gone))
    got = remove_repeated_bytes(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got} == expected
    assert any(v[1] for v in expected.values()) and remove_repeated_bytes(none).count() == 0


def _edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, x in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != x)))
        last = now
    return last[-1]


def test_line_dedup(docs, none):
    from docstrata.llm.lines import dedup_lines, edits_allowed

    where: dict = {}
    for i in sorted(TEXTS):
        for k, x in enumerate(TEXTS[i].split("\n")):
            if WORD.search(x):
                where.setdefault(x, []).append((i, k))
    lines = sorted(where, key=len)
    up, links = {x: x for x in lines}, dict.fromkeys(lines, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(lines)):
        most = int(edits_allowed(len(lines[a])))
        for b in range(a + 1, len(lines)):
            if most and len(lines[b]) - len(lines[a]) <= most and _edits(lines[a], lines[b]) <= most:
                links[lines[a]] += 1
                links[lines[b]] += 1
                up[find(lines[b])] = find(lines[a])
    first: dict = {}
    for x in lines:
        first[find(x)] = min(first.get(find(x), (10**9, 0)), min(where[x]))
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t in TEXTS.items():
        own = [(k, x) for k, x in enumerate(t.split("\n")) if x in where]
        gone = [k for k, x in own if first[find(x)] != (i, k)]
        r = got[i]
        assert (r["n_lines"], r["removed"], r["n_links"]) == (len(own), gone, sum(links[x] for _, x in own))
        assert r["kept_text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert r["label"] == 5 and r["source"] == dict((x[0], x[3]) for x in ROWS)[i]
    assert sum(links.values()) and dedup_lines(none).count() == 0


def test_banded_edits():
    from docstrata.llm.lines import banded_edits

    rnd = random.Random(3)
    for _ in range(400):
        a = [rnd.randrange(3) for _ in range(rnd.randrange(12))]
        b = [rnd.randrange(3) for _ in range(rnd.randrange(12))]
        for most in (0, 1, 2, 4):
            assert banded_edits(np.array(a), np.array(b), most) == min(_edits(a, b), most + 1)


def test_banded_edits_of_very_long_lines():
    """A band of 12,001 diagonals over 120,000 characters: known edits, and lines of nothing in common given up early."""
    import time

    from docstrata.llm.lines import banded_edits

    rng = np.random.default_rng(0)
    x, other = (rng.integers(97, 123, 120000).astype(np.uint32) for _ in range(2))
    y, at = x.copy(), np.sort(rng.choice(119000, 5000, replace=False))
    y[at] = 65
    began = time.time()
    assert banded_edits(x, np.delete(y, at[:300]), 6000) == 5000
    assert banded_edits(x, other, 6000) == 6001
    assert time.time() - began < 5


def test_near_dedup(docs, none):
    from docstrata.llm.neardup import near_duplicates

    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    shingles = {i: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if (w := WORD.findall(t)) else [] for i, t in TEXTS.items()}

    def share(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b, 1):
                now.append(last[j - 1] + 1 if x == y else max(last[j], now[-1]))
            last = now
        return last[-1] / (len(a) + len(b) - last[-1]) if a and b else 0.0

    ids = [i for i in sorted(TEXTS) if len(shingles[i]) < 1000]
    linked = [(i, j) for i in ids for j in ids if i < j and set(shingles[i]) & set(shingles[j]) and share(shingles[i], shingles[j]) >= 0.8]
    label = {i: i for i in TEXTS}
    for _ in range(5):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    assert got == label and len(linked) >= 7
    assert near_duplicates(none).count() == 0


def test_banded_lcs():
    from docstrata.llm.neardup import banded_lcs

    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(15))] for _ in range(2))
        last = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b, 1):
                now.append(last[j - 1] + 1 if x == y else max(last[j], now[-1]))
            last = now
        assert banded_lcs(a, b, 20) == last[-1]
        assert banded_lcs(a, b, 2) <= last[-1]


def test_mixing(docs, none):
    from docstrata.llm.mixing import mix

    got = mix(docs).collect()
    size = {i: len(WORD.findall(t)) for i, t in TEXTS.items()}
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(ROWS)
    totals: dict = {}
    for r in got:
        totals.setdefault(r["source"], []).append(r)
    weights = {"s1": 3, "s2": 1, None: 2}
    sizes = {s: sum(r["size"] for r in rows) for s, rows in totals.items()}
    budget, open_ = 1.5 * sum(sizes.values()), set(sizes)
    target = dict.fromkeys(sizes, 0.0)
    while True:
        left = budget - sum(2.0 * sizes[s] for s in sizes if s not in open_)
        over = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    for s in sizes:
        target[s] = left * weights[s] / sum(weights[x] for x in open_) if s in open_ else 2.0 * sizes[s]
    for s, rows in totals.items():
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= max(r["size"] for r in rows)
    assert {r["doc_id"]: r["taken"] for r in mix(docs).collect()} == {r["doc_id"]: r["taken"] for r in got}
    assert mix(none).count() == 0


def test_pivotal_keeps_expectation():
    from docstrata.llm.mixing import settle

    sizes, p = np.array([3, 5, 1, 0, 8]), np.full(5, 0.4)
    picked = np.array([settle(sizes, p.copy(), seed, True)[0] for seed in range(4000)])
    assert np.abs(picked.mean(0) - [0.4, 0.4, 0.4, 0, 0.4]).max() < 0.03
    assert (picked @ sizes).std() < 4


def test_packing(docs, none):
    import public_tokenizers
    from docstrata.llm.packing import pack
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = pack(docs, path).collect()
    by_doc: dict = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in TEXTS.items():
        whole = b"".join(bytes(r["ids"]) for r in by_doc[i])
        assert np.frombuffer(whole, "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert [r["start"] for r in by_doc[i]] == np.cumsum([0, *[r["length"] for r in by_doc[i]]])[:-1].tolist()
    filled: dict = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["padded_length"] == (r["sequence_tokens"] if r["sequence_tokens"].bit_count() == 1 else 2048)
    assert sorted(filled) == list(range(len(filled))) and all(v == 2048 for k, v in filled.items() if k < len(filled) - 1)
    crc = {(r["doc_id"], r["start"]): r["c"] for r in pack(docs, path).select("doc_id", "start", F.crc32("ids").alias("c")).collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(bytes(r["ids"])) for r in pieces)
    assert pack(none, path).count() == 0


def test_chunks_tokenize_alone():
    import public_tokenizers
    from docstrata.llm.packing import WordEncoder
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, tokenizer, rnd = WordEncoder(path), Tokenizer.from_file(path), random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "B1", " ", "  ", "\n", "é", " ", "　", "中", "'s", "<|endoftext|>", "\x1c", "\x85", "𝛼", ".", "\t"]) for _ in range(rnd.randrange(25)))
        data = np.frombuffer(t.encode(), np.uint8)
        assert encode(data, np.array([0, len(data)]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_quality_measures(docs, none):
    from docstrata.llm.quality import measure

    got = {r["doc_id"]: r for r in measure(docs).collect()}
    for i, t in TEXTS.items():
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        gone = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(w) < 1000 else set()
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(gone))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(gone) > 30 * len(w))
    assert measure(none).count() == 0


def test_risk_controlled_cutoffs(spark):
    from math import comb

    from docstrata.llm.quality import binomial_tail, calibrate, measure, verdict

    x = spark.createDataFrame([(0, 50), (2, 50), (40, 1000)], "x long, n long").select("x", "n", binomial_tail(F.col("x"), F.col("n"), 0.03).alias("p"))
    for r in x.collect():
        assert abs(r["p"] - sum(comb(r["n"], k) * 0.03**k * 0.97 ** (r["n"] - k) for k in range(r["x"] + 1))) < 1e-9
    rows = [(i, "en", "word " * 5 + " ".join(f"w{k}x{i}" for k in range(30)) + ("".join(f" #{k}%" for k in range(40)) if i % 10 == 0 else "")) for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(20000)], "doc_id long, quality int")
    m = measure(docs)
    out = verdict(m, calibrate(m, labels)).groupBy((F.col("doc_id") % 10 == 0).alias("bad")).agg(F.count_if("kept").alias("kept")).collect()
    assert {r["bad"]: r["kept"] for r in out} == {True: 0, False: 18000}
    few = verdict(m, calibrate(m, labels.limit(300))).groupBy((F.col("doc_id") % 10 == 0).alias("bad")).agg(F.count_if("kept").alias("kept")).collect()
    assert {r["bad"]: r["kept"] for r in few} == {True: 0, False: 18000}
    assert verdict(m, calibrate(m, labels.limit(0))).filter("kept").count() == 20000


def test_cutoffs_as_in_sql(spark):
    """Strata that certify some, all or no steps, one of them null, some good documents lost."""
    import duckdb

    from docstrata.llm.oracles import op5
    from docstrata.llm.quality import calibrate, measure, verdict

    rnd, rows, marks = random.Random(3), [], []
    for i in range(6000):
        lang = rnd.choices(["en", "de", None, "fr"], [60, 30, 9, 1])[0]
        good = rnd.random() < 0.8
        noise = rnd.choice([0, 0, 0, 1]) if good and lang != "de" else rnd.randint(0, 12)
        words = [f"w{rnd.randrange(500)}{'x' * rnd.randint(0, 9)}" for _ in range(40)] + ["#$%"] * noise
        rnd.shuffle(words)
        rows.append((i, lang, " ".join(words)))
        marks.append((i, None if i % 97 == 0 else int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    m = measure(docs)
    cutoffs = {r["stratum"] for r in calibrate(m, labels).collect()}
    got = {r["doc_id"]: r["kept"] for r in verdict(m, calibrate(m, labels)).select("doc_id", "kept").collect()}
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    db.register("labels", labels.toPandas())
    expected = {r[0]: r[1] for r in db.execute(f"SELECT doc_id, kept FROM ({op5()})").fetchall()}
    assert got == expected and cutoffs and not all(got.values()) and "fr" not in cutoffs


def test_vectors(spark):
    from docstrata.llm.vectors import near_vectors

    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = [*base, *(base[:10] + rng.normal(size=(10, 16)) * 0.25), *(base[3:4].repeat(5, 0)), *(base[5] + rng.normal(size=(30, 16)) * 0.3)]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] * 16, 1), (104, [float("inf")] * 16, 1), (105, [1.0], 1), (106, [2.0], 1), (107, [], 1)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")).collect()}
    m = np.array([np.float32(r[1]) for r in rows[: len(x)]], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    label = np.arange(len(x))
    for _ in range(10):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (100, 101, 102, 103, 104, 107)] == [(0, i) for i in (100, 101, 102, 103, 104, 107)]
    assert got[106]["component_id"] == 105 and got[106]["kept"] is False
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_size(spark):
    from docstrata.llm.vectors import near_vectors

    near = [1.0] * 7 + [1.5]
    rows = [(1, [1e200] * 8), (2, [1e200 * x for x in near]), (3, [1.0] * 8), (4, [1e-200] * 8), (5, [5e-324] * 8), (6, [-1e200] * 8), (7, [1e200, -1e200] * 4)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{k: (4, 1) for k in (1, 2, 3, 4, 5)}, 6: (0, 6), 7: (0, 7)}


def test_null_stratum_beside_an_empty_one(spark):
    """170 good labels are enough for one stratum, not for each of two."""
    from docstrata.llm.quality import calibrate

    columns = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    figures = lambda bad: (50, 250, 500 if bad else 0, 1, 0, 0, False)
    one = [(i, "", *figures(i >= 170)) for i in range(200)]
    two = one + [(1000 + i, None, *figures(i >= 170)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 1000 < 170)) for i in [*range(200), *range(1000, 1200)]], "doc_id long, quality int")
    count = lambda rows: calibrate(spark.createDataFrame(rows, f"doc_id long, lang string, {columns}"), labels).count()
    assert (count(one), count(two)) == (1, 0)


def test_vector_recall():
    from docstrata.llm.vectors import codes

    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(2000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = codes(a), codes(b)
    met = (x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)
    assert met.any(1).mean() > 0.99


def test_components(spark):
    from docstrata.llm.components import components

    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_warc_roundtrip(spark):
    import base64

    from docstrata.llm.warc import archive_roundtrip

    rows = [(i, f"https://www.h{i % 7}.example.com:80/p/{i % 30}?q={i % 3}#f", f"<p>é{i % 40}\r\n\r\nWARC/1.1\r\n\r\n</p>" * (i % 5), "x") for i in range(900)]
    rows += [(1000, None, None, "x"), (1001, "not a url", "", "x"), (1002, "http://a.b/\r\nX: y", "<p>last</p>", "x"), (1002, "http://a.b/", "<p>last</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    top: dict = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in archive_roundtrip(pages).collect())
    expected = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = top[h or ""] == i
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""], (b or b"") if first else None))
    assert [(*x[:5], x[5] or b"") for x in got] == sorted((*x[:5], x[5] or b"") for x in expected)
    assert archive_roundtrip(pages.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></li></ul></nav><div class="cookie-notice">We use cookies, a long text about cookies that goes on and on.</div>
{body}
<aside class="sidebar"><p>Side words here.</p></aside><section id="comments"><p>A reader says that this is a long comment, long enough to pass.</p></section>
<form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><br>", ""),
        ("plain", "plain"),
        (PAGE.format(body="<article><h1>Head</h1><p>First  &amp; long\n paragraph with <b>bold</b> words, enough of them.</p><p>Short.</p></article>"), "Head\nFirst & long paragraph with bold words, enough of them.\nShort."),
        (PAGE.format(body="<div class=content><h1>Head</h1><p>First long paragraph with many words, enough of them to count.<p>Short.<p>Another long paragraph with many words, enough of them.</div>"), "Head\nFirst long paragraph with many words, enough of them to count.\nShort.\nAnother long paragraph with many words, enough of them."),
    ],
)
def test_main_text(html, text):
    from docstrata.llm.html_text import main_text

    assert main_text(html) == text


def test_extract(spark):
    from docstrata.llm.html_text import extract

    pages = spark.createDataFrame([(1, "u", PAGE.format(body="<main><p>Some words of text stand here.</p></main>"), "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["url"]) for r in extract(pages).collect()) == [("", None), ("Some words of text stand here.", "u")]
    assert extract(pages.limit(0)).count() == 0


def test_shared_dir_is_the_clusters(spark):
    from docstrata.llm.store import materialize, shared_dir

    d = materialize(spark.range(5), "t")
    assert d.count() == 5 and d.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file:"))


def test_suffix_dedup_of_neighbouring_rows(spark):
    """Rows of one part whose last and first windows share their minimizer."""
    from docstrata.llm.suffixes import remove_repeated_bytes

    rnd = random.Random(8)
    texts = ["The quick brown fox jumps over the lazy dog, again."[:50]] * 2 + ["=" * 120] * 3
    texts += ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(100)]  # so that parts hold several rows
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeated_bytes(docs).collect()}
    assert got == {k: len(t) if t in texts[:k] else 0 for k, t in enumerate(texts)}


def test_main_text_in_named_wrappers():
    from docstrata.llm.html_text import main_text

    long = [f"Sentence {k} of the article says something of some length about its subject, and goes on for a while." for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in long)
    links = "<ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul>"
    for wrapper in ("class='layout has-sidebar'", "class='content no-sidebar'", "class='main-content widget'", "id='social-policy'", "class='banner'"):
        for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
            assert main_text(f"<html><body><div class='nav'>{links}</div><div {wrapper}>{inner}</div></body></html>").split("\n") == long, (wrapper, inner[:6])
    for name in ("ad", "ad-slot", "sidebar", "site-footer", "related-posts", "share-buttons", "cookie-banner", "comments-area", "post ad"):
        aside = f"<div class='{name}'><p>Something else that is not of the article but is as long as a line of it is, almost.</p></div>"
        assert main_text(f"<html><body>{links}<article>{body}{aside}</article></body></html>").split("\n") == long, name
        assert main_text(f"<html><body><div class='story'>{body}</div>{aside}</body></html>").split("\n") == long, name
    cards = "".join(f"<article><p>{x}</p></article>" for x in long)
    assert main_text(f"<html><body><main>{body}</main><div class='related-posts'>{cards}</div></body></html>").split("\n") == long


def test_line_dedup_of_long_lines(spark):
    """Against brute force: a changed word, or edits all over a line, up to and beyond what its length allows."""
    from docstrata.llm.lines import banded_edits, dedup_lines, edits_allowed

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    lines = []
    for length in (55, 59, 60, 61, 79, 80, 99, 119, 120, 198, 400):
        base = " ".join(word() for _ in range(length))[:length].rstrip().ljust(length, "z")
        words = base.split(" ")
        words[len(words) // 2] = "kkkkkkk"[: len(words[len(words) // 2])]
        lines += [base, " ".join(words)]
        most = int(edits_allowed(length))
        for many in (most - 1, most, most + 1):
            x = list(base)
            for k in range(many):  # evenly spread, so that as few segments as may be stay
                at = (2 * k + 1) * length // (2 * many)
                x[at] = rnd.choice(["", "q", x[at] + "q"])
            lines.append("".join(x))
    lines = list(dict.fromkeys(lines))
    links = dict.fromkeys(range(len(lines)), 0)
    for i, a in enumerate(lines):
        for j in range(i):
            most = int(edits_allowed(min(len(a), len(lines[j]))))
            d = _edits(a, lines[j]) if abs(len(a) - len(lines[j])) <= most else most + 1
            x, y = (np.array([ord(c) for c in z], np.uint32) for z in (a, lines[j]))
            assert banded_edits(x, y, most) == min(d, most + 1)
            links[i] += d <= most
            links[j] += d <= most
    got = {r["doc_id"]: r["n_links"] for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == links and sum(links.values()) > 40
    one = "The committee met on Tuesday in the old town hall and spoke for two hours about the bridge, the road and the school, before it was told that there was no money left for any of these plans this year."
    docs = spark.createDataFrame([(1, one), (2, one.replace("committee", "assembly"))], "doc_id long, text string")
    assert [r["n_removed"] for r in dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1]


def test_line_dedup_finds_every_pair_within_its_edits(spark):
    """Long lines with as many edits as they allow, spread, at one place, at the ends, and only insertions or deletions."""
    from docstrata.llm.lines import banded_edits, dedup_lines, edits_allowed

    rnd = random.Random(11)
    letters = "abcdefghij ß"
    lines: list[str] = []
    for length in [60, 61, 79, 80, 119, 190, 199, 200, 205, 210, 260, 379, 380, 395, 400, 402, 640, 1300, 2600]:
        base = "".join(rnd.choice(letters) for _ in range(length - 2)).join("xy")
        lines.append(base)
        for kind in range(6):
            most = edits_allowed(length) + (kind == 5)
            x, spots = list(base), sorted(rnd.sample(range(length), most), reverse=True)
            if kind == 1:
                spots = [length // 2] * most
            if kind == 2:
                spots = [k * length // (most + 1) for k in range(most, 0, -1)]
            for p in spots:
                what = 1 if kind == 3 else 2 if kind == 4 else rnd.randrange(3)
                x[p : p + (what != 1)] = [] if what == 2 else [rnd.choice("QRST")]
            lines.append("".join(x))
    coded = [np.array([ord(c) for c in x]) for x in lines]
    links = [0] * len(lines)
    for i, a in enumerate(coded):
        for j, b in enumerate(coded[:i]):
            most = edits_allowed(min(len(a), len(b)))
            if lines[i] != lines[j] and abs(len(a) - len(b)) <= most and banded_edits(a, b, most) <= most:
                links[i] += 1
                links[j] += 1
    got = {r["doc_id"]: r["n_links"] for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(lines))] == links and sum(links) > 100
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = [{r["doc_id"]: r["n_kept"] for r in dedup_lines(docs, count_links=x).collect()} for x in (True, False)]
    assert kept[0] == kept[1] and dedup_lines(docs, count_links=False).first()["n_links"] is None


def test_mixing_keeps_large_and_missing_ids(spark):
    from docstrata.llm.mixing import mix

    ids = [None, None, (1 << 53) + 1, (1 << 62) + 3, -5] * 4
    rows = [(i, "word " * (k % 7 + 1), "s") for k, i in enumerate(ids)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == sorted((i or 0, k % 7 + 1) for k, i in enumerate(ids))
    assert sum(r["doc_id"] is None for r in out) == 8 and {r["source_size"] for r in out} == {sum(k % 7 + 1 for k in range(20))}
    again = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    drawn = lambda x: sorted(((r["doc_id"] or 0, r["size"], r["copies"]) for r in x))
    assert drawn(out) == drawn(again)


def test_hot_tiles_bring_every_pair_together_and_join_hot_keys_alone(spark):
    from docstrata.llm.components import hot_tiles

    rows = [(0, k) for k in range(600)] + [(1 + k // 2, k) for k in range(600)]
    dealt = hot_tiles(spark.createDataFrame(rows, "key long, node long"), ["key"], "node", 100).collect()
    together: dict = {}
    for r in dealt:
        together.setdefault((r["key"], r["tile"]), set()).add(r["node"])
    assert max(map(len, together.values())) < 450
    met = {(a, b) for (key, _), x in together.items() if key == 0 for a in x for b in x if a < b}
    assert len(met) == 600 * 599 // 2
    assert all(sum(key == k for key, _ in together) == 1 for k in range(1, 301))


def test_long_lines_share_fewer_keys_by_chance_when_rare_grams_come_first():
    """Lines of common words with one in six of their own: keys that two lines share."""
    import random

    import pyarrow as pa

    from docstrata.llm.lines import gram_classes, long_keys
    from docstrata.llm.textbytes import RangeHash, mixed

    rnd = random.Random(11)
    common = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
    lines = [" ".join("".join(rnd.choice("mnopqrstuvwx") for _ in range(6)) if k % 3 == 2 else rnd.choice(common) for k in range(30)) for _ in range(300)]
    classes = next(gram_classes(iter([pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)])], ["text"])])))
    rare = np.frombuffer(classes.column(0)[0].as_py(), np.uint8)
    chars = np.frombuffer("\n".join(lines).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(x) + 1 for x in lines]) - 1
    starts, shared = ends - [len(x) for x in lines], []
    for order in (None, rare):
        index, probes = long_keys(RangeHash(mixed(chars.astype(np.uint64))), starts, ends, order)
        shared.append(int(np.isin(probes["key"], index["key"]).sum()))
    assert shared[1] < 0.7 * shared[0]


def test_text_of_line_dedup_is_shuffled_compressed_and_pairs_in_rounds(spark, tmp_path, monkeypatch):
    """Texts travel compressed, a candidate of a long line is a few numbers, and pairs are verified some at a time."""
    import pyarrow as pa

    import docstrata.llm.lines as L
    from docstrata.llm.textbytes import text_bytes, unzipped, zipped

    texts = pa.array(["ä" * 900, None, "", "one\ntwo"])
    for a, b in zip(unzipped(zipped(texts)), text_bytes(texts)):
        assert (a == b).all()
    assert len(zipped(texts)[0].as_py()) < 60

    rnd = random.Random(21)
    base = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(12)]
    rows = [(k, base[k % 12][: 20 * (k // 12)] + "q" + base[k % 12][20 * (k // 12) + 1 :]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name, *codec: tables.append((name, write(df, name, *codec))) or tables[-1][1])
    monkeypatch.setattr(L, "drop_table", lambda df: None)
    monkeypatch.setattr(L, "ROUND_PAIRS", 100)
    got = {r["doc_id"]: r for r in L.dedup_lines(docs).collect()}
    assert all(r["n_links"] == 9 for r in got.values())
    assert sorted(k for k, r in got.items() if r["n_kept"]) == list(range(12))
    held = dict(tables)
    assert sum(name == "line-links" for name, _ in tables) > 2
    assert held["line-candidates"].filter("at >= 0").count() and not held["line-candidates"].filter("at >= 0 AND chars IS NOT NULL").count()


def test_packed_keys_of_uneven_steps_take_few_bytes():
    from docstrata.llm.substrings import packed, unpacked

    rng = np.random.default_rng(2)
    for n, most in ((1, 5), (2, 2**64 - 1), (500, 3), (5000, 2**24), (100_000, 2**33)):
        keys = np.sort(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
        assert (unpacked(packed(keys)) == keys).all()
    assert len(packed(keys)) < 2.4 * len(keys)  # steps of one width take three bytes
    keys = np.append(keys, np.uint64(2**63))
    assert (unpacked(packed(keys)) == keys).all()


def test_pairs_compared_side_by_side_differ_as_one_by_one():
    from docstrata.llm.lines import banded_edits, edits_allowed, pairs_within

    rng = np.random.default_rng(4)
    x, y = [], []
    while len(x) < 400:
        a = rng.integers(97, 97 + rng.integers(2, 20), int(rng.integers(60, 640))).astype(np.uint32)
        b, most = a.tolist(), int(edits_allowed(len(a)))
        for _ in range(int(rng.integers(most, 2 * most + 3))):
            p = int(rng.integers(0, len(b)))
            b[p : p + int(rng.integers(0, 2))] = rng.integers(97, 9000, int(rng.integers(0, 2))).tolist()
        a, b = sorted((a, np.array(b, np.uint32)), key=len)
        if len(b) - len(a) <= edits_allowed(len(a)):
            x.append(a)
            y.append(b)
    most = edits_allowed(np.array([len(a) for a in x]))
    expected = [banded_edits(a, b, int(k)) <= k for a, b, k in zip(x, y, most)]
    assert 50 < sum(expected) < 350
    assert pairs_within(x, y, most).tolist() == expected
