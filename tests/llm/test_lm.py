"""Language-model scores: counts and base scores directly, a proper distribution, gradients token by token, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, held int, block int, ids int, tokens int, words int, counts int, c int, at int, part int, row int"
HELD = "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"


def corpus() -> list[tuple]:
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeéßX") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    after = {w: rnd.sample(vocab, 4) for w in vocab}

    def text(n):
        out = [rnd.choice(vocab)]
        while len(out) < n:
            out.append(rnd.choice(after.get(out[-1], vocab)) if rnd.random() < 0.9 else "new" + str(rnd.random()))
        return " ".join(out)

    docs = [(i, text(rnd.randint(1, 120))) for i in range(260)]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, text(30000)), (1004, "long" * 9000), (None, text(50)), (5, docs[5][1]), (5, docs[5][1]), (5, text(9))]
    return [(*d, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for d in docs]


def tokens_of(text) -> list:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def held_out(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark):
    from docstrata.llm.lm import score

    return score(spark.createDataFrame(corpus(), SCHEMA).repartition(3), HELD, head=128).collect()


def test_counts_and_base_scores(scored):
    c = Counter(t for r in corpus() if not held_out(r[0]) for t in tokens_of(r[1]))
    n, v = sum(c.values()), len(c)
    expected = []
    for r in corpus():
        ts = tokens_of(r[1])
        expected.append((r[0], held_out(r[0]), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 4)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_held_out_texts_score_better(scored):
    rows = [r for r in scored if r.held_out]
    assert sum(r.score for r in rows) > 0.85 * sum(r.base_score for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)


def small_model(spark):
    from docstrata.llm import lm

    d = spark.createDataFrame([r[:2] for r in corpus()[:60]], "id long, text string").selectExpr("id", "id % 7 = 2 as held", "text")
    coded, model = lm.prepare(d, 128)
    return coded, lm.train(coded, model)


def test_model_is_a_distribution_and_scores_token_by_token(spark):
    from docstrata.llm import lm

    coded, model = small_model(spark)
    train = Counter(t for r in corpus()[:60] if r[0] % 7 != 2 for t in tokens_of(r[1]))
    counts = np.array([*train.values(), 0])
    hashes = np.array([h for h in model.hashes.tolist()] + list(range(len(counts) - 1 - len(model.hashes))) + [-1], np.int64)
    by_size = np.sort(counts[:-1])[::-1]
    model_counts = np.append(np.concatenate([np.exp(model.word_bias.ravel().astype(float))[model.order].round(), by_size[len(model.hashes) :]]), 0)
    codes, tail = model.codes(hashes, model_counts.astype(np.int64))
    for last, skip in ((0, 5), (model.size + lm.TIERS, model.size + lm.TIERS), (3, 129)):
        a, b = np.array([last]), np.array([skip])
        on_class = np.exp(model.logits(a, b)[0].astype(float))
        total = 0.0
        for code, share in zip(codes.astype(int), tail):
            own = code // lm.WIDTH if code < model.size else model.size // lm.WIDTH + code - model.size
            inside = np.exp(float(model.logits(a, b, np.array([own]))[0, code % lm.WIDTH])) if code < model.size else 10**share
            total += on_class[own] * inside
        assert abs(total - sum(on_class[k] for k in {*range(model.size // lm.WIDTH), *(model.size // lm.WIDTH + int(c) - model.size for c in codes if c >= model.size)})) < 1e-4
        assert abs(on_class.sum() - 1) < 1e-5
    row = coded.head()
    sizes, numbers = np.array(row.sizes), np.frombuffer(row.codes, "<u2")
    at, expected = 0, []
    for n in sizes:
        mark, logs = model.size + lm.TIERS, 0.0
        history = [mark, mark]
        for code in numbers[at : at + n].astype(int):
            a, b = np.array([history[-1]]), np.array([history[-2]])
            own = code // lm.WIDTH if code < model.size else model.size // lm.WIDTH + code - model.size
            logs += model.logits(a, b)[0, own] + (model.logits(a, b, np.array([own]))[0, code % lm.WIDTH] if code < model.size else 0.0)
            history.append(code)
        expected.append(logs / math.log(10))
        at += n
    assert np.allclose(lm.block_scores(model, sizes, numbers), expected, atol=1e-2)


def test_gradient_is_the_sum_over_tokens(spark):
    from docstrata.llm import lm

    coded, model = small_model(spark)
    row = coded.head()
    sizes, numbers, held = np.array(row.sizes)[:8], np.frombuffer(row.codes, "<u2"), np.array(row.held)[:8]
    numbers = numbers[: sizes.sum()]
    for family in range(3):
        part = lm.Model.__new__(lm.Model)
        part.__dict__ = {**model.__dict__, "on_class": model.on_class[:family], "on_word": model.on_word[:family]}
        shapes = [(lm.CLASS_ROWS, lm.classes(model.size))] * 2 + [(lm.WORD_ROWS, lm.WIDTH)] * 2
        sums, expected = [np.zeros(x) for x in shapes], [np.zeros(x) for x in shapes]
        lm.block_gradient(part, family, sizes, numbers, held, sums)
        last, skip = lm._contexts(sizes, numbers.astype(np.int64), model.size)
        for code, a, b, out in zip(numbers.astype(int), last, skip, np.repeat(held, sizes)):
            if out:
                continue
            a, b = np.array([a]), np.array([b])
            own = code // lm.WIDTH if code < model.size else model.size // lm.WIDTH + code - model.size
            r = part.rows(family, a, b)[0]
            expected[0][r, own] += 1
            expected[1][r] += np.exp(part.logits(a, b)[0])
            if code < model.size and family < 2:
                o = np.array([own])
                r = part.rows(family, a, b, o)[0]
                expected[2][r, code % lm.WIDTH] += 1
                expected[3][r] += np.exp(part.logits(a, b, o)[0])
        assert all(np.allclose(x, y, atol=1e-3) for x, y in zip(sums, expected))


def test_nothing_to_train_on(spark):
    from docstrata.llm.lm import score

    assert score(spark.createDataFrame([], SCHEMA), HELD).count() == 0
    rows = score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), "true").collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
