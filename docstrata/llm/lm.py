"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Blocks of documents become token numbers with the block's distinct words; training counts of words are summed over the
corpus and come back to the blocks, so the vocabulary may have any size. The most frequent words are dealt into classes
of equal size; all others form classes by the magnitude of their count. p(word | history) is p(class | history), log-linear
in the word before, the word before that (a skip feature) and both together, times p(word | class, history), log-linear
in the first two for frequent words and proportional to the count for all others. Feature values are hashed to rows of
weights. Tasks sum what each feature row should and does predict over all training tokens; a tree of sums brings these
gradients to one update for each family of features, and blocks are scored by gathers of weight rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from docstrata.llm.store import drop_table, materialize
from docstrata.llm.textbytes import hash_bytes, lower_ascii, mixed, row_blocks, text_bytes, word_spans

#: Frequent words with weights of their own, words in a class of them, classes of the other words.
HEAD, WIDTH, TIERS = 2048, 64, 32
#: Rows of weights for a family of features: on classes, and on words in classes.
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 14
#: What is added to observed and expected counts in an update.
DAMP = 1.0
#: Tasks whose gradients one task adds up.
FAN = 64
BLOCK_BYTES, CONTEXTS = 8 << 20, 1 << 14
END_HASH = np.uint64(0x6A09E667F3BCC908)
_LN10 = np.log(10.0)
FAMILIES = ("last", "skip", "both")


def classes(head: int = HEAD) -> int:
    return head // WIDTH + TIERS


def _blocks(docs: DataFrame) -> DataFrame:
    """Per block: its documents' ids, held_out and token numbers, and its distinct words' hashes with their counts in training."""
    key = docs.schema["id"].dataType
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(key)), StructField("held", ArrayType(BooleanType())), StructField("sizes", ArrayType(IntegerType())), StructField("tokens", BinaryType()), StructField("words", ArrayType(LongType())), StructField("counts", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, part, block = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                text = lower_ascii(data[offsets[i] : offsets[j]])
                starts, ends, first = word_spans(text, offsets[i : j + 1] - offsets[i])
                sizes = np.diff(first) + 1
                hashes = np.full(int(sizes.sum()), END_HASH, np.uint64)
                word = np.ones(len(hashes), bool)
                word[np.cumsum(sizes) - 1] = False
                hashes[word] = hash_bytes(text, starts, ends)
                words, tokens = np.unique(hashes, return_inverse=True)
                held = b.column(1).slice(i, j - i)
                counts = np.bincount(tokens, ~np.repeat(held.to_numpy(zero_copy_only=False).astype(bool), sizes), len(words)).astype(np.int64)
                lists = [b.column(0).slice(i, j - i), held, pa.array(sizes.astype(np.int32)), None, pa.array(words.view(np.int64)), pa.array(counts)]
                columns = [pa.array([(part << 32) + block])]
                for x in lists:
                    columns.append(pa.array([tokens.astype("<u4").tobytes()], pa.binary()) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
                yield from pa.table(columns, out.names).cast(out).to_batches()
                block += 1

    return docs.mapInArrow(run, schema)


class Model:
    """Counts of the corpus, the frequent words, and rows of weights by family, for classes and for words in classes."""

    def __init__(self, total: int, distinct: int, head: list[tuple[int, int]], tiers: dict[int, tuple[int, int]], size: int = HEAD):
        """``head``: (hash, count) of the most frequent words; ``tiers``: words and tokens of the others by the magnitude of their count."""
        self.total, self.distinct, self.size = total, distinct, size
        counts = np.zeros(size)
        counts[: len(head)] = [c for _, c in head]
        hashes = np.array([h for h, _ in head], np.int64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.tier_tokens = np.array([tiers.get(t, (0, 0))[1] for t in range(TIERS)], float)
        by_class = np.concatenate([counts.reshape(-1, WIDTH).sum(1), self.tier_tokens])
        by_class[size // WIDTH] = max(1.0, by_class[size // WIDTH])  # rare words: those of count 1, and all unseen ones
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(by_class / by_class.sum()), -1e9).astype(np.float32)
            self.word_bias = np.maximum(np.log(counts), -1e9).astype(np.float32).reshape(-1, WIDTH)
        self.on_class: list[np.ndarray] = []
        self.on_word: list[np.ndarray] = []

    def codes(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number (a frequent word's place, else that of its tier), and log10 of its share of its tier."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        tier = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), TIERS - 1)
        code = np.where(known, self.order[at] if len(self.order) else 0, self.size + tier)
        rare = 0.5 / self.tier_tokens[0] if self.tier_tokens[0] else 1.0
        share = np.where(counts == 0, 0.5 if self.tier_tokens[0] else 1.0, np.where(tier == 0, rare, counts / np.maximum(self.tier_tokens[tier], 1.0)))
        return code.astype(np.uint16), np.where(known, 0.0, np.log10(share))

    def rows(self, family: int, last: np.ndarray, skip: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """The row of each context in a family's weights, for classes, or for the words of the classes ``own``."""
        value = (last, skip, last * 65536 + skip)[family].astype(np.uint64)
        if own is None:
            return (mixed(value + np.uint64(1)) % np.uint64(CLASS_ROWS)).astype(np.int64)
        return (mixed((value + np.uint64(1)) * np.uint64(4096) + own.astype(np.uint64)) % np.uint64(WORD_ROWS)).astype(np.int64)

    def logits(self, last: np.ndarray, skip: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Logarithms of the normalised probabilities of all classes, or of the words of the classes ``own``, by context."""
        if own is None:
            out = np.broadcast_to(self.class_bias, (len(last), len(self.class_bias))).copy()
        else:
            out = self.word_bias[own]
        for family, table in enumerate(self.on_class if own is None else self.on_word):
            if table is not None:
                out += table[self.rows(family, last, skip, own)]
        out -= out.max(axis=1, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
        return out


def _contexts(sizes: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and the one before that; the mark ``size + TIERS`` before a document's first."""
    start = np.cumsum(sizes) - sizes
    last, skip = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    last[1:], skip[2:] = codes[:-1], codes[:-2]
    last[start] = skip[start] = size + TIERS
    second = start[sizes > 1] + 1
    skip[second] = size + TIERS
    return last, skip


def _batches(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + CONTEXTS)) for i in range(0, n, CONTEXTS))


def _keys(model: Model, last: np.ndarray, skip: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    key = last * 65536 + skip
    return key if own is None else key * 4096 + own


def _apart(key: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    classes_ = key % 4096 if own else None
    key = key // 4096 if own else key
    return key // 65536, key % 65536, classes_


def block_scores(model: Model, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """log10 probability of each document's tokens, less the shares of words in their tiers."""
    codes = codes.astype(np.int64)
    last, skip = _contexts(sizes, codes, model.size)
    head = codes < model.size
    own = np.where(head, codes // WIDTH, model.size // WIDTH + codes - model.size)
    found = np.zeros(len(codes))
    for pick, classes_, column in ((slice(None), None, own), (np.flatnonzero(head), own[head], codes[head] % WIDTH)):
        keys, inverse = np.unique(_keys(model, last[pick], skip[pick], classes_), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        upto = np.searchsorted(inverse[order], np.arange(len(keys) + 1))
        part = np.empty(len(inverse))
        for s in _batches(len(keys)):
            logs = model.logits(*_apart(keys[s], classes_ is not None))
            tokens = order[upto[s.start] : upto[s.stop]]
            part[tokens] = logs[inverse[tokens] - s.start, column[tokens]]
        found[pick] += part
    return np.add.reduceat(found, np.cumsum(sizes) - sizes) / _LN10 if len(sizes) else np.zeros(0)


def _expect(model: Model, family: int, last: np.ndarray, skip: np.ndarray, own: np.ndarray | None, out: np.ndarray) -> None:
    """Add to the rows of ``family`` what the model expects over all tokens; equal contexts are worked out once."""
    target = model.rows(family, last, skip, own)
    if family == 0:  # no feature yet: the history doesn't matter
        last, skip = np.zeros_like(last), np.zeros_like(skip)
    elif family == 1:
        skip = np.zeros_like(skip)
    keys, inverse = np.unique(_keys(model, last, skip, own), return_inverse=True)
    pairs, times = np.unique(inverse * len(out) + target, return_counts=True)
    context, row = np.divmod(pairs, len(out))
    upto = np.searchsorted(context, np.arange(len(keys) + 1))
    for s in _batches(len(keys)):
        p = np.exp(model.logits(*_apart(keys[s], own is not None)))
        at = slice(upto[s.start], upto[s.stop])
        order = np.argsort(row[at], kind="stable")
        rows = row[at][order]
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        for i in range(0, len(begins), 1024):  # few rows at a time: a context may have many pairs
            lo, hi = begins[i], begins[i + 1024] if i + 1024 < len(begins) else len(rows)
            some = order[lo:hi]
            sums = np.add.reduceat(p[context[at][some] - s.start] * times[at][some, None].astype(np.float32), begins[i : i + 1024] - lo, axis=0)
            out[rows[begins[i : i + 1024]]] += sums


def block_gradient(model: Model, family: int, sizes: np.ndarray, codes: np.ndarray, held: np.ndarray, sums: list[np.ndarray]) -> None:
    """Add observed and expected counts of a block's training tokens to ``sums`` (classes: 0, 1; words in classes: 2, 3)."""
    codes = codes.astype(np.int64)
    last, skip = _contexts(sizes, codes, model.size)
    train = np.repeat(~held, sizes)
    codes, last, skip = codes[train], last[train], skip[train]
    head = codes < model.size
    own = np.where(head, codes // WIDTH, model.size // WIDTH + codes - model.size)
    rows = model.rows(family, last, skip)
    sums[0] += np.bincount(rows * sums[0].shape[1] + own, minlength=sums[0].size).reshape(sums[0].shape)
    _expect(model, family, last, skip, None, sums[1])
    if family < 2:
        last, skip, own, member = last[head], skip[head], own[head], codes[head] % WIDTH
        rows = model.rows(family, last, skip, own)
        sums[2] += np.bincount(rows * WIDTH + member, minlength=sums[2].size).reshape(sums[2].shape)
        _expect(model, family, last, skip, own, sums[3])


_SLAB = 128  # rows of weights sent together


def _gradients(coded: DataFrame, model: Model, family: int) -> list[np.ndarray]:
    """Observed and expected counts over all training tokens: blocks in tasks, then sums of sums; rows without tokens aren't sent."""
    shapes = [(CLASS_ROWS, classes(model.size))] * 2 + ([(WORD_ROWS, WIDTH)] * 2 if family < 2 else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = [np.zeros(x, np.float64 if k % 2 == 0 else np.float32) for k, x in enumerate(shapes)]
        some = False
        for b in batches:
            for k in range(len(b)):
                some = True
                block_gradient(model, family, b.column(0)[k].values.to_numpy(), np.frombuffer(b.column(2)[k].as_buffer(), "<u2"), b.column(1)[k].values.to_numpy(zero_copy_only=False).astype(bool), sums)
        part = TaskContext.get().partitionId()
        for k in range(0, len(sums) if some else 0, 2):
            for i in range(0, len(sums[k]), _SLAB):
                both = np.stack([x[i : i + _SLAB].astype("<f4") for x in sums[k : k + 2]])
                if both[0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["part", "kind", "row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for part, kind, row, x in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3)):
                x = np.frombuffer(x.as_buffer(), "<f4").astype(float)
                held[part, kind, row] = held[part, kind, row] + x if (part, kind, row) in held else x
        for (part, kind, row), x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([row], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["part", "kind", "row", "sums"])

    schema = "part int, kind int, row int, sums binary"
    found = materialize(coded.select("sizes", "held", "codes").mapInArrow(run, schema), "gradients", "zstd")
    parts = (found.agg(F.max("part")).head()[0] or 0) + 1
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition("part", "kind", "row").mapInArrow(add, schema)
        parts = -(-parts // FAN)
        if parts == 1:
            break
    out = [np.zeros(x) for x in shapes]
    for r in found.toLocalIterator():  # the model's size, whatever the corpus
        both = np.frombuffer(r.sums, "<f4").reshape(2, -1, shapes[r.kind][1])
        out[r.kind][r.row : r.row + _SLAB], out[r.kind + 1][r.row : r.row + _SLAB] = both
    return out


def prepare(docs: DataFrame, head: int = HEAD) -> tuple[DataFrame, Model]:
    """Blocks of token numbers with their base scores, and the model without features. ``docs``: id, held, text."""
    blocks = materialize(_blocks(docs), "lm-blocks", "zstd")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = materialize(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts", "zstd")
    seen = counts.filter("c > 0")
    top = [(r.word, r.c) for r in seen.orderBy(F.col("c").desc(), "word").limit(head).collect()]
    magnitude = F.least(F.floor(F.log2("c")), F.lit(TIERS - 1)).cast("int")
    tiers = {r.t: [r.words, r.tokens] for r in seen.groupBy(magnitude.alias("t")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens")).collect()}
    total, distinct = sum(x[1] for x in tiers.values()), sum(x[0] for x in tiers.values())
    for _, c in top:
        t = tiers[min(int(np.log2(c)), TIERS - 1)]
        t[0], t[1] = t[0] - 1, t[1] - c
    model = Model(total, distinct, top, {t: tuple(x) for t, x in tiers.items()}, head)
    back = words.join(counts, "word").groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("back"))
    whole = blocks.join(back, "block").select("ids", "held", "sizes", "tokens", "words", "back")
    fields = {f.name: f for f in whole.schema.fields}
    schema = StructType([fields["ids"], fields["held"], fields["sizes"], StructField("codes", BinaryType()), StructField("known", ArrayType(LongType())), StructField("base", ArrayType(DoubleType())), StructField("tail", ArrayType(DoubleType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                one = b.slice(k, 1)
                sizes, tokens, hashes = one.column(2)[0].values.to_numpy(), np.frombuffer(one.column(3)[0].as_buffer(), "<u4"), one.column(4)[0].values.to_numpy()
                c = np.zeros(len(hashes), np.int64)
                back = one.column(5)[0].values
                c[back.field("at").to_numpy()] = back.field("c").to_numpy()
                codes, tail = model.codes(hashes, c)
                begins = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x[tokens], begins) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (total + distinct + 1)), tail)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in sums]
                yield pa.RecordBatch.from_arrays([*[one.column(x) for x in range(3)], pa.array([codes[tokens].astype("<u2").tobytes()], pa.binary()), *lists], schema.names)

    coded = materialize(whole.mapInArrow(code, schema), "lm-codes", "zstd")
    drop_table(blocks)
    drop_table(counts)
    return coded, model


def train(coded: DataFrame, model: Model, damp: float = DAMP) -> Model:
    """One update for each family of features by the gradient over all training tokens.

    Each weight moves by log((observed + damp) / (expected + damp)): zero where the gradient, observed less expected, is
    zero, of its sign elsewhere, and the full step to the optimum of a row whose contexts are alike.
    """
    for family in range(len(FAMILIES)):
        sums = _gradients(coded, model, family)
        steps = [np.log((sums[k] + damp) / (sums[k + 1] + damp)).astype(np.float32) for k in range(0, len(sums), 2)]
        model.on_class.append(steps[0])
        if len(steps) > 1:
            model.on_word.append(steps[1])
    return model


def score(docs: DataFrame, held_out: str, head: int = HEAD, damp: float = DAMP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows for which ``held_out`` (SQL) isn't true and score all.

    One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of the
    whole text. Tokens are the words with A-Z lowered, then one end, so a null or empty text has one. As in the base
    score, all words that training lacks are one outcome; it is a rare word, half of which class it takes. Nothing to
    train on gives scores of 0. Repeated ids and rows are scored each by its own text and counted each; other columns
    are left out. Words are told apart by 64-bit hashes.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    coded, model = prepare(d, head)
    train(coded, model, damp)
    key = docs.schema[id_col].dataType
    schema = StructType([StructField(id_col, key), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                ids, held, sizes, codes, known, base, tail = [b.column(x)[k] for x in range(7)]
                n = sizes.values.to_numpy()
                scores = block_scores(model, n, np.frombuffer(codes.as_buffer(), "<u2")) + tail.values.to_numpy()
                yield pa.RecordBatch.from_arrays([ids.values, held.values, pa.array(n.astype(np.int64)), known.values, pa.array(np.full(len(n), model.total)), base.values, pa.array(scores)], schema.names)

    return coded.mapInArrow(run, schema)
