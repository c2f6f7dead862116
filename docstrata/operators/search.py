"""Vector search: blocked cosine top-k, quota recall, and selection with caps and guaranteed slots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a block, and queries of a block whose similarities are held at once (32 MB).
QUERY_BLOCK, CORPUS_BLOCK, ROWS_AT_ONCE = 1024, 32768, 128
#: Size of the candidate pool.
BUDGET_FACTOR, BUDGET_MIN, BUDGET_MAX = 3, 48, 80


def budget(top_k: int) -> int:
    """Candidates to recall for ``top_k`` results."""
    return max(BUDGET_MIN, min(BUDGET_MAX, top_k * BUDGET_FACTOR))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; norms count as 1e-8 at least."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    floor = F.lit(1e-8)
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), floor) * F.greatest(F.sqrt(dot(b, b)), floor))


def _first(sims: np.ndarray, among: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``most`` greatest values in the columns ``among``; of equal ones, those of smaller ids."""
    s = sims[:, among]
    least = np.partition(s, -most, axis=1)[:, -most:].min(axis=1) if most < len(among) else np.full(len(s), -np.inf)
    rows, at = np.nonzero(s >= least[:, None])
    columns = among[at]
    order = np.lexsort((ids[columns], -s[rows, at], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < most], columns[place < most]


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length in double precision, divided by their norms; null components are NaN."""
    v = vectors.combine_chunks()
    if pc.count_distinct(pc.list_value_length(v)).as_py() > 1:
        raise ValueError("vectors differ in length")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-8)[:, None]


def nearest(queries: DataFrame, corpus: DataFrame, most: int, group: str | None = None, digits: int = 6) -> DataFrame:
    """For each query, the ``most`` nearest rows of the corpus overall, and of each group if one is named.

    queries: qid, qvec; corpus: id, vec and the group column. Gives qid, id, group, sim (rounded), place (rank in the
    group, or overall). Blocks of queries meet blocks of the corpus; a pair of blocks is one group of rows and leaves
    at most ``most`` rows for each query and group, so what is shuffled grows with queries times blocks, not with all
    pairs, and a task holds no more than one pair of blocks. Ties go to the smaller id. Rows without a vector or an id take no part.
    """
    queries, corpus = queries.dropna(subset=["qid", "qvec"]), corpus.dropna(subset=["id", "vec", *([group] if group else [])])
    kept = [group] if group else []
    kind = dict(corpus.dtypes)
    # every pair of a query block and a corpus block is one group of rows: a task holds one pair at a time
    n_q, n_b = -(-queries.count() // QUERY_BLOCK), -(-corpus.count() // CORPUS_BLOCK)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    q = queries.select("qid", "qvec", own("qid", n_q).alias("_q")).withColumn("_b", every(n_b))
    c = corpus.select("id", "vec", *kept, own("id", n_b).alias("_b")).withColumn("_q", every(n_q))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.slice(0, 0)
        x, y, ids = _unit(left["qvec"]), _unit(right["vec"]), right["id"].to_numpy()
        groups = right[group].to_numpy() if group else np.zeros(len(ids), int)
        members = [np.flatnonzero(groups == g) for g in np.unique(groups)]
        found = []
        for k in range(0, len(x), ROWS_AT_ONCE):
            sims = np.round(x[k : k + ROWS_AT_ONCE] @ y.T, digits)
            for among in members:
                rows, columns = _first(sims, among, ids, most)
                picked = right.select(["id", *kept]).take(pa.array(columns))
                found.append(picked.add_column(0, "qid", left["qid"].take(pa.array(rows + k))).append_column("sim", pa.array(sims[rows, columns])))
        return pa.concat_tables(found)

    schema = f"qid {dict(queries.dtypes)['qid']}, id {kind['id']}, " + "".join(f"{c} {kind[c]}, " for c in kept) + "sim double"
    out = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    pairs = q.groupBy("_q", "_b").cogroup(c.groupBy("_q", "_b")).applyInArrow(run, schema)
    order = Window.partitionBy("qid", *kept).orderBy(F.col("sim").desc(), "id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).withColumn("place", F.col("place").cast("long"))


def quota_recall(queries: DataFrame, corpus: DataFrame, group: str, quota: Column, most_quota: int, pool: int) -> DataFrame:
    """Candidates of each query: every group's first rows up to its quota, filled to ``pool`` by similarity.

    The fill never drops a row that a quota picked, so the quotas' union may exceed the pool.
    """
    found = nearest(queries, corpus, max(most_quota, pool), group).withColumn("picked", F.col("place") <= quota)
    order = Window.partitionBy("qid").orderBy(F.col("picked").desc(), F.col("sim").desc(), "id")
    found = found.withColumn("fill", F.row_number().over(order))
    return found.filter(F.col("picked") | (F.col("fill") <= pool)).drop("fill", "place")


def selected(candidates: DataFrame, k: int, authority_slots: int = 2, cap_authority: int = 2, cap_other: int = 3, floor: float = 0.2, gap: float = 0.25) -> DataFrame:
    """The ``k`` rows of each query that are cited, in the order in which they are picked.

    candidates: qid, id, score, eff (the score with bonus and penalty), authority (boolean), dkey. First authority rows
    whose score isn't below max(floor, best eff - gap), in order of eff, up to ``authority_slots``; then all rows by
    eff; no document gives more than its cap. If rows are lacking, the cap is lifted. Each phase is a ranked frame.
    """
    c = candidates.withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = Window.partitionBy("qid")
    c = c.withColumn("line", F.greatest(F.lit(floor), F.max("eff").over(best) - gap))
    strong = F.col("authority") & (F.col("score") >= F.col("line"))
    by_eff = [F.col("eff").desc(), F.col("id")]
    # the guaranteed rows, capped per document
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "dkey", strong).orderBy(*by_eff)))
    sure = strong & (F.col("nth") <= cap_authority)
    c = c.withColumn("a", F.row_number().over(Window.partitionBy("qid", sure).orderBy(*by_eff)))
    c = c.withColumn("phase_a", sure & (F.col("a") <= authority_slots))
    # then by eff, a document's guaranteed rows counting first
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "dkey").orderBy(F.col("phase_a").desc(), *by_eff)))
    capped = F.col("nth") <= F.when(F.col("authority"), cap_authority).otherwise(cap_other)
    c = c.withColumn("phase", F.when(F.col("phase_a"), 0).when(capped, 1).otherwise(2))
    c = c.withColumn("pick", F.row_number().over(Window.partitionBy("qid").orderBy("phase", *by_eff)).cast("long"))
    return c.filter(F.col("pick") <= k).drop("line", "nth", "a", "phase_a")


def neighbours(picked: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Rows next to picked ones in the same document, at most ``most`` a query, those of the best picked rows first.

    picked: qid, source, position, sim; chunks: source, position and more. A neighbour after comes before one before.
    Gives qid, source, position, sim (the picked row's), added (rank).
    """
    sides = F.array(F.struct(F.lit(1).alias("step"), F.lit(0).alias("o")), F.struct(F.lit(-1).alias("step"), F.lit(1).alias("o")))
    near = picked.select("qid", "source", F.col("position").alias("at"), "sim", F.explode(sides).alias("s"))
    near = near.select("qid", "source", (F.col("at") + F.col("s.step")).alias("position"), "sim", "at", F.col("s.o").alias("o"))
    near = near.join(chunks.select("source", "position"), ["source", "position"]).join(picked.select("qid", "source", "position"), ["qid", "source", "position"], "left_anti")
    first = Window.partitionBy("qid", "source", "position").orderBy(F.col("sim").desc(), "at", "o")
    near = near.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "source", "at", "o")
    return near.withColumn("added", F.row_number().over(order).cast("long")).filter(F.col("added") <= most).select("qid", "source", "position", "sim", "added")


def best_per(rows: DataFrame, keys: list[str], order: list[Column], name: str = "_n") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) == 1).drop(name)


def gate(hits: DataFrame, least: float, query: str = "qid", score: str = "score") -> DataFrame:
    """No hit of a query whose best score is below ``least``."""
    return hits.withColumn("_best", F.max(score).over(Window.partitionBy(query))).filter(F.col("_best") >= least).drop("_best")


def numbered(rows: DataFrame, order: str, query: str = "qid") -> DataFrame:
    """``rows`` with index, from 1 in each query."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(query).orderBy(order)).cast("long"))


def appended(hits: DataFrame, evidence: DataFrame, order: str, query: str = "qid") -> DataFrame:
    """Evidence after each query's hits, its index going on from theirs; columns that evidence lacks are null."""
    last = hits.groupBy(query).agg(F.max("index").alias("_last"))
    more = numbered(evidence, order, query).join(last, query, "left").withColumn("index", F.col("index") + F.coalesce("_last", F.lit(0))).drop("_last")
    return hits.unionByName(more, allowMissingColumns=True)


def reranked(hits: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """The ``most`` first hits of each query by a reranker's score, equal ones by similarity, then id.

    hits: qid, id, sim; scores: qid, id, score. A query that lacks a score of any hit counts as failed: none of its
    scores is used, and similarity decides.
    """
    whole = F.count_if(F.col("score").isNull()).over(Window.partitionBy("qid")) == 0
    d = hits.join(scores.select("qid", "id", "score"), ["qid", "id"], "left").withColumn("score", F.when(whole, F.col("score")))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("sim").desc(), "id")
    return d.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)
