"""Nearest rows by blocks: the same as brute force, however the blocks fall, and a pair of blocks at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import search


def test_nearest_holds_one_pair_of_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(search, "ROWS_AT_ONCE", 3)
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(150, 4)).round(3)
    vecs[10] = vecs[11] = vecs[140]
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(vecs)] + [(None, [1.0] * 4, 0), (200, None, 1)]
    corpus = spark.createDataFrame(rows, "id long, vec array<float>, label int")
    queries = corpus.filter("id % 5 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    unit = np.array([np.asarray(v, np.float32).astype(float) for v in vecs])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 6)
    for group in (None, "label"):
        out = search.nearest(queries, corpus.select("id", "vec", *([group] if group else [])), 4, group)
        assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["qid"], r[group] if group else None, r["place"]): (r["id"], r["sim"]) for r in out.collect()}
        want = {}
        for q in range(0, 150, 5):
            for g in (0, 1, 2) if group else (None,):
                ids = sorted((k for k in range(150) if g is None or k % 3 == g), key=lambda k: (-sims[q, k], k))
                want |= {(q, g, n + 1): (k, sims[q, k]) for n, k in enumerate(ids[:4])}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(v[1] == pytest.approx(want[k][1], abs=1.1e-6) for k, v in got.items())
    assert search.nearest(queries.filter("qid < 0"), corpus.select("id", "vec"), 4).count() == 0
