"""The pipeline's stages on the smallest tables, and the SQL of the queries that have one."""

import pytest

from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    quality, line, near, mix, pack = (f for _, f in P.STAGES)
    kept = quality(spark, docs, SF).cache()
    assert kept.columns == P.COLUMNS and 0 < kept.count() < docs.count()
    lined = line(spark, kept, SF).cache()
    assert lined.columns == P.COLUMNS
    for r in lined.collect():
        assert set(r["text"].split("\n")) <= set(before[r["doc_id"]]["text"].split("\n")) and r["n_chars"] == len(r["text"])
    one = near(spark, lined, SF).cache()
    assert one.columns == P.COLUMNS and {r["doc_id"] for r in one.collect()} <= {r["doc_id"] for r in lined.collect()}
    mixed = mix(spark, one, SF).cache()
    assert mixed.columns == P.COLUMNS and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    pieces = pack(spark, mixed, SF)
    assert pieces.filter("start = 0").count() == mixed.count()


def test_run(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_quality_rules"])
def test_matches_sql(spark, name):
    from docstrata.llm.registry import oracle_sql, queries

    df = queries()[name](spark, SF)
    names, expected = sql_rows(SF, oracle_sql()[name])
    assert sorted(df.columns) == names and rows_of(df) == expected


def test_stages_keep_rows_without_or_with_shared_ids(spark):
    import corpus_pipeline as P

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(3)), (7, text(4)), (5, text(4)), (7, text(5)), (8, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["text"], r["doc_id"]) for r in P.near_stage(spark, docs, SF).collect())
    assert got == [(text(0), None), (text(1), None), (text(2), None), (text(3), 7), (text(4), 5), (text(5), 7), (text(6), 8)]
    one = docs.filter("doc_id is null or doc_id = 7").dropDuplicates(["text"])
    texts = [r["text"] for r in P.mix_stage(spark, one, SF).collect()]
    # one source: its target is 1.5 times its words, so of 6 documents of 40 words 3 are taken twice
    assert len(texts) == 9 and set(texts) == {text(k) for k in range(6)} and max(map(texts.count, texts)) == 2
