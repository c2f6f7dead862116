from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docstrata.streaming import pieces as P


def run(parts):
    state, thought, answer = ("", False), "", ""
    for k, x in enumerate(parts):
        state, a, b = P.split_thought(state, x, last=k == len(parts) - 1)
        thought, answer = thought + a, answer + b
    return thought, answer


@given(st.text("<>/think ab", max_size=30), st.text("<>/think ab", max_size=30), st.lists(st.integers(0, 70), max_size=8), st.booleans())
def test_any_cut_gives_the_same(a, b, cuts, marked):
    text = a + (P.END_OF_THOUGHT if marked else "") + b
    edges = sorted({0, len(text), *(min(c, len(text)) for c in cuts)})
    parts = [text[x:y] for x, y in zip(edges, edges[1:])] or [""]
    head, found, tail = text.partition(P.END_OF_THOUGHT)
    assert run(parts) == (head, tail)


def test_tail_guard():
    held, out = P.guard_tail("", "答案。其余", "仅供参考")
    assert (out, held) == ("答案。", "其余")
    held, out = P.guard_tail("", "结论。以上仅供参考。", "仅供参考")
    assert out == "结论。" and P.guard_tail(held, "", "仅供参考", last=True) == ("", "")


def test_tail_guard_batch(spark):
    texts = ["答案。以上仅供参考。", "仅供参考。" + "长" * 500, "x" * 130 + "仅供参考", "a.仅供参考b!c", "", None, "无"]

    def slow(t):
        held, shown = P.guard_tail("", t or "", "仅供参考")
        return shown + P.guard_tail(held, "", "仅供参考", last=True)[1]

    rows = P.guard_batch(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "仅供参考").collect()
    assert {r.id: r.text for r in rows} == {i: slow(t) for i, t in enumerate(texts)}


def test_throttled(spark):
    from docstrata.streaming.events import throttled

    rows = [("a", float(t)) for t in (0, 3, 9, 10, 19, 20, 31)] + [(None, 5.0), (None, 6.0), ("b", None), ("b", -4.0), ("a", 0.0)]
    got = throttled(spark.createDataFrame(rows, "k string, t double"), "k", F.col("t"), 10.0).collect()
    assert sorted((str(r.k), r.seconds) for r in got) == [("None", 5.0), ("a", 0.0), ("a", 10.0), ("a", 20.0), ("a", 31.0), ("b", -4.0)]


def test_stream_equals_batch(spark, tmp_path):
    from docstrata.plans.streams import _pieces

    pieces = _pieces(spark, "/root/testdata/sf0.001")
    pieces.repartition(1).sortWithinPartitions("request", "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "in"))
    q = P.split_stream(stream).writeStream.format("memory").queryName("split").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = F.array_sort(F.collect_list(F.struct("seq", "reasoning", "answer")))
    got = spark.table("split").groupBy("request").agg(rows.alias("r")).select("request", F.array_join("r.reasoning", "").alias("reasoning"), F.array_join("r.answer", "").alias("answer"))
    assert sorted(got.collect()) == sorted(P.split_batch(pieces).collect())


def test_windows_with_watermark(spark, tmp_path):
    from docstrata.streaming.events import windowed

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    s = windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "1 hour", late="10 minutes")
    q = s.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("windows").count() >= 0
