import pytest
from pyspark.sql import functions as F

from docstrata.functions import jsontext
from docstrata.functions import text as T
from docstrata.operators import corpus, rules
from docstrata.sources.tables import front_matter


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "key"),
    [
        ("a/环评气化80t 宜川县.md", "a|环评气化80t宜川县"),
        ("a/环评气化80t 宜川县 copy.md", "a|环评气化80t宜川县"),
        ("a/环评气化80t宜川县环境影响报告.md", "a|环评气化80t宜川县"),
        ("a/环评报告.md", "a|环评报告"),
        ("a/长长的项目名称报告书全本(2).md", "a|长长的项目名称"),
        (None, "|"),
    ],
)
def test_doc_key(spark, source, key):
    assert one(spark, T.doc_key(F.col("s")), s=source) == key


@pytest.mark.parametrize(("text", "codes"), [("GB8978", ["8978"]), ("GB 8978-1996", ["8978"]), ("HJ 544—2016", ["544"]), ("none", []), (None, [])])
def test_codes(spark, text, codes):
    assert one(spark, T.codes_in(F.col("s")), s=text) == codes


@pytest.mark.parametrize(("tex", "text"), [(r"$1.0{\times}10^{-5}\,\mathrm{cm/s}$", "1.0×10⁻⁵ cm/s"), (r"$6{\sim}9$", "6~9"), (r"\frac{a}{b}", "a/b"), ("", "")])
def test_latex(spark, tex, text):
    assert one(spark, T.latex_to_text(F.col("s")), s=tex) == text


@pytest.mark.parametrize(("text", "number"), [("1,234.5 t", 1234.5), ("约 3万吨", 30000.0), ("-2", -2.0), ("none", None), (None, None)])
def test_parse_number(spark, text, number):
    assert one(spark, T.parse_number(F.col("s")), s=text) == number


def test_small_text_functions(spark):
    assert one(spark, T.subsequence(F.col("a"), F.col("b")), a="ace", b="abcde") is True
    assert one(spark, T.subsequence(F.col("a"), F.col("b")), a="aec", b="abcde") is False
    assert one(spark, T.covers_all(F.col("a"), F.col("b")), a="ba", b="abc") is True
    assert one(spark, T.bigrams(F.col("a")), a="排放x标准") == ["排放", "放标", "标准"]
    assert one(spark, T.standard_number(F.col("a")), a="gb/t 18599—2020") == "GBT185992020"
    assert one(spark, T.first_statement(F.col("a")), a="x -- c\n/* d */ SELECT 1,\n 2; SELECT 3") == "SELECT 1, 2"
    assert one(spark, T.safe_file_name(F.col("a")), a="../x/a:b") == "ab.pdf"
    assert one(spark, T.normalize_body(F.col("a")), a="a  \n![x](y)\n\n\n\nb\n") == "a\n\nb"


def test_front_matter(spark):
    head, body = front_matter(F.col("a"))
    text = "---\ntitle: T: x\nstatus: ok\n---\nbody\n"
    assert one(spark, head, a=text) == {"title": "T: x", "status": "ok"}
    assert one(spark, body, a=text) == "body\n"
    assert one(spark, body, a="plain") == "plain"


def test_chunks(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(4))
    text = "\n\n".join(["p" * 300, "q" * 198, "r" * 10, table, "s" * 2000])
    got = one(spark, corpus.chunks_of(F.col("a")), a=text)
    # 300 + 2 + 198 = 500 is not over the target; the next ten characters are
    assert got == ["p" * 300 + "\n\n" + "q" * 198, "r" * 10, table, "s" * 900, "s" * 900, "s" * 200]
    assert one(spark, corpus.chunks_of(F.col("a")), a=None) == []
    long = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 300} |" for i in range(4))
    pieces = one(spark, corpus.chunks_of(F.col("a")), a=long)
    assert len(pieces) == 2 and all(p.startswith("| a | b |\n|---|---|\n") for p in pieces)


def test_json():
    assert jsontext.first_object('x {bad} {"a": "}"} y') == '{"a": "}"}'
    assert jsontext.first_object(None) is None


def test_units_and_kleene(spark):
    units = spark.createDataFrame([*rules.UNITS], "unit string, dim string, factor double")
    d = spark.createDataFrame([(1.0, "亩", "平方米"), (5.0, "kg", "吨"), (2.0, "万吨", "吨"), (1.0, "吨", "米"), (3.0, "?", "?")], "v double, u string, to string")
    got = [r["x"] for r in rules.converted(d, units, "v", "u", "to", "x").orderBy("v", "u").collect()]
    assert sorted((round(x, 2) for x in got if x is not None)) == [0.01, 3.0, 666.67, 20000.0] and got.count(None) == 1
    k = spark.createDataFrame([(1, True), (1, None), (2, None), (2, False), (3, False)], "k int, b boolean").groupBy("k").agg(rules.kleene_any(F.col("b")).alias("any"), rules.kleene_all(F.col("b")).alias("all"))
    assert {r["k"]: (r["any"], r["all"]) for r in k.collect()} == {1: (True, None), 2: (None, False), 3: (False, False)}


def test_first_unconvertible_fact_decides(spark):
    conditions = spark.createDataFrame([(1, 1, "a", ">=", 5.0)], "cond int, tier int, keyword string, cmp string, threshold double")
    facts = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, 9.0), (2, "a", 1, 9.0), (2, "a", 2, None), (3, "b", 1, 1.0)], "o int, keyword string, ord int, value double")
    got = {r["o"]: r["result"] for r in rules.condition_results(facts, conditions, ["o"]).collect()}
    assert got == {1: None, 2: True, 3: None}


def test_conditions(spark):
    from docstrata.functions import conditions as C

    got = one(spark, C.conditions_of(F.col("a")), a="年用溶剂型涂料10吨及以上的;其他;二")
    assert [(c["kind"], c["value"], c["unit"], c["cmp"]) for c in got] == [("threshold", 10.0, "吨", ">="), ("qualitative", None, None, None), ("qualitative", None, None, None)]
    got = one(spark, C.conditions_of(F.col("a")), a="锅炉65吨/小时（45.5兆瓦）及以下的")
    assert [(c["keyword"], c["value"], c["unit"], c["cmp"]) for c in got] == [("锅炉", 65.0, "吨/小时", "<=")]
    assert one(spark, C.industry_codes(F.col("a")), a="学校 5000平方米 831、2018年 26") == ["831"]
    assert one(spark, C.keyword_fits(F.col("a"), F.col("b")), a="年用溶剂型涂料", b="溶剂型涂料（含稀释剂）") is True
    assert one(spark, C.core_words(F.col("a")), a="固体废物、噪声") == ["固体废物", "固体", "废物", "噪声"]
