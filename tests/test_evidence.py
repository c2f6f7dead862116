"""Numbers as they are written and looked for."""

from pyspark.sql import functions as F

from docstrata.functions import evidence as E


def test_general_format_rounds_the_exact_value(spark):
    asked = [988032.5, 549692.5, 32350.0 * 70.7, 100001.5, 1234.565, 0.0, 1e-5, 123456789.0, None, float("nan"), float("inf")]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "k int, x double")
    got = [r["g"] for r in d.select("k", E.general_format(F.col("x")).alias("g")).orderBy("k").collect()]
    assert got == [None if x is None else "%g" % x for x in asked]


def test_number_spellings_of_large_integers(spark):
    d = spark.createDataFrame([("1234567",), ("1000000.0",), ("3000.0",), ("0.5",), ("x",)], "s string")
    got = [sorted(r["f"]) for r in d.select(E.number_spellings(F.col("s")).alias("f")).collect()]
    assert got == [["1234567"], ["1000000", "1000000.0"], ["3000", "3000.0"], ["0.5"], ["x"]]


def test_leaf_faults_finds_numbers_of_seven_digits(spark):
    rows = [(1, '{"n": 1234567}', "共 1234567 个"), (2, '{"n": 1234567}', "共 1234568 个"), (3, '{"n": 12}', "12")]
    d = spark.createDataFrame(rows, "k int, v string, t string")
    got = {r["k"]: [(f["path"], f["reason"]) for f in r["faults"]] for r in E.leaf_faults(d, ["k"], "v", "t").collect()}
    assert got == {1: [], 2: [("n", "number 1234567")], 3: []}
