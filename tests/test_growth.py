"""Operators whose joins must not grow with copies: the same results from what is grouped first."""

from pyspark.sql import functions as F

from docstrata.operators import rules as R


def test_resolve_groups_entries_before_it_joins(spark):
    table = spark.createDataFrame([(k, f"c{k}", "red widget" if k % 2 else "blue gear") for k in range(20)], "ord int, code string, name string")
    asked = spark.createDataFrame([("red widget", None), ("x", "c7"), (None, "c8"), ("GEAR", None), ("d wid", None), ("no", None), ("blue gear", "c11")], "ask string, code string")
    aliases = spark.createDataFrame([("gear", "blue gear")], "alias string, name string")
    out = R.resolve(asked, table, aliases)
    got = {(r["ask"], r["code"]): (r["ord"], r["how"]) for r in out.collect()}
    assert got == {("red widget", None): (1, "name"), ("x", "c7"): (7, "code"), (None, "c8"): (8, "code"), ("GEAR", None): (0, "alias"), ("d wid", None): (1, "part"), ("no", None): (None, None), ("blue gear", "c11"): (11, "code")}


def test_resolve_sends_no_whole_table(spark, tmp_path):
    """Files that pack well look small; as rows they may not be sent, and their groups' size is known before they meet."""
    rows = spark.range(20_000).select("id", F.concat(F.repeat(F.lit("c"), F.lit(300)), F.col("id").cast("string")).alias("code"), F.concat(F.lit("red "), F.repeat(F.lit("w"), F.lit(300)), (F.col("id") % 5000).cast("string")).alias("name"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxBroadcastTableSize")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000000")
        spark.conf.set("spark.sql.maxBroadcastTableSize", "2000000")
        asked = t.select(F.col("name").alias("ask"), F.when(F.col("id") % 2 == 0, F.col("code")).alias("code"))
        out = R.resolve(asked, t.select(F.col("id").alias("ord"), "code", "name"), t.groupBy(F.col("code").alias("alias")).agg(F.min("name").alias("name")))
        assert {(r["how"], r["count"]) for r in out.groupBy("how").count().collect()} == {("code", 10_000), ("name", 2500)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_candidates_count_copies_of_entries_once(spark):
    from docstrata.operators import catalog as C

    items = spark.range(300).select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, "炼铁厂、铸造 312").otherwise("炼铁厂").alias("category"), F.lit("有电镀工艺的").alias("book"))
    assert sorted(r["items"] for r in C.classes(items, ["book"], 5).collect()) == [[0, 3, 6, 9, 12], [1, 2, 4, 5, 7]]
    texts = spark.createDataFrame([(1, "炼铁厂"), (2, "炼铁厂 312"), (3, "学校")], "id int, text string")
    for rare in (0, 1, 200):  # the same by frequent and by rare terms
        got = {(r["id"], r["place"]): (r["item"], r["why"]) for r in C.candidates(texts, items, ["book"], least=1, rare=rare).collect()}
        assert got == {(1, k + 1): (k, "name:炼铁厂") for k in range(5)} | {(2, k + 1): (3 * k, "code:312；name:炼铁厂") for k in range(5)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_do_not_gather_facts_by_keyword(spark):
    """Facts of one word lie in many tasks: they meet the rules where they are, and a subject's facts move once."""
    facts = spark.createDataFrame([(1, "A", 1, 50.0), (1, "A", 2, None), (2, "A", 1, None), (2, "A", 2, 50.0), (3, "B", 1, 1.0), (4, "A", 1, 1.0), (None, "A", 1, 50.0)], "o int, keyword string, ord int, value double")
    rules = spark.createDataFrame([(1, 1, "A", ">=", 45.0), (2, 2, "B", "<", 5.0)], "cond int, tier int, keyword string, cmp string, threshold double")
    results = R.condition_results(facts, rules, ["o"])
    assert {(r["o"], r["cond"]): r["result"] for r in results.collect() if r["o"]} == {(1, 1): True, (1, 2): None, (2, 1): None, (2, 2): None, (3, 1): None, (3, 2): True, (4, 1): False, (4, 2): None}
    out = R.tiers(results, ["o"])
    assert {r["o"]: (r["decided"], r["state"]) for r in out.collect()} == {1: (1, "true"), 2: (1, "unknown"), 3: (1, "unknown"), 4: (2, "unknown"), None: (None, None)}
    assert "SortMergeJoin" not in _plan(out) and "keyword" not in "".join(x for x in _plan(out).splitlines() if "Exchange hash" in x)
    units = spark.createDataFrame([("t", "mass", 1.0), ("kg", "mass", 0.001)], "unit string, dim string, factor double")
    rows = spark.createDataFrame([(1.0, "t", "kg"), (2.0, "x", "kg"), (3.0, "x", "x")], "v double, unit string, to string")
    out = R.converted(rows, units, "v", "unit", "to", "q")
    assert sorted((r["q"] for r in out.collect()), key=repr) == [1000.0, 3.0, None]
    assert "SortMergeJoin" not in _plan(out)


def test_scores_send_no_catalogue_and_keep_the_best_in_each_task(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("item"), F.array(F.lit("steel"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")), F.lit(None)).alias("terms"), F.when(F.col("id") % 2 == 0, F.array(F.lit("11"))).alias("codes"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    items = spark.read.parquet(str(tmp_path / "t"))
    asked = spark.createDataFrame([(1, ["steel", "11", None]), (2, ["n3"]), (3, ["no"]), (4, ["steel", "steel", "n3"])], "ask int, terms array<string>")
    for sent in (R.SENT_WORDS, 0):
        monkeypatch.setattr(R, "SENT_WORDS", sent)
        out = R.catalog_scores(asked, items)
        plan = _plan(out)
        assert "WindowGroupLimit" in plan
        assert ("SortMergeJoin" in plan) == (sent == 0)
        got = sorted(tuple(r) for r in out.select("ask", "item", "score", "place").collect())
        assert got == [(1, 2 * k, 85, k + 1) for k in range(5)] + [(4, 3 + 7 * k, 29, k + 1) for k in range(5)]


def test_audit_items_are_looked_up_without_joins(spark):
    """A decision table by place gives what it gives by joins, for all combinations of its cells' values."""
    from itertools import product

    from docstrata.operators import audit as A
    from docstrata.plans import registry

    plan = _plan(registry.queries()["audit_items"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Join") <= 4 and "collect_list" not in plan
    rows, expected = [], []
    for kind in sorted({k for _, k in A.ITEMS}):
        named, given = A.places(kind, A.AUDIT_TABLE)
        combined = list(product(*[["?", *v] for v in named]))
        assert len(combined) == len(given)
        rows += [(kind, *c) for c in combined]
        expected += [(kind, *c, *g) for c, g in zip(combined, given)]
    inputs = ["rule", *[f"c{i}" for i in range(6)]]
    facts = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in inputs))
    found = A.decided(facts, inputs, A.AUDIT_TABLE, ["state", "confidence"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_rules_are_searched_once_a_page(spark):
    from docstrata.operators import extraction as X

    pages = spark.createDataFrame([("a", 1, "no"), ("a", 2, "say b7 and b8"), ("a", 3, "b9"), ("b", 1, None), ("b", 2, "cc  b1")], "report string, page int, text string")
    rules = [("k", "b[0-9]", True), ("k", "zz*", False), ("e", "q*", "empty"), ("l", "(?<=a)y|c+", "behind")]
    found = X.rule_hits(pages, ["report"], rules, around=3)
    assert sorted(map(tuple, found.collect())) == [("a", 0, "k", 2, "ay b7 an"), ("a", 3, "l", 2, "say b7"), ("b", 0, "k", 2, "c b1"), ("b", 3, "l", 2, "cc b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr") + plan.count("regexpinstr") == len(rules), plan


def test_cells_are_read_once(spark):
    """Filters on what is read from a cell don't read the cell again."""
    from docstrata.plans import registry

    for name, most in (("table_materials", 1), ("table_risks", 2), ("table_targets", 1)):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[0-9]+(?:\\.[0-9]+)?") == most, name
        assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x], name


def test_keys_of_models_are_made_once(spark):
    """What is asked is read from a table by each way of meeting, so no plan reads the lines again."""
    from docstrata.plans import registry

    for name in ("model_keys", "placeholder_fields"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan, name


def test_texts_and_classes_of_entries_meet_as_numbers(spark):
    """Pairs of texts and classes are added up by two keys, without the terms; frequent and rare ways give the same."""
    import re

    from docstrata.operators.catalog import candidates

    items = [(k, f"红{k % 7}漆、绿{k % 3}漆", f"有红{k % 7}漆工艺的；年用绿{k % 3}漆的", None) for k in range(60)]
    asks = [(k, f"有红{k % 7}漆工艺的绿{k % 3}漆") for k in range(40)]
    d = spark.createDataFrame(items, "item long, category string, book string, form string")
    t = spark.createDataFrame(asks, "id long, text string")
    results = []
    for rare in (0, 9, 1000):
        found = candidates(t, d, ["book", "form"], rare=rare)
        plan = found._jdf.queryExecution().toString()
        assert "array_contains" not in plan or not re.search(r"Aggregate[^\n]*often[^\n]*aid", plan)
        results.append(sorted(map(tuple, found.collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 200
