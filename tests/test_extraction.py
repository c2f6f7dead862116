"""Extraction and audit rules on reports in their own language, against direct readings of the same rules."""

import random
import re

import pytest


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("a", 1, "公示版\n某市玻璃厂技改项目\n环境影响报告书\n建设单位：某公司"),
        ("a", 2, "环境影响报告书\n行业类别：非金属矿物制品业\n对照《建设项目环境影响评价分类管理名录》，本项目属于二十七、57 玻璃制造，应编报告书。"),
        ("a", 9, "本项目废水是否直排：否。厂界外500m范围内有3个村庄。"),
        ("b", 1, "环境影响报告表\n"),
        ("b", 2, "废水去向未抽到（无法判断是否直排），废水直接排入东河。取水口位于南侧河道。"),
        ("b", 3, "废水经处理后排入污水处理厂。提到分类管理名录但没有序号，属于一般。"),
        ("c", 1, None),
    ]
    return spark.createDataFrame(rows, "report string, page int, text string")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        ("a", 3, 1, [["项目名称", "", "玻璃厂"], ["建设单位", "某公司"], ["行业类别（分类管理名录）", "", "57 玻璃制造"], ["建设地点", "x"]]),
        ("b", 2, 1, [["项目名称", "工程内容"], ["建设项目名称", "喷涂线"]]),
        ("d", 1, 1, [["行业类别", "木材加工"], []]),
    ]
    return spark.createDataFrame(rows, "report string, page int, table int, rows array<array<string>>")


def test_basic_fields(spark, pages, tables):
    from docstrata.operators import extraction as X

    names = spark.createDataFrame([("a", "x/1、玻璃.pdf"), ("b", "b.pdf"), ("c", "d/公示版-丙.v2.pdf"), ("d", "d.pdf")], "report string, file string")
    found = {(r.report, r.key): (r.value, r.page, r.method) for r in X.basic_fields(pages, tables, names, ["report"]).collect()}
    assert found == {
        ("a", "kind"): ("报告书", 1, "regex"), ("b", "kind"): ("报告表", 1, "regex"),
        ("a", "project"): ("某市玻璃厂技改项目", 1, "cover"), ("b", "project"): ("喷涂线", 2, "table"), ("c", "project"): ("丙.v2", 1, "filename"), ("d", "project"): ("d", 1, "filename"),
        ("a", "owner"): ("某公司", 3, "table"), ("a", "industry"): ("57 玻璃制造", 3, "table"), ("d", "industry"): ("木材加工", 1, "table"),
    }


def test_catalogue_references(pages, tables):
    from docstrata.operators import extraction as X

    by_cells = {(r.report, r.key): r.value for r in X.labelled(tables, ["report"], X.CATALOG_LABELS).collect()}
    assert by_cells == {("a", "catalog"): "57 玻璃制造", ("a", "stated_industry"): "57 玻璃制造", ("d", "stated_industry"): "木材加工"}
    found = X.self_reference(pages, ["report"], X.CATALOG_PATTERNS, X.CATALOG_NEEDS).collect()
    assert [(r.report, r.page) for r in found] == [("a", 2)] and "57 玻璃制造" in found[0].value


def test_inputs_keep_off_doubts_and_questions(pages):
    from docstrata.operators import extraction as X

    found = {(r.report, r.key): (r.value, r.page) for r in X.findings(pages, ["report"], X.INPUT_RULES).collect()}
    assert found == {("a", X.AIR_INPUT): ("true", 9), ("a", "废水是否直排"): ("false", 9), ("b", "废水是否直排"): ("false", 3)}


def direct_findings(pages, rules, guards, around):
    out = {}
    for report in {p[0] for p in pages}:
        for key in dict.fromkeys(k for k, _, _ in rules):
            for k, pattern, value in rules:
                if k != key:
                    continue
                hit = next(((n, t, m) for r, n, t in sorted(pages, key=lambda p: p[1]) if r == report for m in [re.search(pattern, t)] if m), None)
                if not hit:
                    continue
                n, t, m = hit
                quote = re.sub(r"\s+", " ", t[max(0, m.start() - around) : m.end() + around]).strip()
                if any(re.search(g, quote) for g in guards):
                    continue
                out[report, key] = (str(value).lower(), n, quote)
                break
    return out


def test_findings_as_a_direct_search(spark):
    from docstrata.functions.evidence import QUESTION, UNCERTAIN
    from docstrata.operators import extraction as X

    rnd = random.Random(4)
    bits = ["废水", "污水", "是否", "直排", "直接排入", "排入", "否", "无", "非", "不", "。", "\n", "：", "？", "管网", "污水处理厂", "取水", "河道", "新增", "取水口", "无法判断", "500m内", "无保护目标", "有", "居民", "厂界外", "涉及", "饮用水水源保护区", "，", "本项目"]
    pages = [(f"r{k % 40}", 1 + k // 40, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for k in range(400)]
    d = spark.createDataFrame(pages, "report string, page int, text string")
    found = {(r.report, r.key): (r.value, r.page, r.quote) for r in X.findings(d, ["report"], X.INPUT_RULES).collect()}
    assert found == direct_findings(pages, X.INPUT_RULES, (UNCERTAIN, QUESTION), 80) and len(found) > 60


def test_quantities(spark):
    from pyspark.sql import functions as F

    from docstrata.operators.extraction import header_unit, quantity

    cells = [("54.75 万", 547500.0, ""), ("2.2", 2.2, ""), ("1500t/d", 1500.0, "t/d"), ("1,234.5 吨", 1234.5, "吨"), ("约 12 万 t", 120000.0, "t"), ("— 7", 7.0, "—"), ("无", None, None), (None, None, None)]
    d = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(cells)], "k int, c string").select("k", quantity(F.col("c")).alias("q"))
    assert {r.k: (r.q and r.q.value, r.q and r.q.unit) for r in d.collect()} == {k: (v, u) for k, (_, v, u) in enumerate(cells)}
    heads = spark.createDataFrame([("改建完成后 万 t/a",), ("用量",)], "h string").select(header_unit(F.col("h")).alias("u")).collect()
    assert [r.u for r in heads] == ["万t/a", ""]


def test_broken_tables(spark):
    """No rows, empty rows, null cells, rows of unlike lengths."""
    from docstrata.operators import extraction as X

    rows = [("a", 1, 1, []), ("a", 1, 2, [[]]), ("a", 1, 3, None), ("a", 2, 4, [["名称", None, "数量（吨）"], ["甲", None], ["乙", None, "3"], [None, None, "4"], ["丙", "x", None]])]
    t = spark.createDataFrame(rows, "report string, page int, table int, rows array<array<string>>")
    anchors = spark.createDataFrame([], "report string, anchor string, page int")
    for header in ({}, {"merged": True, "carried": True}):
        found = {r.name: (r.quantity, r.unit) for r in X.materials(t, anchors, ["report"], **header).collect()}
        assert found == {}, found
    two = spark.createDataFrame([("a", 1, 1, [["名称", "数量（吨）"], ["甲醇"], ["乙醇", "3"], [None, "4"], ["丙酮", None]])], t.schema)
    assert {r.name: (r.quantity, r.unit) for r in X.materials(two, anchors, ["report"]).collect()} == {"乙醇": (3.0, "吨"), "丙酮": (None, "吨")}
    assert X.targets(t, anchors, ["report"]).count() == 0 and X.risk_materials(t, ["report"]).count() == 0


def test_decision_table(spark):
    from docstrata.operators.audit import decided

    table = [("*", "*", "any", 0), ("a", "*", "a", 0), ("*", "1", "one", 0), ("a", "1", "both", 0), ("*", "null", "none", 0), ("*", "9", "over", 1), ("b", "2", "first", 0), ("b", "2", "second", 0)]
    facts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", None), (None, None), ("a", 9), ("b", 2), ("b", 2)], "x string, y int")
    found = sorted((str(r.x), str(r.y), r.out) for r in decided(facts, ["x", "y"], table, ["out"]).collect())
    assert found == sorted([("a", "1", "both"), ("a", "2", "a"), ("b", "1", "one"), ("b", "3", "any"), ("c", "None", "none"), ("None", "None", "none"), ("a", "9", "over"), ("b", "2", "first"), ("b", "2", "first")])
    assert decided(facts, ["x", "y"], table[1:2], ["out"]).filter("out IS NULL").count() == 6


def test_covering_characters(spark):
    from docstrata.operators.catalog import covering

    rnd = random.Random(2)
    texts = [(k, "".join(rnd.choice("甲乙丙丁戊己庚") for _ in range(rnd.randint(0, 6)))) for k in range(60)] + [(99, None), (None, "甲乙")]
    phrases = ["甲乙", "丙丁戊", "庚", "辛甲", "甲甲", "", None]
    found = {(r.id, r.phrase) for r in covering(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert found == {(k, p) for k, t in texts for p in phrases if k is not None and t and p and set(p) <= set(t)}
