"""Audit items of reports: element verdicts, decision tables joined as data, all items from one row of facts, statistics."""

from __future__ import annotations

from functools import reduce
from itertools import groupby, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of items, the plan of items with their kinds, required parts of reports, patterns, and the facts of
# the rules' inputs.
PROBLEM, SUSPECT, SUGGEST, OK, NOT_APPLICABLE = "存在问题", "存在疑似问题", "优化调整建议", "无问题", "不适用"
STATES = (PROBLEM, SUSPECT, SUGGEST, OK, NOT_APPLICABLE)
KIND_RANK = {"登记表": 1, "报告表": 2, "报告书": 3}
ELEMENTS = ("大气", "地表水", "地下水", "生态", "海洋", "环境风险", "土壤", "声环境")
ITEMS = [
    ("环评类别准确性", "category"),
    ("大气专项评价设置", "element"),
    ("地表水专项评价设置", "element"),
    ("地下水专项评价设置", "element"),
    ("生态专项评价设置", "element"),
    ("海洋专项评价设置", "element"),
    ("环境风险专项评价设置", "element"),
    ("土壤专项评价设置", "element"),
    ("声环境专项评价设置", "element"),
    ("专项评价数量上限", "quota"),
    ("风险物质识别完整性", "identification"),
    ("风险物质临界量引用正确性", "threshold"),
    ("风险物质 Q 值计算正确性", "q"),
    ("环境风险潜势与评价等级", "potential"),
    ("环境保护目标表完整性", "targets"),
    ("编制要素完整性", "completeness"),
    ("引用标准编号正确性", "citations"),
    ("结论章节与主要问题响应", "conclusion"),
]
REQUIRED_BOOK = [
    ("项目概况", ["项目概况", "企业概况", "建设项目概况", "工程概况", "概述"]),
    ("工程分析", ["工程分析", "工艺流程", "工艺分析", "工程内容"]),
    ("污染源", ["污染源", "源强", "污染物排放量", "排放源", "产污环节"]),
    ("环境影响预测", ["环境影响预测", "影响预测与评价", "预测与评价", "环境影响分析"]),
    ("环境风险", ["环境风险"]),
    ("环境保护措施", ["环境保护措施", "污染防治措施", "环保措施", "治理措施", "防治措施"]),
    ("结论", ["结论", "总结"]),
]
REQUIRED_FORM = [
    ("项目概况", ["建设项目基本情况", "项目概况", "工程概况"]),
    ("工程分析", ["工程分析", "工艺流程", "工程内容"]),
    ("污染源", ["污染物排放量", "污染源", "源强", "产污环节"]),
    ("环境保护措施", ["环境保护措施", "污染防治措施", "环保措施", "治理措施"]),
    ("结论", ["结论", "总结"]),
]
CHAPTER, SECTION = r"第\s*\d+\s*章[^\n]{0,16}", r"\d+(?:\.\d+)*\s*[^\n]{0,14}"
TARGET_NAME, TARGET_PLACE, TARGET_PEOPLE, TARGET_WORD = r"名称|保护对象|敏感点类型", r"方位|距离", r"户数|人数|规模|人口", r"保护目标|敏感目标|敏感点"
TARGET_ROW, TARGET_ROW_FULL = r"环境保护目标|敏感保护目标", r"方位|距离|m|米|无居民|无敏感"
TARGET_CAPTION = r"(环境保护目标|环境敏感目标|敏感目标)[^。\n]{0,12}(一览表|表)"
STANDARD = r"(?:HJ\s*/?\s*T?\s*\d{2,5}|GB\s*/?\s*T?\s*\d{4,5})\s*[—\-–~]\s*\d{2,4}"
WRONG_STANDARD = r"HJ\s*/\s*T\s*169\s*[—\-–~]\s*2018"
HARDNESS = ("硬-官方", "硬-标准自身", "软-待核")
ABOLISHED, NOT_FOUND, UNCHECKED = ("已废止", "废止"), "未查到", "软-待核"
MARINE = r"海洋工程|港口|码头|围填海|航道|疏浚|跨海|海底"
VERDICT = r"不可行|从环境保护角度[^。]{0,20}可行|项目建设可行|环境可行|可行"
# End of fixed values.

ANY = "*"
_BLANK = [ANY] * 6
HIGH, MIDDLE, LOW = "高", "中", "低"


def _rule(kind: str, cells: str, state: str, confidence: str, after: bool = False) -> tuple:
    given = cells.split()
    return (kind, *given, *_BLANK[len(given) :], state, confidence, int(after))


#: Kind, six cells, state, confidence, and whether the row overrides all others. Cells by kind:
#: category: kind known, entry found, tier decided, report's tier against it, exception; element: kind of report that has
#: elements, how decided, wanted, stated, evidence, pages of water; quota: such a kind, stated, exceeded; identification:
#: materials, some unknown; threshold: rows, a wrong one, all unknown, three right; q: rows, stated, below a term, differs;
#: potential: asked for, found with Q below 1, as expected; targets: form, place and distance; completeness: a part lacks;
#: citations: wrong, out of date, by an official source; conclusion: found, verdict.
AUDIT_TABLE = [
    _rule("category", "false", SUSPECT, LOW),
    _rule("category", "true false", SUSPECT, LOW),
    _rule("category", "true true false", SUSPECT, LOW),
    _rule("category", "true true true under", PROBLEM, HIGH),
    _rule("category", "true true true under unknown", PROBLEM, MIDDLE),
    _rule("category", "true true true equal", OK, HIGH),
    _rule("category", "true true true equal unknown", OK, MIDDLE),
    _rule("category", "true true true over", SUGGEST, HIGH),
    _rule("category", "true true true over unknown", SUGGEST, MIDDLE),
    _rule("element", "false", NOT_APPLICABLE, HIGH),
    _rule("element", "true null", SUSPECT, MIDDLE),
    _rule("element", "true unknown", SUSPECT, LOW),
    _rule("element", "true * true false true", PROBLEM, HIGH),
    _rule("element", "true * true false false", PROBLEM, MIDDLE),
    _rule("element", "true decided true null", SUSPECT, MIDDLE),
    _rule("element", "true decided true true true", OK, HIGH),
    _rule("element", "true decided true true false", OK, MIDDLE),
    _rule("element", "true decided false", OK, MIDDLE),
    _rule("element", "true decided false true", SUGGEST, MIDDLE),
    _rule("element", "true nature false * true", OK, MIDDLE),
    _rule("element", "true nature false * false", OK, LOW),
    _rule("element", "true nature false true true", SUGGEST, MIDDLE),
    _rule("element", "true nature false true false", SUGGEST, LOW),
    _rule("element", "true absence false", OK, LOW),
    _rule("element", "true absence false true", SUGGEST, LOW),
    _rule("element", "true * * * * standard", SUSPECT, LOW, after=True),
    _rule("quota", "false", NOT_APPLICABLE, HIGH),
    _rule("quota", "true false", SUSPECT, LOW),
    _rule("quota", "true true true", SUGGEST, MIDDLE),
    _rule("quota", "true true false", OK, MIDDLE),
    _rule("identification", "false", SUSPECT, LOW),
    _rule("identification", "true true", SUSPECT, MIDDLE),
    _rule("identification", "true false", OK, MIDDLE),
    _rule("threshold", "false", SUSPECT, LOW),
    _rule("threshold", "true true", PROBLEM, HIGH),
    _rule("threshold", "true false true", SUSPECT, LOW),
    _rule("threshold", "true false false true", OK, HIGH),
    _rule("threshold", "true false false false", OK, MIDDLE),
    _rule("q", "false", SUSPECT, LOW),
    _rule("q", "true false", SUSPECT, LOW),
    _rule("q", "true true true", PROBLEM, HIGH),
    _rule("q", "true true false true", SUSPECT, MIDDLE),
    _rule("q", "true true false false", OK, HIGH),
    _rule("potential", "false", NOT_APPLICABLE, MIDDLE),
    _rule("potential", "true false", SUSPECT, LOW),
    _rule("potential", "true true true", OK, MIDDLE),
    _rule("potential", "true true false", SUSPECT, MIDDLE),
    _rule("targets", "none", SUSPECT, LOW),
    _rule("targets", "caption", OK, LOW),
    _rule("targets", "row true", OK, MIDDLE),
    _rule("targets", "row false", SUGGEST, LOW),
    _rule("targets", "table true", OK, MIDDLE),
    _rule("targets", "table false", SUGGEST, MIDDLE),
    _rule("completeness", "true", SUSPECT, LOW),
    _rule("completeness", "false", OK, MIDDLE),
    _rule("citations", "true", SUGGEST, HIGH),
    _rule("citations", "false true true", SUGGEST, HIGH),
    _rule("citations", "false true false", SUGGEST, MIDDLE),
    _rule("citations", "false false", OK, LOW),
    _rule("conclusion", "false", SUSPECT, LOW),
    _rule("conclusion", "true true", OK, MIDDLE),
    _rule("conclusion", "true false", SUSPECT, LOW),
]


def decided(facts: DataFrame, inputs: list[str], table: list[tuple], outputs: list[str]) -> DataFrame:
    """``facts`` with the outputs of the row of a decision table that fits.

    table: a cell for each input (``ANY`` fits all, "null" null), the outputs, and 1 if the row overrides the others. Of
    the rows that fit an overriding one wins, then the one with most cells bound, then the first. The rows of each set of
    bound cells are one small table, joined by just those cells, so facts are never compared with all rows, and don't
    move while the tables are small enough to be sent. Facts that no row fits have null outputs.
    """
    n = len(inputs)
    by_mask: dict[tuple, dict[tuple, tuple]] = {}
    for k, row in enumerate(table):
        mask = tuple(c != ANY for c in row[:n])
        held = by_mask.setdefault(mask, {})
        cells, rank = tuple(c for c, bound in zip(row[:n], mask) if bound), (-row[-1], -sum(mask), k)
        if cells not in held or rank < held[cells][0]:
            held[cells] = (rank, row[n:-1])
    d, found = facts, []
    for m, (mask, rows) in enumerate(by_mask.items()):
        bound = [k for k in range(n) if mask[k]]
        schema = ", ".join([*[f"_c{m}_{k} string" for k in bound], f"_f{m} struct<after: int, bound: int, row: int, {', '.join(f'{o}: string' for o in outputs)}>"])
        rules = facts.sparkSession.createDataFrame([(*cells, (*rank, *values)) for cells, (rank, values) in rows.items()], schema)
        fits = F.lit(True)
        for k in bound:
            fits = fits & (F.coalesce(F.col(inputs[k]).cast("string"), F.lit("null")) == F.col(f"_c{m}_{k}"))
        d = d.join(F.broadcast(rules) if len(rows) <= 10_000 else rules, fits, "left").drop(*[f"_c{m}_{k}" for k in bound])
        found.append(F.col(f"_f{m}"))
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return d.withColumn("_best", best).select(*facts.columns, *[F.col("_best")[o].alias(o) for o in outputs])


def places(kind: str, table: list[tuple]) -> tuple[list[list[str]], list[tuple]]:
    """The rows of one kind of a decision table by place: the values named in each cell, and what each combination gives.

    A cell's values count from 1 in their order, any other value is 0; combinations are numbered with the last cell as
    the lowest. Rows win as in ``decided``; a combination that no row fits gives nulls.
    """
    rows = [(k, r) for k, r in enumerate(table) if r[0] == kind]
    named = [sorted({r[i] for _, r in rows} - {ANY}) for i in range(1, 7)]
    given = []
    for cells in product(*[[None, *v] for v in named]):
        fits = [((-r[-1], -sum(c != ANY for c in r[1:7]), k), r[7:9]) for k, r in rows if all(c in (ANY, x) for c, x in zip(r[1:7], cells))]
        given.append(min(fits)[1] if fits else (None, None))
    return named, given


def element_verdicts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """What the rules want of each element: keys, element, status (decided or unknown), wanted and reason.

    facts, one row a report: pollutants and listed (arrays), near, direct, tanker, groundwater, river, habitat, sea, risk
    (booleans, null where unknown). A missing fact makes an element unknown, not unwanted; an AND with one part false is
    decided.
    """
    c = {x: F.col(x) for x in ("near", "direct", "tanker", "groundwater", "river", "habitat", "sea", "risk")}
    some, hit = F.size(F.coalesce("pollutants", F.array())) > 0, F.size(F.coalesce("listed", F.array())) > 0
    yes = {x: F.coalesce(v, F.lit(False)) for x, v in c.items()}
    water = yes["direct"] & ~yes["tanker"]
    rows = [
        ("大气", F.when(~some, False).when(~hit, True).otherwise(c["near"].isNotNull()), hit & yes["near"], F.when(~some, "no pollutants").when(~hit, "not listed").when(c["near"].isNull(), "near unknown").when(c["near"], "listed and near").otherwise("listed, not near")),
        ("地表水", c["direct"].isNotNull(), water, F.when(c["direct"].isNull(), "unknown").when(water, "direct").otherwise("not direct")),
        ("地下水", c["groundwater"].isNotNull(), yes["groundwater"], F.when(c["groundwater"].isNull(), "unknown").when(c["groundwater"], "protected").otherwise("not protected")),
        ("生态", ~F.coalesce(c["river"], F.lit(True)) | (yes["river"] & c["habitat"].isNotNull()), yes["river"] & yes["habitat"], F.when(yes["river"] & yes["habitat"], "intake and habitat").when(~F.coalesce(c["river"], F.lit(True)), "no intake").otherwise("no habitat known")),
        ("海洋", c["sea"].isNotNull(), yes["sea"], F.when(yes["sea"], "marine").otherwise("not marine")),
        ("环境风险", c["risk"].isNotNull(), yes["risk"], F.when(c["risk"].isNull(), "unknown").when(c["risk"], "over").otherwise("under")),
        ("土壤", F.lit(True), F.lit(False), F.lit("never")),
        ("声环境", F.lit(True), F.lit(False), F.lit("never")),
    ]
    made = F.array(*[F.struct(F.lit(e).alias("element"), F.when(known, "decided").otherwise("unknown").alias("status"), wanted.alias("wanted"), reason.alias("reason")) for e, known, wanted, reason in rows])
    return facts.select(*keys, F.explode(made).alias("v")).select(*keys, "v.*")


def element_facts(verdicts: DataFrame, stated: DataFrame, evidence: DataFrame, reports: DataFrame, keys: list[str], elements: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """``elements`` for ``audit_items``: one row a report, a map from element to how, wanted, stated, evidence and water.

    verdicts: keys, element, status, wanted; stated: keys, element, set; evidence: keys, element; reports: keys, project,
    industry, intake (whether any page speaks of taking water) and water (null, weak or standard: what hints that the air
    pollutants stand on pages of waste water). An undecided sea isn't wanted by the nature of a project that isn't
    marine, an undecided ecology by the absence of any intake. ``elements`` are those asked for.
    """
    bits = lambda x, k: F.when(x, 3 << 2 * k).when(~x, 1 << 2 * k).otherwise(0)  # noqa: E731  told, and true
    told = verdicts.select(*keys, "element", (bits(F.col("status") == "decided", 0) + bits(F.col("wanted"), 1)).alias("told"))
    told = told.unionByName(stated.select(*keys, "element", bits(F.col("set"), 2).alias("told")))
    told = told.unionByName(evidence.select(*keys, "element", F.lit(3 << 6).alias("told")))
    # all that is told of a report moves once, and adds up as one number an element: no lists are gathered or sorted
    d = told.repartition(*[F.col(k) for k in keys]).groupBy(*keys).agg(*[F.bit_or(F.when(F.col("element") == x, F.col("told"))).alias(f"_told{k}") for k, x in enumerate(elements)])
    d = d.filter(reduce(lambda a, b: a | b, [F.col(f"_told{k}").bitwiseAND(1) != 0 for k in range(len(elements))])).join(reports, keys)
    about = F.concat_ws(" ", "project", "industry")

    def cell(x: Column) -> Column:
        known, wanted, stated, evidence = (F.when(x["told"].bitwiseAND(1 << 2 * k) != 0, x["told"].bitwiseAND(2 << 2 * k) != 0) for k in range(4))
        nature = (x["element"] == "海洋") & ~known & ~about.rlike(MARINE)
        absence = (x["element"] == "生态") & ~known & ~F.coalesce("intake", F.lit(False))
        named = nature & (F.coalesce("project", F.lit("")) != "")
        return F.struct(
            F.when(nature, "nature").when(absence, "absence").when(known, "decided").otherwise("unknown").alias("how"), F.when(nature | absence, False).otherwise(wanted).alias("wanted"), stated.alias("stated"),
            (F.coalesce(evidence, F.lit(False)) | named).alias("evidence"), F.when(x["element"] == "大气", F.col("water")).alias("water"),
        )

    each = F.filter(F.array(*[F.struct(F.lit(x).alias("element"), F.col(f"_told{k}").alias("told")) for k, x in enumerate(elements)]), lambda x: x["told"].bitwiseAND(1) != 0)
    return d.select(*keys, F.map_from_entries(F.transform(each, lambda x: F.struct(x["element"], cell(x)))).alias("elements"))


def audit_items(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The items of ``ITEMS`` of each report by one decision table: keys, no, item, state and confidence.

    facts, one row a report: kind (null if unknown), found, tier (null if undecided), exception; elements, a map from
    element to a struct of how, wanted, stated, evidence and water; stated_any, exceeds; risk_rows, risk_unknown;
    limit_rows, limit_wrong, limit_all_unknown, limit_right; q_rows, q_stated, q_below, q_differs; potential,
    potential_fits; targets, targets_full; lacks; wrong, stale, official; conclusion, verdict. All items come from one
    pass over the facts, each looked up by the place that its cells give in the table.
    """
    c = F.col
    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    order = F.coalesce(rank[c("tier")], F.lit(0)) - F.coalesce(rank[c("kind")], F.lit(0))
    is_form = F.coalesce(c("kind") == "报告表", F.lit(False))
    cells = {
        "category": [c("kind").isNotNull(), c("found"), c("tier").isNotNull(), F.when(order > 0, "under").when(order == 0, "equal").otherwise("over"), c("exception")],
        "quota": [F.coalesce(c("kind") == "报告表", F.lit(True)), c("stated_any"), c("exceeds")],
        "identification": [c("risk_rows") > 0, c("risk_unknown") > 0],
        "threshold": [c("limit_rows") > 0, c("limit_wrong") > 0, c("limit_all_unknown"), c("limit_right") >= 3],
        "q": [c("q_rows") > 0, c("q_stated"), c("q_below"), c("q_differs")],
        "potential": [~is_form | F.coalesce(c("elements")["环境风险"]["stated"], F.lit(False)), c("potential"), c("potential_fits")],
        "targets": [F.coalesce("targets", F.lit("none")), c("targets_full")],
        "completeness": [c("lacks") > 0],
        "citations": [c("wrong") > 0, c("stale") > 0, c("official")],
        "conclusion": [c("conclusion").isNotNull(), c("verdict").isNotNull()],
    }
    given, begins = [], {}
    for kind in dict(ITEMS).values():
        if kind not in begins:
            begins[kind] = len(given)
            given += places(kind, AUDIT_TABLE)[1]

    def place(kind: str, own: list[Column]) -> Column:
        at = F.lit(0)
        for x, values in zip([*own, *[F.lit(None)] * (6 - len(own))], places(kind, AUDIT_TABLE)[0]):
            if values:
                at = at * (len(values) + 1) + F.array_position(F.array(*map(F.lit, values)), F.coalesce(x.cast("string"), F.lit("null"))).cast("int")
        return at + begins[kind]

    # an item is one number until it is a row of its own; elements are read in a loop, so no generated method holds all
    parts = []
    for kind, run in groupby(ITEMS, key=lambda x: x[1]):
        if kind in cells:
            parts.append(F.array(*[place(kind, cells[kind]) for _ in run]))
        else:
            found = F.transform(F.array(*[F.lit(item.removesuffix("专项评价设置")) for item, _ in run]), lambda x: c("elements")[x])
            parts.append(F.transform(found, lambda e: place("element", [is_form, e["how"], e["wanted"], e["stated"], e["evidence"], e["water"]])))
    # an outer generator, as an inner one has all places worked out twice, for a filter on their number
    d = facts.select(*keys, F.concat(*parts).alias("places")).select(*keys, F.posexplode_outer("places").alias("no", "place"))
    named, states, confidences = (F.array(*map(F.lit, x)) for x in ([x for x, _ in ITEMS], [x for x, _ in given], [x for _, x in given]))
    return d.select(*keys, (F.col("no") + 1).alias("no"), F.get(named, F.col("no")).alias("item"), F.get(states, F.col("place")).alias("state"), F.get(confidences, F.col("place")).alias("confidence"))


def statistics(items: DataFrame, keys: list[str]) -> DataFrame:
    """The number of items in each state by report, and the most severe state."""
    counts = items.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in zip(STATES, ("problems", "suspects", "suggestions", "right", "not_applicable"))])
    return counts.withColumn("worst", F.when(F.col("problems") > 0, PROBLEM).when(F.col("suspects") > 0, SUSPECT).when(F.col("suggestions") > 0, SUGGEST).otherwise(OK))


def located_parts(pages: DataFrame, kinds: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    """Where each required part of a report stands: keys, part and page, null if it is nowhere.

    kinds: the keys and kind; a form needs ``REQUIRED_FORM``, any other report ``REQUIRED_BOOK``. A part has several words;
    the first word that a report holds tells the page: the first, among its ``most`` first occurrences, with a chapter's
    heading of that word, else a section's, else the first. All words are looked for in one pass over the pages.
    """
    need = [(form, k, part, w, word) for form, parts in ((True, REQUIRED_FORM), (False, REQUIRED_BOOK)) for k, (part, words) in enumerate(parts) for w, word in enumerate(words)]
    words = sorted({x[4] for x in need})
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = F.array(*[F.when(F.contains(text, F.lit(w)), F.struct(F.lit(w).alias("word"), ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long").alias("n"), text.rlike(CHAPTER + w).alias("chapter"), text.rlike(SECTION + w).alias("section"))) for w in words])
    hits = pages.select(*keys, "page", F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("h")).select(*keys, "page", "h.*")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "word").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.withColumn("before", before).filter(F.col("before") < most)
    best = hits.groupBy(*keys, "word").agg(F.coalesce(F.min(F.when(F.col("chapter"), F.col("page"))), F.min(F.when(F.col("section"), F.col("page"))), F.min("page")).alias("page"))
    wanted = F.array(*[F.struct(F.lit(form).alias("form"), F.lit(k).alias("k"), F.lit(part).alias("part"), F.lit(w).alias("w"), F.lit(word).alias("word")) for form, k, part, w, word in need])
    d = kinds.select(*keys, F.coalesce(F.col("kind") == "报告表", F.lit(False)).alias("is_form"), F.explode(wanted).alias("x")).filter(F.col("x.form") == F.col("is_form")).select(*keys, "x.k", "x.part", "x.w", "x.word")
    d = d.join(best, [*keys, "word"], "left")
    return d.groupBy(*keys, "k", "part").agg(F.min_by("page", F.when(F.col("page").isNotNull(), F.col("w"))).alias("page")).drop("k")


def targets_form(tables: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """How a report gives its protected places: keys, form (table, row or caption), page and full; reports without have no row.

    A table counts that has a data row and, in its first three rows, names, places and either the word itself or people;
    else a row whose first cell has the word; else a caption in the text, with the first table of two data rows on its
    page if there is one. full: place and distance are both told (a row: either), null for a caption alone.
    """
    blob = F.array_join(F.flatten(F.slice("rows", 1, 3)), " ", "")
    d = tables.select(*keys, "page", "table", "rows", blob.alias("blob"))
    fits = (F.size("rows") > 1) & F.col("blob").rlike(TARGET_NAME) & F.col("blob").rlike(TARGET_PLACE) & (F.col("blob").rlike(TARGET_WORD) | F.col("blob").rlike(TARGET_PEOPLE))
    both = F.contains("blob", F.lit("方位")) & F.contains("blob", F.lit("距离"))
    whole = d.filter(fits).select(*keys, F.lit(0).alias("step"), "page", "table", F.lit(0).alias("row"), F.lit("table").alias("form"), both.alias("full"))
    rows = d.select(*keys, "page", "table", F.posexplode("rows").alias("row", "cells"))
    said = F.substring(F.array_join(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), " ", ""), 1, 200)
    rows = rows.filter(F.coalesce(F.get("cells", F.lit(0)), F.lit("")).rlike(TARGET_ROW)).select(*keys, F.lit(1).alias("step"), "page", "table", "row", F.lit("row").alias("form"), said.rlike(TARGET_ROW_FULL).alias("full"))
    caption = pages.filter(F.col("text").rlike(TARGET_CAPTION)).groupBy(*keys).agg(F.min("page").alias("page"))
    below = d.filter(F.size("rows") > 2).groupBy(*keys, "page").agg(F.min_by("blob", "table").alias("blob"))
    caption = caption.join(below, [*keys, "page"], "left")
    caption = caption.select(*keys, F.lit(2).alias("step"), "page", F.lit(0).alias("table"), F.lit(0).alias("row"), F.when(F.col("blob").isNotNull(), "table").otherwise("caption").alias("form"), both.alias("full"))
    best = whole.unionByName(rows).unionByName(caption).groupBy(*keys).agg(F.min(F.struct("step", "page", "table", "row", "form", "full")).alias("b"))
    return best.select(*keys, "b.form", "b.page", "b.full")


def standard_key(number: Column) -> Column:
    """A standard's number in capitals without blanks, slashes and dashes of any kind."""
    return F.regexp_replace(F.upper(F.coalesce(number, F.lit(""))), r"[\s\-/—–－~～]", "")


def stale_citations(pages: DataFrame, currency: DataFrame, keys: list[str], most: int = 300) -> DataFrame:
    """Standards that a report cites and that are replaced, abolished or unchecked: keys, number, page, hardness and finding.

    currency: standard, title, hardness, state, replaced. Of several entries of one standard the hardest counts, one that
    tells what replaces it first, then the first by title. Among a report's ``most`` first citations each standard counts
    where it is cited first; standards that the table lacks aren't judged.
    """
    known = currency.withColumn("key", standard_key(F.col("standard"))).filter("key != ''")
    hard = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, HARDNESS)), F.col("hardness")), F.lit(0)), F.lit(9))
    told = (F.trim(F.coalesce("replaced", F.lit(""))) != "") & ~F.contains(F.coalesce("replaced", F.lit("")), F.lit(NOT_FOUND))
    finding = F.when(F.col("hardness") == UNCHECKED, "unchecked").when(told, F.concat(F.lit("replaced by "), F.trim("replaced"))).when(F.col("state").isin(*ABOLISHED), "abolished")
    best = known.groupBy("key").agg(F.min(F.struct(hard.alias("h"), F.when(told, 0).otherwise(1).alias("r"), F.coalesce("title", F.lit("")).alias("title"), "hardness", finding.alias("finding"))).alias("b"), F.count_distinct(F.coalesce("state", F.lit(""))).alias("states"))
    cited = pages.select(*keys, "page", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(STANDARD), F.lit(0))).alias("place", "number"))
    place = Window.partitionBy(*keys).orderBy("page", "place")
    cited = cited.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= most).withColumn("key", standard_key(F.col("number")))
    first = cited.groupBy(*keys, "key").agg(F.min(F.struct("page", "place", "number")).alias("c"))
    d = first.join(best, "key").filter(F.col("b.finding").isNotNull())
    note = F.when(F.col("states") > 1, F.concat("b.finding", F.lit("; states differ"))).otherwise(F.col("b.finding"))
    return d.select(*keys, "c.number", "c.page", F.col("b.hardness").alias("hardness"), note.alias("finding"))


def conclusions(pages: DataFrame, keys: list[str], reach: int = 10) -> DataFrame:
    """Where a report concludes and what it says: keys, page, verdict and verdict_page; reports without the word have no row.

    Of the pages with the word the one most like its chapter counts: a chapter's or section's heading in its first 500
    characters, the usual titles, and the last two fifths of the report; the first of equal ones. The verdict is the
    first within ``reach`` pages from there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.substring(text, 1, 500)
    last = F.max("page").over(Window.partitionBy(*keys))
    score = F.when(head.rlike(r"第\s*\d+\s*章[^\n]{0,10}结论"), 4).otherwise(0) + F.when(head.rlike(r"(?m)^\s*\d+(?:\.\d+)*\s*结论"), 3).otherwise(0) + F.when(head.rlike(r"(?m)结论与建议|结论及建议|结论$"), 2).otherwise(0)
    d = pages.select(*keys, "page", text.alias("text"), score.alias("score"), last.alias("last"))
    d = d.withColumn("score", F.col("score") + F.when(F.col("page") > 0.6 * F.col("last"), 2).otherwise(0))
    best = d.filter(F.contains("text", F.lit("结论"))).groupBy(*keys).agg(F.max_by("page", F.struct("score", -F.col("page"))).alias("begin"))
    said = d.select(*keys, "page", F.regexp_extract("text", VERDICT, 0).alias("v")).filter("v != ''").join(best, keys)
    said = said.filter((F.col("page") >= F.col("begin")) & (F.col("page") < F.col("begin") + reach)).groupBy(*keys).agg(F.min(F.struct("page", "v")).alias("s"))
    return best.join(said, keys, "left").select(*keys, F.col("begin").alias("page"), F.col("s.v").alias("verdict"), F.col("s.page").alias("verdict_page"))
