"""Facts from reports: roles of table columns, rows of tables as facts, and ordered rules with guards over pages.

Tables come as one row each: the report's keys, ``page``, ``table`` (their order in the report) and ``rows``, an array of
arrays of cells of any lengths. Facts carry the page and the text they were read from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.evidence import QUESTION, REPORT_KINDS, UNCERTAIN, first_column
from docstrata.functions.text import collapse

# Words of table headers, units, and words that exclude a table, by role.
NAMES = ["名称", "货物名称", "物料名称", "原料名称", "材料名称", "物质名称", "污染物"]
QUANTITIES = ["数量", "年用量", "用量", "年消耗", "消耗量", "最大贮存量", "最大存在量", "贮存量", "存在量"]
UNITS = ["单位"]
DISTANCES = ["距离", "距厂界", "最近距离", "方位及距离", "相对方位及距离"]
NOT_MATERIALS = ["指标名称", "项目", "工程内容", "污染物名称", "设备名称"]
RISK_NAMES = ["物质名称", "名称", "危险物质"]
RISK_QUANTITIES = ["最大贮存量", "最大存在量", "贮存量", "存在量", "数量"]
RISK_LIMITS = ["临界量"]
TARGET_NAMES = ["名称", "保护目标", "敏感目标", "保护对象"]
HEADER_UNIT = r"(万\s*t/a|t/a|t·a|吨/年|吨/小时|t/h|万\s*m3/a|m3/a|Nm3/h|万\s*kWh/a|kWh/a|万\s*立方米/年|立方米/年|吨|万\s*吨|台|套|个|只|头|羽|亩|kW|MW)"
MATERIAL_NAMES = r"货物名称|物料名称|原料名称|材料名称|原辅料"
CONSUMPTION = r"消耗|用量"
ONLY_FIGURES = r"^[\d.\s%\-—/]+$"
AIR_TARGETS = r"花园|小区|村|庄|居民|学校|医院|疗养|镇|社区|苑|城|府|公寓|宿舍|幼儿园|敬老|安置|自然村|组"
NATURE_TARGETS = r"天然林|公益林|保护区|湿地|河流|水库|林场|风景区|水源|基本农田|流域|湖泊|公园"
COVER_MARK = r"环境影响报告(书|表)"
NOT_TITLES = r"公示|报批稿|送审稿|建设单位|编制单位|二〇|20\d\d年|工程内容"
BASIC_LABELS = [("项目名称", "project"), ("建设项目名称", "project"), ("建设单位", "owner"), ("建设单位名称", "owner"), ("行业类别", "industry"), ("建设地点", "place")]
NOT_VALUES = r"^(工程内容|项目名称|建设单位|行业类别)$"
INDUSTRY = r"行业类别[^\n]{0,6}[：:]?\s*([^\n]{2,50})"
FILE_LEAD = r"^(公示版-|公示稿-|\d+、)"
CATALOG_LABELS = [("行业类别（分类管理名录）", "catalog"), ("行业类别(分类管理名录)", "catalog"), ("建设项目行业类别", "catalog"), ("行业类别", "stated_industry"), ("国民经济行业类别", "economy")]
CATALOG_PATTERNS = [r"[^。]{0,40}(?:属于|归入|列入)[^。]{0,120}", r"[^。]{0,40}(?:对照|根据|依据)[^。]{0,20}《建设项目环境影响评价分类管理名录》[^。]{0,120}", r"《分类管理名录》[^。]{0,120}"]
CATALOG_NEEDS = [r"分类管理名录", r"[一二三四五六七八九十]{1,3}、|\d{2,3}\s*(项|条)", r"属于|归入|列入|对照|根据|依据"]
AIR_INPUT = "厂界外500米内是否有环境空气保护目标"
INPUT_RULES = [
    (AIR_INPUT, r"厂界外\s*500\s*m?\s*(?:范围)?内[^。\n]{0,20}(无|没有|不存在)", False),
    (AIR_INPUT, r"500\s*m\s*(?:范围)?内[^。\n]{0,20}(无|没有|不存在)(环境空气)?保护目标", False),
    (AIR_INPUT, r"(厂界外\s*)?500\s*m\s*(?:范围)?内有[^。\n]{0,40}(保护目标|居民|村庄|居住区)", True),
    ("废水是否直排", r"(废水|污水)[^。\n]{0,12}是否[^。\n]{0,10}(?:直排|排入)[^。\n]{0,6}[:：]?\s*(?:否|不是|无|没有|未|不)", False),
    ("废水是否直排", r"(废水|污水)[^。\n]{0,20}(?:直排|直接排入|排入)[^。\n]{0,8}[:：，,、\s|]*(?:否|不是|无|没有|未)", False),
    ("废水是否直排", r"(废水|污水)[^。\n]{0,20}(?<!非)(?<!不)(?<!未)(?<!无)(直排|直接排入)", True),
    ("废水是否直排", r"(废水|污水)[^。\n]{0,20}(?:非|不|未|没有|无)\s*(?:直接)?(?:直排|排入)", False),
    ("废水是否直排", r"(废水|污水)[^。\n]{0,30}(不直接排放|不外排|零排放|全部回用|循环使用|纳管|回用)", False),
    ("废水是否直排", r"(废水|污水)[^。\n]{0,30}(排入|纳入|接入|接管)[^。\n]{0,20}(污水处理厂|污水厂|管网)", False),
    ("是否涉及集中式饮用水水源或特殊地下水资源保护区", r"不涉及[^。\n]{0,20}(饮用水水源|饮用水源|地下水资源保护区)", False),
    ("是否涉及集中式饮用水水源或特殊地下水资源保护区", r"(位于|涉及|临近)[^。\n]{0,20}(集中式饮用水水源|饮用水水源保护区|水源保护区)", True),
    ("是否涉及集中式饮用水水源或特殊地下水资源保护区", r"(矿泉水|温泉|地热水)[^。\n]{0,10}(水源|保护区|开采)", True),
    ("是否新增河道取水", r"不[^。\n]{0,8}(从|在)?[^。\n]{0,8}(河道|地表水|河流)[^。\n]{0,8}取水", False),
    ("是否新增河道取水", r"(由|从|依托)[^。\n]{0,20}(市政|自来水|自来水管网)[^。\n]{0,10}(供水|供水管网)", False),
    ("是否新增河道取水", r"新增[^。\n]{0,10}(河道|地表水)[^。\n]{0,6}取水", True),
    ("是否新增河道取水", r"取水口[^。\n]{0,20}(河道|河|地表水)", True),
]
# End of fixed values.

def header_unit(name: Column) -> Column:
    """The unit that stands in a column's name, without blanks; empty if none does."""
    return F.replace(F.regexp_extract(name, HEADER_UNIT, 1), F.lit(" "), F.lit(""))


def quantity(cell: Column) -> Column:
    """(value, unit) of the first number in a cell without thousands separators; ten thousands are multiplied out.

    What stands behind the number is the unit, with what stands before it unless that ends in a letter or an ideograph.
    Null without a number.
    """
    def parts(x: Column) -> Column:
        at = F.position(x["number"], x["plain"])
        return F.struct(x["number"].alias("number"), F.substring(x["plain"], F.lit(1), at - 1).alias("before"), F.substring(x["plain"], at + F.length(x["number"]), F.length(x["plain"])).alias("after"))

    def told(x: Column) -> Column:
        many = F.contains(x["before"], F.lit("万")) | F.contains(x["after"], F.lit("万"))
        both = (x["left"] != "") & ~x["left"].rlike("[\\u4e00-\\u9fffA-Za-z]$")
        unit = F.when(both, F.concat_ws(" ", x["left"], x["right"])).otherwise(x["right"])
        unit = F.when(many, collapse(F.replace(unit, F.lit("万"), F.lit("")))).otherwise(F.trim(unit))
        return F.when(x["number"] != "", F.struct((x["number"].cast("double") * F.when(many, 10000.0).otherwise(1.0)).alias("value"), unit.alias("unit")))

    found = _once(F.translate(cell, ",，", ""), lambda p: F.struct(p.alias("plain"), F.regexp_extract(p, r"[0-9]+(?:\.[0-9]+)?", 0).alias("number")))
    cut = _once(_once(found, parts), lambda x: F.struct(x["number"], x["before"], x["after"], collapse(x["before"]).alias("left"), collapse(x["after"]).alias("right")))
    return _once(cut, told)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _cell(row: Column, at: Column) -> Column:
    return collapse(F.coalesce(F.get(row, at.cast("int")), F.lit("")))


def _joined(row: Column, most: int) -> Column:
    texts = F.filter(F.transform(row, lambda c: collapse(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.substring(F.array_join(texts, " | "), 1, most)


def with_roles(tables: DataFrame, keys: list[str], roles: dict[str, list[str]], needed: list[str], merged: bool = False, carried: bool = False) -> DataFrame:
    """Tables with a column for each role: the first header column whose name holds one of the role's words, from 0, or null.

    The header is the first row and, for names that are split over two, the second one behind it; ``head`` has both,
    ``body`` the number of the first data row. A role found in the second row alone has no cells below it, as the rows
    aren't that long, unless ``merged``: then it stands for the column below it, both rows are header, and the names of a
    column are joined. With ``carried``, tables without the ``needed`` roles take them, and ``head``, from the table
    before if that is as wide and on the same or the page before, also over several tables; all their rows are data.
    """
    cells = lambda k: F.transform(F.coalesce(F.get("rows", F.lit(k)), F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))
    first, second = cells(0), cells(1)
    d = tables.withColumn("head", F.concat(first, second)).withColumn("_width", F.size(first))
    found = {r: first_column(F.col("head"), words) for r, words in roles.items()}
    d = d.withColumns({r: c.cast("int") for r, c in found.items()})
    own = reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in needed], F.lit(True))
    d = d.withColumn("body", F.lit(1))
    if merged:
        below = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) >= F.col("_width"), F.lit(False)) for r in roles])
        names = F.transform(first, lambda c, i: F.concat(c, F.coalesce(F.get(second, i), F.lit(""))))
        d = d.withColumn("body", F.when(below, 2).otherwise(1)).withColumn("head", F.when(below, names).otherwise(F.col("head")))
        d = d.withColumns({r: F.when(F.col(r) >= F.col("_width"), F.col(r) - F.col("_width")).otherwise(F.col(r)) for r in roles})
    if carried:
        w = Window.partitionBy(*keys).orderBy("page", "table")
        apart = own | F.coalesce((F.col("page") - F.lag("page").over(w) > 1) | (F.lag("_width").over(w) != F.col("_width")), F.lit(True))
        d = d.withColumn("_own", own).withColumn("_run", F.sum(apart.cast("int")).over(w))
        run = Window.partitionBy(*keys, "_run").orderBy("page", "table").rowsBetween(Window.unboundedPreceding, 0)
        taken = {c: F.first(c).over(run) for c in (*roles, "head", "_own")}
        before = d.withColumns({f"_{c}": x for c, x in taken.items()})
        carry = ~F.col("_own") & F.col("__own")
        d = before.withColumns({**{c: F.when(carry, F.col(f"_{c}")).otherwise(F.col(c)) for c in (*roles, "head")}, "body": F.when(carry, 0).otherwise(F.col("body"))})
        d = d.drop(*[f"_{c}" for c in taken], "_own", "_run")
        own = reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in needed], F.lit(True))
    return d.drop("_width").filter(own)


def near_anchor(tables: DataFrame, anchors: DataFrame, keys: list[str], radius: dict[str, int]) -> DataFrame:
    """Tables with ``near``: whether they are at most so many pages from the first page of an anchor.

    anchors: the keys, anchor and page; one row a report is joined, as long as the list of ``radius``.
    """
    wide = F.create_map(*[F.lit(x) for pair in radius.items() for x in pair])
    first = anchors.filter(F.col("anchor").isin(*radius)).groupBy(*keys, "anchor").agg(F.min("page").alias("page"))
    held = first.groupBy(*keys).agg(F.collect_list(F.struct("page", wide[F.col("anchor")].alias("radius"))).alias("_anchors"))
    near = F.exists("_anchors", lambda a: F.abs(F.col("page") - a["page"]) <= a["radius"])
    return tables.join(held, keys, "left").withColumn("near", F.coalesce(near, F.lit(False))).drop("_anchors")


def _rows(chosen: DataFrame, keys: list[str], least: list[str]) -> DataFrame:
    """The data rows of tables, those long enough for the roles ``least``, in order."""
    d = chosen.withColumn("header", _joined(F.get("rows", F.lit(0)), 120))
    d = d.select("*", F.posexplode("rows").alias("_row", "_cells")).filter(F.col("_row") >= F.col("body"))
    for r in least:
        d = d.filter(F.size("_cells") > F.col(r))
    return d.withColumn("quote", _joined(F.col("_cells"), 200))


def _read(rows: DataFrame, **cells: Column) -> DataFrame:
    """Data rows with what is read from their cells, by a generator: filters on it don't have the cells read again."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(f"_{k}") for k, c in cells.items()]))).alias("_read")).select("*", "_read.*").drop("_read")


def _first_tables(found: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order, "page", "table")
    return found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most)


def _prefer_near(found: DataFrame, keys: list[str]) -> DataFrame:
    """Tables near an anchor; of reports without any, all."""
    some = F.max("near").over(Window.partitionBy(*keys))
    return found.withColumn("_some", some).filter(F.col("near") | ~F.col("_some")).drop("_some")


def materials(tables: DataFrame, anchors: DataFrame, keys: list[str], most_tables: int = 6, **header: bool) -> DataFrame:
    """Materials by name, each name once: name, quantity, unit, page, quote and header.

    A table counts if it has a name column that isn't that of another kind of table, a quantity column, and a unit
    column or a unit in the quantity's name. Tables near the anchors of raw materials or products go before all others;
    of these the ``most_tables`` most alike to such a table, then by page. The unit is that of the row, else what stands
    behind the number, else that of the header.
    """
    d = with_roles(tables, keys, {"name": NAMES, "qty": QUANTITIES, "unit_at": UNITS}, ["name", "qty"], **header)
    d = d.withColumn("_name_head", F.get("head", F.col("name"))).withColumn("_unit_head", header_unit(F.get("head", F.col("qty"))))
    d = d.filter(~reduce(lambda a, b: a | b, [F.contains("_name_head", F.lit(x)) for x in NOT_MATERIALS]))
    d = d.filter(F.col("unit_at").isNotNull() | (F.col("_unit_head") != ""))
    alike = F.when(F.col("name") <= 1, 1).otherwise(0) + F.when(F.col("_name_head").rlike(MATERIAL_NAMES), 3).otherwise(0) + F.when(F.array_join("head", " ").rlike(CONSUMPTION), 2).otherwise(0)
    d = near_anchor(d.withColumn("_alike", alike), anchors, keys, {"原辅材料": 2, "产品方案": 1})
    d = _rows(_first_tables(_prefer_near(d, keys), keys, [F.col("_alike").desc()], most_tables), keys, ["name", "qty"])
    d = _read(d, named=_cell(F.col("_cells"), F.col("name")), amount=quantity(F.get("_cells", F.col("qty"))), unit=F.when(F.col("unit_at").isNotNull(), _cell(F.col("_cells"), F.col("unit_at"))))
    unit = F.coalesce(F.nullif("_unit", F.lit("")), F.nullif("_amount.unit", F.lit("")), F.col("_unit_head"))
    d = d.select(*keys, "_rank", "_row", F.col("_named").alias("name"), F.col("_amount.value").alias("quantity"), unit.alias("unit"), "page", "quote", "header")
    d = d.filter((F.length("name") >= 2) & ~F.contains("name", F.lit("序号")) & ~F.contains("name", F.lit("名称")) & ~F.col("name").rlike(ONLY_FIGURES))
    once = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("_rank", "_row"))
    return d.withColumn("_once", once).filter("_once = 1").drop("_once", "_rank", "_row")


def risk_materials(tables: DataFrame, keys: list[str], most_tables: int = 4, **header: bool) -> DataFrame:
    """Rows of the first tables with names and quantities that also have a threshold: name, quantity, threshold, page, quote, header."""
    d = with_roles(tables, keys, {"any_name": NAMES, "any_qty": QUANTITIES, "name": RISK_NAMES, "qty": RISK_QUANTITIES, "limit": RISK_LIMITS}, ["any_name", "any_qty"], **header)
    d = _first_tables(d, keys, [], most_tables).filter(F.col("name").isNotNull() & F.col("qty").isNotNull() & F.col("limit").isNotNull())
    d = _rows(d, keys, ["name", "qty", "limit"])
    at = lambda c: quantity(F.get("_cells", F.col(c)))["value"]
    d = _read(d, named=_cell(F.col("_cells"), F.col("name")), quantity=at("qty"), threshold=at("limit"))
    d = d.select(*keys, "table", F.col("_row").alias("row"), F.col("_named").alias("name"), F.col("_quantity").alias("quantity"), F.col("_threshold").alias("threshold"), "page", "quote", "header")
    return d.filter((F.length("name") >= 2) & ~F.contains("name", F.lit("序号")))


def targets(tables: DataFrame, anchors: DataFrame, keys: list[str], most_tables: int = 3, most_rows: int = 60, **header: bool) -> DataFrame:
    """Protected places of the first tables with names and distances, those near their anchor if there are any.

    name, distance, stated, page, quote and place, the row's number among the report's ``most_rows``.
    """
    d = with_roles(tables, keys, {"any_name": NAMES, "name": TARGET_NAMES, "dist": DISTANCES}, ["any_name", "dist"], **header)
    d = _first_tables(_prefer_near(near_anchor(d, anchors, keys, {"环境敏感目标": 2}), keys), keys, [], most_tables)
    d = _rows(d, keys, ["name", "dist"])
    d = _read(d, named=_cell(F.col("_cells"), F.col("name")), distance=quantity(F.get("_cells", F.col("dist")))["value"], stated=_cell(F.col("_cells"), F.col("dist")))
    d = d.select(*keys, "_rank", "_row", F.col("_named").alias("name"), F.col("_distance").alias("distance"), F.col("_stated").alias("stated"), "page", "quote")
    d = d.filter((F.col("name") != "") & ~F.contains("name", F.lit("序号")) & ~F.contains("name", F.lit("名称")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", "_row"))
    return d.withColumn("place", place).filter(F.col("place") <= most_rows).drop("_rank", "_row")


def air_targets(found: DataFrame, keys: list[str], within: float = 500.0, enough: int = 3) -> DataFrame:
    """Whether a report has people near: true with the nearest place within reach, false if ``enough`` lie all beyond it.

    One row a report that tells: value, page and quote of the nearest place (the first of equal ones), method table.
    """
    d = found.filter(F.col("distance").isNotNull() & F.col("name").rlike(AIR_TARGETS) & ~F.col("name").rlike(NATURE_TARGETS))
    d = d.groupBy(*keys).agg(F.min(F.struct("distance", "place", "page", "quote")).alias("n"), F.count(F.lit(1)).alias("known"))
    d = d.filter((F.col("n.distance") <= within) | (F.col("known") >= enough))
    return d.select(*keys, (F.col("n.distance") <= within).alias("value"), F.col("n.page").alias("page"), F.col("n.quote").alias("quote"), F.lit("table").alias("method"))


def labelled(tables: DataFrame, keys: list[str], labels: list[tuple[str, str]], least: int = 3, leading: bool = False, refused: str = "^$", most_tables: int | None = None, most_rows: int | None = None) -> DataFrame:
    """What stands behind labels in tables: for each key the first row, and there the first label, that gives a value.

    labels: (label, key) in order. The value is the first cell of ``least`` characters behind the first one that holds
    the label, with ``leading`` only where that is the row's first, and unless the pattern ``refused`` fits it. Every row
    is looked at once for all labels; with limits, those of the first tables and their first rows. Columns: key, value,
    page, quote, method.
    """
    if most_tables is not None:
        tables = _first_tables(tables, keys, [], most_tables)
    rows = tables.select(*keys, "page", "table", F.posexplode("rows").alias("row", "cells"))
    if most_rows is not None:
        rows = rows.filter(F.col("row") < most_rows)
    rows = rows.withColumn("cells", F.transform("cells", lambda c: collapse(F.coalesce(c, F.lit("")))))

    def one(k: int, label: str, key: str) -> Column:
        at = first_column(F.col("cells"), [label])
        at = F.when(at == 0, at) if leading else at
        value = F.get(F.filter(F.slice("cells", at + 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.length(c) >= least), F.lit(0))
        return F.when(at.isNotNull() & ~value.rlike(refused), F.struct(F.lit(key).alias("key"), F.lit(k).alias("label"), value.alias("value")))

    found = F.filter(F.array(*[one(k, *x) for k, x in enumerate(labels)]), lambda x: x.isNotNull())
    hits = rows.withColumn("f", F.explode(found)).withColumn("quote", _joined(F.col("cells"), 200))
    best = hits.groupBy(*keys, "f.key").agg(F.min(F.struct("page", "table", "row", F.col("f.label").alias("label"), F.col("f.value").alias("value"), "quote")).alias("b"))
    return best.select(*keys, "key", "b.value", "b.page", "b.quote", F.lit("table").alias("method"))


def cover_title(pages: DataFrame, keys: list[str], marker: str = COVER_MARK, refused: str = NOT_TITLES, first_pages: int = 3) -> DataFrame:
    """The line above the first line with the marker on the cover pages, if it has 4 to 60 characters and isn't refused.

    A line whose neighbour above is unfit is passed over. Columns: value, page, quote (up to two lines before and itself).
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: collapse(x)), lambda x: x != "")
    d = pages.filter(F.col("page") <= first_pages).select(*keys, "page", lines.alias("lines"))
    above = lambda i: F.get("lines", i - 1)
    fits = lambda x, i: (i > 0) & x.rlike(marker) & F.length(above(i)).between(4, 60) & ~above(i).rlike(refused)
    begin = lambda i: F.greatest(i - 2, F.lit(0))
    found = F.transform("lines", lambda x, i: F.when(fits(x, i), F.struct(above(i).alias("value"), F.array_join(F.slice("lines", begin(i) + 1, i - begin(i) + 1), " ").alias("quote"))))
    d = d.withColumn("f", F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))).filter("f IS NOT NULL")
    best = d.groupBy(*keys).agg(F.min(F.struct("page", "f")).alias("b"))
    return best.select(*keys, "b.f.value", "b.page", "b.f.quote")


def self_reference(pages: DataFrame, keys: list[str], patterns: list[str], needs: list[str], most: int = 4) -> DataFrame:
    """The first hit, by pattern, page and place, that all of ``needs`` fit, among the ``most`` first ones of each pattern.

    One row a report with such a hit: value, page. The pages are read once for all patterns.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def placed(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("i"), collapse(h).alias("hit")))

    hits = F.flatten(F.array(*[placed(k, p) for k, p in enumerate(patterns)]))
    d = pages.select(*keys, "page", F.explode(hits).alias("h")).select(*keys, "page", "h.*")
    w = Window.partitionBy(*keys, "k").orderBy("page", "i")
    d = d.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    for p in needs:
        d = d.filter(F.col("hit").rlike(p))
    best = d.groupBy(*keys).agg(F.min(F.struct("k", "page", "i", "hit")).alias("b"))
    return best.select(*keys, F.col("b.hit").alias("value"), "b.page")


def basic_fields(pages: DataFrame, tables: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """What a report is and is about: one row a report and key with value, page, quote and method.

    The kind is the one whose phrase stands most often on the first eight pages. The project is named by the cover, else
    by a table, else by the file; the industry by a table, else by the text. names: the keys and ``file``.
    """
    cover = pages.filter(F.col("page") <= 8)
    phrases = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(kind).alias("kind"), F.lit(p).alias("phrase")) for k, (kind, p) in enumerate(REPORT_KINDS)])
    counts = cover.select(*keys, "page", F.explode(F.transform(phrases, lambda p: F.struct(p["order"].alias("order"), p["kind"].alias("kind"), p["phrase"].alias("phrase"), F.regexp_count(F.coalesce("text", F.lit("")), p["phrase"]).alias("n")))).alias("c")).filter("c.n > 0")
    counts = counts.groupBy(*keys, "c.kind", "c.phrase", "c.order").agg(F.sum("c.n").alias("n"), F.min("page").alias("page"))
    kind = counts.groupBy(*keys).agg(F.max_by(F.struct("kind", "page", "phrase"), F.struct("n", "order")).alias("b"))
    kind = kind.select(*keys, F.lit("kind").alias("key"), "b.kind", "b.page", F.concat(F.lit("封面出现『"), "b.phrase", F.lit("』")), F.lit("regex"), F.lit(0))
    titles = cover_title(pages, keys).select(*keys, F.lit("project"), "value", "page", "quote", F.lit("cover"), F.lit(0))
    cells = labelled(tables, keys, BASIC_LABELS, least=2, leading=True, refused=NOT_VALUES, most_tables=12, most_rows=25)
    cells = cells.select(*keys, "key", "value", "page", "quote", "method", F.lit(1))
    industry = rule_hits(pages.filter(F.col("page") <= 40), keys, [("industry", INDUSTRY, None)], around=0)
    industry = industry.select(*keys, "key", F.trim(F.regexp_extract("quote", INDUSTRY, 1)), "page", "quote", F.lit("regex"), F.lit(2))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", ""), FILE_LEAD, "")
    files = names.select(*keys, F.lit("project"), stem, F.lit(1), F.concat(F.lit("文件名："), F.regexp_extract("file", r"([^/]*)$", 1)), F.lit("filename"), F.lit(3))
    all_of = kind
    for x in (titles, cells, industry, files):
        all_of = all_of.union(x)
    all_of = all_of.toDF(*keys, "key", "value", "page", "quote", "method", "order")
    best = all_of.groupBy(*keys, "key").agg(F.min(F.struct("order", "value", "page", "quote", "method")).alias("b"))
    return best.select(*keys, "key", "b.value", "b.page", "b.quote", "b.method")


def rule_hits(pages: DataFrame, keys: list[str], rules: list[tuple[str, str, object]], around: int = 80) -> DataFrame:
    """The first hit of each rule by report: rule (its number), key, page, and the hit with so many characters around it.

    rules: (key, pattern, value). All rules are tried on a page in one pass over the pages. A page's hit is cut out there,
    so what is shuffled is one short text a report, rule and partition.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    # where each rule hits is worked out once a page; only pages with a hit are searched again for what to cut out
    places = F.array(*[F.regexp_instr(text, F.lit(p)) for _, p, _ in rules])
    at = pages.select(*keys, "page", text.alias("text"), F.posexplode(places).alias("rule", "at")).filter(F.col("at") > 0)
    hit = F.coalesce(*[F.when(F.col("rule") == k, F.regexp_substr("text", F.lit(p))) for k, (_, p, _) in enumerate(rules)])
    at = at.select(*keys, "page", "text", "rule", "at", F.explode(F.array(F.length(hit))).alias("long")).filter("long IS NOT NULL")
    begin = F.greatest(F.col("at") - around, F.lit(1))
    cut = collapse(F.substring("text", begin, F.col("at") - begin + F.col("long") + around))
    named = F.get(F.array(*[F.lit(key) for key, _, _ in rules]), F.col("rule"))
    hits = at.select(*keys, "page", F.struct("rule", named.alias("key"), cut.alias("quote")).alias("f"))
    first = hits.groupBy(*keys, F.col("f.rule").alias("rule"), F.col("f.key").alias("key")).agg(F.min(F.struct("page", "f.quote")).alias("h"))
    return first.select(*keys, "rule", "key", "h.page", "h.quote")


def findings(pages: DataFrame, keys: list[str], rules: list[tuple[str, str, object]], guards: tuple[str, ...] = (UNCERTAIN, QUESTION), around: int = 80) -> DataFrame:
    """For each report and key the value of its first rule, in their order, whose first hit no guard fits.

    A guard tells of a hit that asks or doubts instead of stating; then the rule doesn't count, whatever other hits it
    has. Columns: key, value (string), page, quote, method (regex).
    """
    hits = rule_hits(pages, keys, rules, around)
    for g in guards:
        hits = hits.filter(~F.col("quote").rlike(g))
    values = F.array(*[F.lit(str(v).lower() if isinstance(v, bool) else v).cast("string") for _, _, v in rules])
    best = hits.groupBy(*keys, "key").agg(F.min(F.struct("rule", "page", "quote")).alias("b"))
    return best.select(*keys, "key", F.get(values, F.col("b.rule")).alias("value"), "b.page", "b.quote", F.lit("regex").alias("method"))


def overridden(by_text: DataFrame, by_table: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of both, those of tables in place of those of texts where both have a report's key: key, value, page, quote, method."""
    columns = [*keys, "key", "value", "page", "quote", "method"]
    both = by_text.select(*columns, F.lit(1).alias("_of")).unionByName(by_table.select(*columns, F.lit(0).alias("_of")))
    best = both.groupBy(*keys, "key").agg(F.min(F.struct("_of", "value", "page", "quote", "method")).alias("b"))
    return best.select(*keys, "key", "b.value", "b.page", "b.quote", "b.method")


# What glues, paints, solvents and those without are called, and the catalogue's terms for them.
GLUE = r"胶粘剂|胶黏剂|胶水|粘合剂|粘结剂|热熔胶|白乳胶"
PAINT = r"涂料|油漆|漆类|面漆|底漆"
SOLVENTS = r"乙酸乙酯|乙酸丁酯|醋酸丁酯|甲苯|二甲苯|丙酮|丁酮|环己酮|二氯甲烷|三氯乙烯|四氯乙烯|甲醇|乙醇|异丙醇|溶剂油|稀释剂|香蕉水|天那水"
SOLVENT_BASED = r"溶剂型|溶剂"
LOW_VOC = r"水性|非溶剂型|低\s*VOCs?|无溶剂|粉末涂料|UV\s*涂料"
TERMS = {"glue low": "非溶剂型低VOCs含量胶粘剂", "glue": "溶剂型胶粘剂", "paint low": "非溶剂型低VOCs含量涂料", "paint": "溶剂型涂料（含稀释剂）"}
PRODUCT_TABLE = r"产品|规格|规模|建设内容|工程内容|产量"
# End of fixed values.


def mapped_terms(found: DataFrame, keys: list[str]) -> DataFrame:
    """Materials with the catalogue's term that they fall under, or why they fall under none: ``term`` and ``why``.

    found: the keys, name, quantity and quote. A material without a quantity counts for nothing. A glue is low in solvents
    if it or its row says so, else solvent-based if these say that or the report uses any solvent; a paint only if it
    says so itself. ``solvents`` are the report's, sorted.
    """
    own = F.concat(F.coalesce("name", F.lit("")), F.coalesce("quote", F.lit("")))
    blob = F.concat_ws(" ", "name", F.coalesce("quote", F.lit("")))
    used = F.array_sort(F.collect_set(F.when(own.rlike(SOLVENTS), F.col("name"))).over(Window.partitionBy(*keys)))
    glue, paint = F.coalesce(F.col("name").rlike(GLUE), F.lit(False)), F.coalesce(F.col("name").rlike(PAINT), F.lit(False))
    low, based = blob.rlike(LOW_VOC), blob.rlike(f"{SOLVENT_BASED}|{SOLVENTS}")
    d = found.withColumn("solvents", used)
    of_glue = F.when(low, TERMS["glue low"]).when(based | (F.size("solvents") > 0), TERMS["glue"])
    of_paint = F.when(low, TERMS["paint low"]).when(based, TERMS["paint"])
    d = d.withColumn("term", F.when(F.col("quantity").isNull(), None).when(glue, of_glue).when(paint, of_paint))
    why = F.when(F.col("quantity").isNull(), "no quantity").when(glue, "glue of unknown kind").when(paint, "paint of unknown kind").otherwise("no such term")
    return d.withColumn("why", F.when(F.col("term").isNull(), why))


def term_totals(mapped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a report uses of each term: total, the last unit given, and the number of its materials."""
    named = F.when(F.coalesce("unit", F.lit("")) != "", F.struct(*order))
    d = mapped.filter("term IS NOT NULL").groupBy(*keys, "term")
    return d.agg(F.sum("quantity").alias("total"), F.coalesce(F.max_by("unit", named), F.lit("")).alias("unit"), F.count(F.lit(1)).alias("materials"))


def project_digest(facts: DataFrame, tables: DataFrame, anchors: DataFrame, found: DataFrame, keys: list[str], most_rows: int = 14, most_lines: int = 120) -> DataFrame:
    """What a report is about in lines that stand on its pages, each with its page: keys and digest.

    First the facts (key order, value, page), then the tables near the products' anchor, if their header speaks of such,
    and near the materials' anchor: a header and up to ``most_rows`` rows each; then the first 20 materials. A report's
    lines are numbered by where they come from, so only ``most_lines`` of them are joined.
    """
    tag = lambda page, text: F.concat(F.lit("【第"), page.cast("string"), F.lit("页】"), text)
    told = facts.filter("value IS NOT NULL AND value != ''").select(*keys, F.lit(0).alias("part"), F.lit(0).alias("table"), F.col("order").cast("int").alias("line"), tag(F.col("page"), F.col("value")).alias("text"))
    parts = []
    for k, anchor in ((1, "产品方案"), (2, "原辅材料")):
        near = near_anchor(tables, anchors, keys, {anchor: 2}).filter("near")
        head = _joined_all(F.get("rows", F.lit(0)), 100)
        body = F.filter(F.transform(F.slice("rows", 2, most_rows), lambda r: F.substring(F.array_join(F.filter(F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))), lambda c: c != ""), "  "), 1, 150)), lambda x: x != "")
        d = near.select(*keys, "page", "table", head.alias("head"), body.alias("body")).filter(F.size("body") > 0)
        if k == 1:
            d = d.filter(F.col("head").rlike(PRODUCT_TABLE))
        parts.append(d.select(*keys, F.lit(k).alias("part"), (F.col("page") * 1_000_000 + F.col("table")).cast("int").alias("table"), F.posexplode(F.transform(F.concat(F.array("head"), F.col("body")), lambda x: tag(F.col("page"), x))).alias("line", "text")))
    w = Window.partitionBy(*keys).orderBy("page", "name")
    named = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 20)
    item = F.concat("name", F.lit(" "), F.coalesce(F.col("quantity").cast("string"), F.lit("None")), "unit", F.lit("（P"), F.col("page").cast("string"), F.lit("）"))
    summed = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", item.alias("t")))).alias("m"))
    last = summed.select(*keys, F.lit(3).alias("part"), F.lit(0).alias("table"), F.lit(0).alias("line"), F.concat(F.lit("原辅材料："), F.array_join(F.transform("m", lambda x: x["t"]), "；")).alias("text"))
    lines = told
    for x in (*parts, last):
        lines = lines.unionByName(x)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "table", "line"))
    lines = lines.withColumn("n", n).filter(F.col("n") <= most_lines)
    kept = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return kept.select(*keys, F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("digest"))


def _joined_all(row: Column, most: int) -> Column:
    """All cells of a row, empty ones too."""
    return F.substring(F.array_join(F.transform(row, lambda c: collapse(F.coalesce(c, F.lit("")))), " | "), 1, most)
