"""Column functions on quotes, cells, evidence, sources and audit texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN = "\u4e00-\u9fff"
# Cells that hold nothing, and what separates the fields of an anchor.
PLACEHOLDERS = ("—", "-", "－", "/", "无")
ANCHOR_BREAKS = r"[|｜、；;，,（）()\[\]【】\s]+"
# Numerals of hazard levels.
ROMAN = {"IV": "Ⅳ", "III": "Ⅲ", "II": "Ⅱ", "I": "Ⅰ", "IV+": "Ⅳ+", "iv": "Ⅳ", "iii": "Ⅲ", "ii": "Ⅱ", "i": "Ⅰ", "x": "Ⅹ"}
# Top folders of sources that bind, and states of documents that no longer do.
AUTHORITIES = ("生态环境标准规范", "生态环境法律法规", "环评导则")
ABOLISHED = ("已废止", "废止", "已失效", "已作废")
# Questions that ask for codes, for binding texts, and for cases.
CODE_QUESTION = r"(?i)(GB|HJ|DB)\s*[/T]*\s*\d{2,5}"
AUTHORITY_QUESTION = "限值|标准值|排放浓度|排放标准|评价等级|等级判定|适用范围|分类管理名录|名录|法律责任|罚款|处罚|有效期|是否有效|现行|作废|编制依据|技术导则|导则|防护距离|临界量|风险潜势|评价工作等级|判定依据|防渗要求|技术要求|标准要求|排放要求|指标要求|要求是什么|规定是什么|怎么规定"
CASE_QUESTION = "项目|工程|公司|有限公司|厂|案例|这家|该企业|建设内容|生产工艺|产污环节|防治措施|总投资|占地面积|环境影响报告书|环境影响报告表"
# Words of doubt, and questions that assert nothing.
UNCERTAIN = "无法判断|不能判断|无法确定|未抽到|未给出|待核实|需核实|不确定|未知|需人工确认|尚不明确|未明确"
QUESTION = r"是否[^。\n]{0,12}(直排|排入|取水|涉及|属于)[^。\n]{0,4}[?？]"
# Negations around a condition, in answers, and what amounts to one.
NEGATION = "(不|未|无|没有|不属于|不涉及|不采用|不使用|不含|不在)"
NEGATIVE_CUES = ("不新增", "不外排", "不涉及", "不属于", "不直排", "不设", "不会", "不需要", "没有", "未涉及", "无涉及", "非直排", "不产生", "不排放", "未建设", "未开工", "不在", "不占", "不排", "不存", "否", "无", "还没", "尚未", "未曾", "没开工", "未开工", "不是", "未批", "没建")
EQUIVALENT_CUES = ("纳管", "接管", "纳污水管", "进管网", "入管网", "排入园区", "园区污水处理厂", "市政管网", "污水管网", "依托现有污水处理", "送污水处理厂", "外送污水处理厂", "回用不外排", "全部回用", "循环使用不外排")
# Names of air pollutants, and what tells of a page on water.
POLLUTANTS = r"(非甲烷总烃|二噁英|氯化氢|氯气|氰化氢|氟化物|苯并\[a\]芘|颗粒物|二氧化硫|氮氧化物|硫化氢|氨(?!氮)|汞及其化合物|镉及其化合物|铅及其化合物|砷及其化合物|铬及其化合物|VOCs|挥发性有机物|甲苯|二甲苯|甲醛)"
WATER_STANDARD = r"GB\s*8978|GB\s*18918|GB\s*3544|GB\s*4287|GB\s*13458|GB\s*21900|GB\s*31962|GB\s*21523|DB\s*32\s*/\s*1072"
WATER_ONLY = "COD|化学需氧量|氨氮|总磷|总氮|BOD|生化需氧量|动植物油|石油类|悬浮物|粪大肠菌群|阴离子表面活性剂|色度|第一类污染物"
# Kinds of reports, in the order that ties follow.
REPORT_KINDS = (("报告书", "环境影响报告书"), ("报告表", "环境影响报告表"), ("登记表", "环境影响登记表"))


def squeezed(text: Column) -> Column:
    """The text without any blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def cell_text(cell: Column) -> Column:
    """A cell with single spaces, and none between Chinese characters."""
    one = F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")
    return F.trim(F.regexp_replace(one, rf"(?<=[{HAN}])\s+(?=[{HAN}])", ""))


def squeezed_find(text: Column, needle: Column) -> Column:
    """Where ``needle`` first stands in ``text`` if blanks don't count: begin and end, from 1, both included; null if it doesn't."""
    places = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(~c.rlike(r"^\s*$"), i + 1)), lambda i: i.isNotNull())
    p = F.position(squeezed(needle), squeezed(text))
    span = F.struct(F.get(places, p - 1).alias("begin"), F.get(places, p + F.length(squeezed(needle)) - 2).alias("end"))
    return F.when((p > 0) & (squeezed(needle) != ""), span)


def longest_fragment(page: Column, anchor: Column, least: int = 6) -> Column:
    """The longest piece of an anchor that stands on the page, the first of equal ones, else the whole if it does, else empty."""
    on_page = lambda x: F.contains(squeezed(page), squeezed(x))
    pieces = F.filter(F.split(anchor, ANCHOR_BREAKS), lambda x: (F.length(x) >= least) & on_page(x))
    best = F.aggregate(pieces, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(best != "", best).when((squeezed(anchor) != "") & on_page(anchor), anchor).otherwise("")


def quote_keywords(quote: Column, least: int = 4) -> Column:
    """Pieces of a quote most like its source: those with Chinese characters first, longer ones first; then the whole without blanks."""
    found = F.regexp_extract_all(quote, F.lit(f"[{HAN}0-9A-Za-z]{{{least},}}"), F.lit(0))
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((~x.rlike(f"[{HAN}]")).alias("z"), (-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    whole = F.when(F.length(squeezed(quote)) >= least, F.array(squeezed(quote))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(ranked, lambda r: r["x"]), whole)


def quote_cells(quote: Column) -> Column:
    """Cells of a table's row in a quote, parted by pipes, tabs or two blanks, without placeholders."""
    cells = F.transform(F.split(F.coalesce(quote, F.lit("")), r"[|｜\t]|\s{2,}"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.filter(cells, lambda c: (c != "") & ~c.isin(*PLACEHOLDERS))


def holds_cells(rows: Column, cells: Column) -> Column:
    """Whether a table's rows hold all cells of two characters or more: of three cells or more, two or more such."""
    need = F.filter(F.transform(cells, squeezed), lambda c: F.length(c) >= 2)
    flat = F.transform(rows, lambda r: squeezed(F.array_join(r, "")))
    return (F.size(cells) >= 3) & (F.size(need) >= 2) & F.forall(need, lambda c: F.exists(flat, lambda r: F.contains(r, c)))


def lead_names(category: Column) -> Column:
    """Names before the first bracket of a catalogue entry, without codes and leading words."""
    parts = F.split(F.regexp_extract(category, "^[^（(]*", 0), "[；;、，,]")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(F.regexp_replace(p, r"\s*\d{2,4}\*?\s*$", "")), "^(含|不含|其他)", "")))
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.rlike(r"\d"))


def pre_statements(text: Column) -> Column:
    """SELECT and WITH statements after their numbered headings, without a line of description."""
    starts = lambda x: F.upper(F.ltrim(x)).rlike("^(SELECT|WITH)")
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"前置\d*[：:]"), trim)
    bare = F.transform(parts, lambda p: trim(F.when(starts(F.substring_index(p, "\n", 1)), p).otherwise(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(""))))
    return F.filter(bare, starts)


def roman_level(text: Column) -> Column:
    """A hazard level in one spelling; what isn't one stays."""
    t, known = F.trim(F.coalesce(text, F.lit(""))), F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    return F.coalesce(known[t], known[F.upper(t)], t)


def differs(a: Column, b: Column, total: Column) -> Column:
    """Whether two sums differ by more than 0.005 and five hundredths of the total."""
    return F.abs(a - b) > F.greatest(F.lit(0.005), 0.05 * F.greatest(total, F.lit(1e-9)))


@F.pandas_udf(StringType())
def _general(x: pd.Series) -> pd.Series:
    return pd.Series(["%g" % v for v in x], dtype=object)


def general_format(x: Column) -> Column:
    """Six significant digits of the double's exact value, ties to even, without trailing zeros; with an exponent below 1e-4 and from 1e6 on."""
    # Java rounds the shortest decimal, ties up; so C's own format
    x = x.cast("double")
    return F.when(x.isNotNull(), _general(x))


def number_spellings(text: Column) -> Column:
    """Spellings of a number that mean the same: as it stands, as an integer if it is one, and in general format; none with an exponent for integers."""
    x = text.try_cast("double")
    whole = F.when(x == F.floor(x), F.floor(x).cast("string"))
    short = F.when(whole.isNull() | (F.abs(x) < 1e6), general_format(x))
    return F.array_distinct(F.filter(F.array(text, short, whole), lambda s: s.isNotNull()))


def first_column(header: Column, words: list[str]) -> Column:
    """Number of the first header cell that holds one of the words, from 0; null if none does."""
    has = lambda c: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    return F.get(F.filter(F.transform(header, lambda c, i: F.when(has(c), i)), lambda i: i.isNotNull()), F.lit(0))


def value_after(cells: Column, label: str) -> Column:
    """First cell of two characters or more behind the first one that holds the label."""
    at = F.get(F.filter(F.transform(cells, lambda c, i: F.when(F.contains(c, F.lit(label)), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.get(F.filter(F.transform(cells, lambda c, i: F.when((i > at) & (F.length(F.trim(c)) > 1), F.trim(c))), lambda c: c.isNotNull()), F.lit(0))


def is_authority(source: Column) -> Column:
    return F.coalesce(F.split_part(source, F.lit("/"), F.lit(1)).isin(*AUTHORITIES), F.lit(False))


def is_abolished(status: Column) -> Column:
    return F.coalesce(F.trim(status).isin(*ABOLISHED), F.lit(False))


def authority_need(question: Column) -> Column:
    """How many places binding texts get: 3 for questions on codes or rules, 1 for cases, else 2."""
    return F.when(question.rlike(CODE_QUESTION) | question.rlike(AUTHORITY_QUESTION), 3).when(question.rlike(CASE_QUESTION), 1).otherwise(2)


def asserts(snippet: Column) -> Column:
    """Whether a snippet states something: no doubt, no question."""
    return ~snippet.rlike(UNCERTAIN) & ~snippet.rlike(QUESTION)


def safe_path(source: Column) -> Column:
    """A Markdown path below the root, with plain slashes and none in front; null if it isn't one or leaves the root."""
    rel = F.regexp_replace(F.replace(F.trim(source), F.lit("\\"), F.lit("/")), "^/+", "")
    depth = F.aggregate(F.split(rel, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(0)).alias("low")))
    return F.when(F.lower(rel).endswith(".md") & (depth["low"] >= 0), rel)


def image_fault(url: Column, most: int) -> Column:
    """What is wrong with an image's data URL; null for none or a good one."""
    u = F.trim(url)
    return F.when(F.coalesce(url, F.lit("")) == "", None).when(~u.startswith("data:image/"), "format").when(~F.contains(u, F.lit(";base64,")), "encoding").when(F.length(u) > most, "size")


def embed_text(title: Column, description: Column, chunk: Column) -> Column:
    """A chunk with its title and description in front."""
    some = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    front = F.concat_ws(" ", F.concat(F.lit("【"), some(title), F.lit("】")), some(description))
    return F.when(front == "", chunk).otherwise(F.concat(front, F.lit("\n\n"), chunk))


def source_block(rank: Column, title: Column, standard: Column, kind: Column, issuer: Column, region: Column, status: Column, note: Column, text: Column) -> Column:
    """A hit as a block of a prompt: rank, title, what is known of the document in brackets, and its text."""
    some = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    state = F.concat(F.lit("时效状态："), some(status), F.coalesce(F.concat(F.lit(" —— "), some(note)), F.lit("")))
    known = F.concat_ws("，", some(standard), some(kind), F.concat(F.lit("发布："), some(issuer)), some(region), state)
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] 《"), F.coalesce(title, F.lit("")), F.lit("》"))
    return F.concat(head, F.when(known == "", "").otherwise(F.concat(F.lit("（"), known, F.lit("）"))), F.lit("\n"), F.coalesce(text, F.lit("")))


def node_name(node: Column, props: Column) -> Column:
    """The first of four properties that isn't empty, else the node's id."""
    return F.coalesce(*[F.nullif(props[k], F.lit("")) for k in ("name_zh", "full_name", "title", "name")], node)


def node_props(props: Column, most: int = 500) -> Column:
    """Properties that aren't empty, cut to ``most`` characters."""
    return F.transform_values(F.map_filter(props, lambda k, v: F.coalesce(v, F.lit("")) != ""), lambda k, v: F.left(v, F.lit(most)))


def suggested_name(node: Column, props: Column) -> Column:
    """A node's name for suggestions: that of an article is its document and number; empty without one."""
    name, parent, number = F.trim(node_name(node, props)), F.trim(F.coalesce(props["parent_doc"], F.lit(""))), F.trim(F.coalesce(props["article_no"], F.lit("")))
    return F.when((name != "") & (name != node), name).when((parent != "") & (number != ""), F.concat(F.lit("《"), parent, F.lit("》"), number)).otherwise(number)


def digest(texts: Column, sources: int = 4, most: int = 260) -> Column:
    """The first sources, each in one line and cut with an ellipsis."""
    line = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.transform(F.slice(texts, 1, sources), lambda t: F.when(F.length(line(t)) > most, F.concat(F.left(line(t), F.lit(most)), F.lit("…"))).otherwise(line(t)))


def citation_warning(missing: Column, most: int = 8) -> Column:
    """The sentence on citations without a source; empty if there are none."""
    more = F.when(F.size(missing) > most, F.concat(F.lit(" 等 "), F.size(missing).cast("string"), F.lit(" 项"))).otherwise("")
    items = F.array_join(F.slice(missing, 1, most), "、")
    text = F.concat(F.lit("\n\n⚠️【依据校验未通过】以下依据没有在本次检索到的资料中逐字出现，请人工核对后再对外使用："), items, more, F.lit("。（本条由系统自动校验生成，不代表正文其他内容有误。）"))
    return F.when(F.size(missing) > 0, text).otherwise("")


def negated(text: Column, condition: Column) -> Column:
    """Whether a negation stands up to 12 characters before the condition or up to 8 after it, in one sentence."""
    core = F.trim(F.regexp_replace(condition, "的+$", ""))
    quoted = F.concat(F.lit(r"\Q"), core, F.lit(r"\E"))
    before = F.regexp_like(text, F.concat(F.lit(NEGATION + r"[^。\n]{0,12}"), quoted))
    return (F.length(core) >= 3) & ~condition.startswith("其他") & (before | F.regexp_like(text, F.concat(quoted, F.lit(r"[^。\n]{0,8}" + NEGATION))))


def topic_words(name: Column) -> Column:
    """Words of a field's name that tell what it is about, and their pairs of characters."""
    bare = F.regexp_replace(name, "(是否|有无|有没有|新增|情况|的|了|为|是)", " ")
    words = F.filter(F.split(bare, r"[\s、，,（）()/]+"), lambda w: F.length(w) >= 2)
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), pairs(w)))))


def boolean_fault(value: Column, quote: Column, name: Column) -> Column:
    """Why a quote doesn't prove a yes or no: no quote, another topic, a negation for a yes, none for a no; null if it does."""
    q = squeezed(quote)
    holds = lambda cues: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(q, c))
    equal = F.regexp_like(q, F.lit("(?<![不未无非没否别])(" + "|".join(EQUIVALENT_CUES) + ")"))
    topics = topic_words(name)
    return F.when(q == "", "empty").when((F.size(topics) > 0) & ~F.exists(topics, lambda t: F.contains(q, t)), "topic").when(value & holds(NEGATIVE_CUES), "negated").when(~value & ~holds(NEGATIVE_CUES) & ~equal, "not negated")


def count_of(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def report_kind(cover: Column) -> Column:
    """The kind whose phrase stands most often on the cover pages, the first of equal ones; null without any."""
    best = F.array_max(F.array(*[F.struct(count_of(cover, p).alias("n"), F.lit(-k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, p) in enumerate(REPORT_KINDS)]))
    return F.when(best["n"] > 0, best["kind"])


def stated_set(answer: Column) -> Column:
    """Whether a report says that it sets an element: no, unless it says so outright; null if it says neither."""
    return F.when(answer.rlike("不设置|无|不开展|/") & ~answer.rlike("设置专项|需设置"), False).when(answer.rlike("设置"), True)


def applies(text: Column, all_of: Column, any_of: Column, and_any_of: Column, exclude_if: Column) -> Column:
    """Whether a text meets a condition of word lists: none excluded, all of one, and one of each other list that isn't empty."""
    has = lambda words: F.exists(words, lambda w: F.contains(text, w))
    none = lambda words: F.size(words) == 0
    return ~has(exclude_if) & F.forall(all_of, lambda w: F.contains(text, w)) & (none(any_of) | has(any_of)) & (none(and_any_of) | has(and_any_of))


# What doesn't count when a value is looked for in a text.
SIGNS = "[\\s，。、；：！？,.;:!?（）()\\[\\]【】《》\"'“”‘’\\-—~·]"


def leaf_faults(rows: DataFrame, keys: list[str], value: str, text: str, deepest: int = 6) -> DataFrame:
    """Which parts of a JSON value the text doesn't bear: keys, ok, and faults (path and reason, by path).

    Objects and lists are opened level by level as variants, all rows of a level at once, down to single values. A
    string must stand in the text, a number in one of its spellings; both without white space and signs. Booleans
    and empty strings need no evidence, null has none, nor has anything if the text is empty, or deeper than
    ``deepest``. A value that isn't JSON is one fault.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), SIGNS, "")
    spark = rows.sparkSession
    parsed = F.try_parse_json(F.col(value))
    level = rows.select(*keys, plain(F.col(text)).alias("_t"), parsed.alias("_v"), F.lit("").alias("_path"), F.lit(False).alias("_deep"))
    leaves = []
    for depth in range(deepest + 1):
        kind = F.schema_of_variant("_v")
        level = level.withColumn("_kind", F.coalesce(kind, F.lit("BROKEN")))
        open_ = F.col("_kind").rlike("^(OBJECT|ARRAY)")
        if depth == deepest:
            leaves.append(level.withColumn("_deep", open_))
            break
        leaves.append(level.filter(~open_))
        part = level.filter(open_).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        path = F.concat("_path", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("_path") == "", "").otherwise("."), "key")))
        level = part.select(*keys, "_t", F.col("value").alias("_v"), path.alias("_path"), "_deep")
    d = leaves[0].select(*keys, "_t", "_v", "_path", "_deep", "_kind")
    for x in leaves[1:]:
        d = d.unionByName(x.select(*keys, "_t", "_v", "_path", "_deep", "_kind"))
    said = F.variant_get("_v", "$", "string")
    number = F.col("_kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    fault = (
        F.when(F.col("_kind") == "BROKEN", "not JSON")
        .when(F.col("_deep"), "too deep")
        .when(F.col("_t") == "", "empty text")
        .when(F.col("_kind") == "BOOLEAN", None)
        .when(F.col("_kind") == "VOID", "null")
        .when(number, F.when(~F.exists(number_spellings(said), lambda s: F.contains("_t", s)), F.concat(F.lit("number "), said)))
        .when((plain(said) != "") & ~F.contains("_t", plain(said)), F.concat(F.lit("not said: "), F.substring(said, 1, 40)))
    )
    found = d.select(*keys, F.when(fault.isNotNull(), F.struct(F.col("_path").alias("path"), fault.alias("reason"))).alias("f"))
    told = found.groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("faults"))
    # an empty object or list has no leaf
    all_rows = rows.select(*keys).distinct().join(told, keys, "left").withColumn("faults", F.coalesce("faults", F.array().cast("array<struct<path:string,reason:string>>")))
    return all_rows.select(*keys, (F.size("faults") == 0).alias("ok"), "faults")
