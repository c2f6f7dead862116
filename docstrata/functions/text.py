"""Text functions on columns: keys, codes, terms, normal forms. All are built-in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns whose results must agree with the reference.
DOC_SUFFIXES = (
    "环境影响报告书", "环境影响报告表", "环境影响报告", "环境影响评价",
    "环评报告书", "环评报告表", "环评报告", "环评书", "环评表",
    "报告书", "报告表", "全文", "全本", "文本", "终稿", "最终稿",
    "公示版", "公示稿", "送审版", "报批稿", "pdf版", "压缩版", "正文", "全本公示",
)
CODE_PATTERN = r"(?i)(GB|HJ|DB)\s*/?\s*T?\s*(\d{2,5})"
PUNCTUATION = r"[\s\u3000_\-—－–·．.,，。、:：;；()（）\[\]【】{}<>《》\"'`]+"

STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at either end, line feeds included."""
    return F.regexp_replace(c, STRIP, "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def doc_key(source: Column, suffixes: tuple[str, ...] = DOC_SUFFIXES, least: int = 6) -> Column:
    """One key for copies of a document: first path segment and the bare file name without copy marks and suffixes.

    The extension, a copy mark and a number in brackets go; then punctuation; then up to three suffixes, each only if
    ``least`` characters stay. At every round the first listed suffix that fits is taken.
    """
    s = F.regexp_replace(F.coalesce(source, F.lit("")), r"\.md$", "")
    s = F.regexp_replace(s, r"(?i)[\s_\-]*(\bcopy\b|副本|拷贝)\s*$", "")
    s = strip(F.regexp_replace(s, r"\s*[（(]\s*\d+\s*[）)]\s*$", ""))
    name = F.lower(F.regexp_replace(F.element_at(F.split(s, "/"), -1), PUNCTUATION, ""))
    for _ in range(3):
        name = F.transform(F.array(name), lambda n: _without_suffix(n, suffixes, least))[0]
    return F.concat(F.element_at(F.split(s, "/"), 1), F.lit("|"), name)


def _without_suffix(name: Column, suffixes: tuple[str, ...], least: int) -> Column:
    cut = name
    for suffix in reversed(suffixes):
        fits = name.endswith(suffix) & (F.length(name) - len(suffix) >= least)
        cut = F.when(fits, F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(cut)
    return cut


def corpus_of(source: Column) -> Column:
    """First path segment."""
    return F.element_at(F.split(F.coalesce(source, F.lit("")), "/"), 1)


def codes_in(text: Column, pattern: str = CODE_PATTERN, group: int = 2) -> Column:
    """Distinct numeric cores of the codes in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)))


def code_of(*candidates: Column, pattern: str = CODE_PATTERN, group: int = 2) -> Column:
    """First code of the first candidate that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit("")) for c in candidates])


def bigrams(text: Column, drop: str = r"[^\u4e00-\u9fff]") -> Column:
    """Distinct pairs of neighbouring characters after the characters of ``drop`` are removed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), drop, "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def question_key(text: Column) -> Column:
    """Cache key of a question: lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{P}]+", "")


def standard_number(text: Column) -> Column:
    """Upper case, without blanks, dashes of any kind and slashes."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[\s\-—–－―/]+", "")


def blank_free(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def folded(text: Column) -> Column:
    """Blank-free, with dashes, tildes and brackets of either width as one form."""
    return F.translate(F.regexp_replace(blank_free(text), r"[—–－―]", "-"), "～（）", "~()")


def normalize_body(text: Column) -> Column:
    """Markdown without pure image lines and trailing blanks; at most one empty line in a row; no white space at the ends."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n", -1), lambda x: ~x.rlike(r"^\s*!\[.*?\]\(.*?\)\s*$"))
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def snippet(text: Column, term: str | Column, context: int) -> Column:
    """The characters around the first place of ``term``, white space collapsed; null where it isn't found."""
    t = F.lit(term) if isinstance(term, str) else term
    at = F.locate(term, text) if isinstance(term, str) else F.instr(text, t)
    begin = F.greatest(at - context, F.lit(1))
    return F.when(at > 0, collapse(F.substring(text, begin, at + F.length(t) + context - begin)))


def safe_file_name(name: Column, ending: str = ".pdf", most: int = 200) -> Column:
    """Base name without control and reserved characters, with ``ending``; null if it is longer than ``most`` bytes."""
    base = F.regexp_replace(F.element_at(F.split(F.coalesce(name, F.lit("")), r"[/\\]"), -1), r'[\x00-\x1f<>:"|?*]', "")
    base = F.trim(base)
    whole = F.when(F.lower(base).endswith(ending), base).otherwise(F.concat(base, F.lit(ending)))
    return F.when((F.length(base) > 0) & (F.octet_length(whole) <= most), whole)


def covers_all(base: Column, text: Column) -> Column:
    """Whether every character of ``base`` occurs in ``text``."""
    return F.forall(F.split(base, ""), lambda c: F.contains(text, c))


def subsequence(short: Column, text: Column) -> Column:
    """Whether the characters of ``short`` stand in ``text`` in their order."""
    chars = F.filter(F.split(short, ""), lambda c: c != "")

    def step(at: Column, c: Column) -> Column:
        """The place after the next ``c``; 0 once one is missing."""
        return F.when(at > 0, F.coalesce(F.nullif(F.call_function("position", c, text, at), F.lit(0)) + 1, F.lit(0))).otherwise(at)

    return F.aggregate(chars, F.lit(1), step) > 0


def parse_number(text: Column) -> Column:
    """First decimal number, thousands separators removed; times 10,000 if 万 follows; null without a number."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[,，](?=\d{3})", "")
    value = F.nullif(F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return value * F.when(F.regexp_extract(t, r"-?\d+(?:\.\d+)?\s*(万)?", 1) == "万", 10000.0).otherwise(1.0)


# Commands and their signs, in the order in which they are replaced; text commands; raised characters.
SYMBOLS = (
    ("\\times", "×"), ("\\cdot", "·"), ("\\div", "÷"),
    ("\\leq", "≤"), ("\\le", "≤"), ("\\geq", "≥"), ("\\ge", "≥"),
    ("\\neq", "≠"), ("\\approx", "≈"), ("\\sim", "~"), ("\\pm", "±"),
    ("\\infty", "∞"), ("\\rightarrow", "→"), ("\\to", "→"),
    ("\\cdots", "…"), ("\\ldots", "…"), ("\\dots", "…"),
    ("\\alpha", "α"), ("\\beta", "β"), ("\\gamma", "γ"), ("\\delta", "δ"),
    ("\\mu", "μ"), ("\\rho", "ρ"), ("\\sigma", "σ"), ("\\lambda", "λ"),
    ("\\theta", "θ"), ("\\omega", "ω"), ("\\circ", "°"),
    ("\\%", "%"), ("\\&", "&"), ("\\_", "_"),
    ("\\quad", " "), ("\\qquad", " "), ("\\,", " "), ("\\;", " "),
    ("\\:", " "), ("\\!", ""), ("\\ ", " "), ("\\~", " "),
)
TEXT_COMMANDS = "mathrm|text|mathbf|mathit|mathsf|mathtt|operatorname|textbf|textit|mbox|textnormal"
SUPERSCRIPTS = ("0123456789-+", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺")


def latex_to_text(text: Column) -> Column:
    """A formula, with or without dollar signs around it, as plain text: text commands unwrapped, fractions, roots, powers and symbols; other commands and braces dropped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\$+|\$+$", "")
    t = F.regexp_replace(t, r"\\(?:left|right|displaystyle|textstyle|limits|nolimits)\b", "")
    t = F.regexp_replace(t, r"\^\s*\{\s*\\cdot\s*", "^{-")  # a minus that was read as a dot
    for _ in range(3):  # commands stand in each other
        t = F.regexp_replace(t, rf"\\(?:{TEXT_COMMANDS})\s*\{{([^{{}}]*)\}}", "$1")
    t = F.regexp_replace(t, r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "$1/$2")
    t = F.regexp_replace(t, r"\\sqrt\s*\{([^{}]*)\}", "√$1")
    t = F.regexp_replace(t, r"\^\s*\{([^{}]*)\}", "^$1")
    # the powers are mapped piece by piece: pieces with an end mark begin with what was raised
    t = F.regexp_replace(t, r"\^\s*(-?\d+)", "\u0001$1\u0002")
    pieces = F.transform(F.split(t, "\u0001", -1), lambda p: F.when(F.contains(p, F.lit("\u0002")), F.concat(F.translate(F.substring_index(p, "\u0002", 1), *SUPERSCRIPTS), F.substring_index(p, "\u0002", -1))).otherwise(p))
    t = F.regexp_replace(F.array_join(pieces, ""), r"_\s*\{([^{}]*)\}", "$1")
    t = F.replace(t, F.lit("~"), F.lit(" "))  # a blank that doesn't break
    for command, sign in SYMBOLS:
        t = F.replace(t, F.lit(command), F.lit(sign))
    return collapse(F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+\b", " "), "[{}]", ""))


def inline_formulas(text: Column) -> Column:
    """A text with its formulas between dollar signs, of up to 200 characters on a line, as plain text.

    Single dollar signs, commands outside of formulas and brackets with nothing left in them go; runs of blanks become one.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\$([^$\n]{1,200})\$", "\u0003$1\u0004")
    plain = lambda p: F.concat(F.lit(" "), latex_to_text(F.substring_index(p, "\u0004", 1)), F.lit(" "), F.substring_index(p, "\u0004", -1))
    pieces = F.transform(F.split(t, "\u0003", -1), lambda p: F.when(F.contains(p, F.lit("\u0004")), plain(p)).otherwise(p))
    t = F.replace(F.array_join(pieces, ""), F.lit("$"), F.lit(" "))
    for pattern, instead in ((r"\\[a-zA-Z]{2,}", " "), (r"[（(]\s*[）)]", ""), (r"[【\[]\s*[】\]]", ""), (r"[ \t]{2,}", " ")):
        t = F.regexp_replace(t, pattern, instead)
    return strip(t)


def markdown_row(cells: Column) -> Column:
    """A row of a Markdown table, with pipes escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def first_statement(sql: Column) -> Column:
    """First SELECT or WITH statement without comments, in one line; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    return F.nullif(collapse(F.regexp_extract(bare, r"(?is)\b((?:select|with)\b[^;]*)", 1)), F.lit(""))
