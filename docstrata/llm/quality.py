"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

``measure`` adds the figures of each text. ``calibrate`` looks at labelled documents in each stratum (a language). The
cutoffs of all rules form one fixed sequence from mild to strict: each step makes one rule stricter by a step of its
grid. For each step it counts how many good documents all rules together reject. The exact binomial test must refute
that this rate is above ``risk``; the sequence ends at the first step where it can't, so no correction for the number
of steps is needed, and the level is divided among the strata. Of the certified steps the one that rejects most bad
documents is taken, the mildest among equals. So with probability 1 - ``delta`` no stratum loses more than ``risk`` of
its good documents. A stratum needs log(delta / strata) / log(1 - risk) good documents for a first step that loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
RISK, DELTA = 0.02, 0.05
#: Strata up to this many are sent to every task; beyond, Spark joins them.
SENT_STRATA = 10_000
#: Rule: (figure as SQL, +1 if high values are rejected and -1 if low ones are, cutoffs from mild to strict).
RULES = {
    "symbols": ("n_symbols / n_words", 1, (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", 1, (0.6, 0.45, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / n_words", 1, (0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / n_words", 1, (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("word_chars / n_words", -1, (2.0, 2.5, 3.0, 3.5, 4.0)),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, window: int) -> Column:
    """Words in windows of ``window`` words that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        """Each window covers the words from its own start, or from the end of the one before."""
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(placed, lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])))
        # get() is null outside of the array: null or true is true, null or false drops the row
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        total = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total["n"])

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (window - 1)), lambda i: F.xxhash64(F.slice(hashed, i, window)))

    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), covered)))


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has no words, lines or symbols and fails the base rules. Columns of ``docs`` with these
    names are replaced. Lines count if they hold a word. Windows are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words, held = _free("_words", docs.columns), _free("_lines", docs.columns)
    d = docs.withColumns({words: F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), held: lines})
    n = F.size(words).cast("long")
    d = d.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(held).cast("long"),
            "n_dup_lines": (F.size(held) - F.size(F.array_distinct(held))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(words), REPEAT_WINDOW),
        }
    ).drop(words, held)
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


#: The fixed sequence: (rule, number of its cutoff), the mildest cutoffs of all rules first.
STEPS = sorted(((r, k) for r, (_, _, cuts) in RULES.items() for k in range(len(cuts))), key=lambda x: (x[1], list(RULES).index(x[0])))


def _figure(rule: str) -> Column:
    """The rule's figure, signed so that high values are rejected; null where there is no word or line."""
    sql, sign, _ = RULES[rule]
    top, under = sql.split(" / ")
    return F.try_divide(F.col(top).cast("double"), F.col(under).cast("double")) * sign


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X ~ Binomial(n, p): the terms in logarithms, each from the one before."""
    import math

    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log(n - i + 1) - F.log(i) + odds
        high = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(a["total"] - high) + F.exp(term - high))).alias("total"))

    terms = F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(terms, F.struct(first.alias("term"), first.alias("total")), step)["total"])


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """One row a stratum: ``stratum`` and the cutoff of every rule at its certified step, null for rules not used yet.

    Strata in which no step is certified or catches a bad document have no row. A null stratum is one of its own.
    ``labels`` has doc_id and quality (1 good, 0 bad); null qualities don't count, and an id labelled both ways is bad.
    Documents that the base rules reject, or without a label, take no part. Without labels there is no row.
    """
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    step = F.least(*[_first_step(r) for r in RULES])
    figures = measured.filter(~F.col("base_failed")).select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("stratum"), step.alias("step"))
    held = figures.join(marks, "_id").select("stratum", "step", (F.col("_good") == 1).alias("good"))
    # a row a stratum and step leaves each task; all that follows is as small
    counts = held.groupBy("stratum", "step").agg(F.count_if("good").alias("lost"), F.count_if(~F.col("good")).alias("caught"))
    strata, so_far = Window.partitionBy("stratum"), Window.partitionBy("stratum").orderBy("step")
    counts = counts.withColumns({"n": F.sum("lost").over(strata), "strata": F.size(F.collect_set(F.struct("stratum")).over(Window.partitionBy()))})
    counts = counts.filter("step is not null").withColumns({"lost": F.sum("lost").over(so_far), "caught": F.sum("caught").over(so_far)})
    safe = F.when(F.col("lost") <= risk * F.col("n"), binomial_tail(F.col("lost"), F.col("n"), risk) <= delta / F.col("strata")).otherwise(False)
    certified = counts.withColumn("safe", F.min(safe).over(so_far)).filter("safe and caught > 0")
    best = certified.groupBy("stratum").agg(F.max_by("step", F.struct("caught", -F.col("step"))).alias("step"))
    return best.select("stratum", *[_cutoff(r).alias(r) for r in RULES])


def _first_step(rule: str) -> Column:
    """The first step of the sequence at which the rule rejects, null if none."""
    found, (_, sign, cuts) = F.lit(None).cast("int"), RULES[rule]
    for k in reversed(range(len(cuts))):
        found = F.when(_figure(rule) > sign * cuts[k], STEPS.index((rule, k))).otherwise(found)
    return found


def _cutoff(rule: str) -> Column:
    """The rule's cutoff at a step of the sequence, null before its first."""
    found = F.lit(None).cast("double")
    for k, cut in enumerate(RULES[rule][2]):
        found = F.when(F.col("step") >= STEPS.index((rule, k)), float(cut)).otherwise(found)
    return found


def verdict(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with kept: false for documents that fail the base rules or pass a certified cutoff of their stratum.

    Strata that ``cutoffs`` lacks lose nothing beyond the base rules; a null stratum is one of its own.
    """
    from docstrata.llm.store import materialize

    own = _free("_cutoffs", measured.columns)
    cutoffs = materialize(cutoffs.select(F.struct("stratum", *RULES).alias(own)), "cutoffs")
    few = cutoffs.count() <= SENT_STRATA
    d = measured.join(F.broadcast(cutoffs) if few else cutoffs, measured[stratum_col].eqNullSafe(F.col(own)["stratum"]), "left")
    strict = F.lit(False)
    for r, (_, sign, _) in RULES.items():
        strict = strict | F.coalesce(_figure(r) > sign * F.col(own)[r], F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~strict).drop(own)
