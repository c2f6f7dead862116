"""Tri-state rules, units, thresholds, cascades and verdicts. NULL is 'unknown' throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unit, dimension, factor to the dimension's base unit.
UNITS = (
    ("吨", "mass", 1.0), ("t", "mass", 1.0), ("t/a", "mass", 1.0), ("吨/年", "mass", 1.0), ("吨/日", "mass", 1.0), ("吨/小时", "mass", 1.0),
    ("万吨", "mass", 1e4), ("千克", "mass", 1e-3), ("kg", "mass", 1e-3),
    ("立方米", "vol", 1.0), ("标立方米", "vol", 1.0), ("万立方米", "vol", 1e4), ("万标立方米", "vol", 1e4), ("万标立方米/年", "vol", 1e4),
    ("平方米", "area", 1.0), ("万平方米", "area", 1e4), ("亩", "area", 2000.0 / 3.0),
    ("头", "count", 1.0), ("万头", "count", 1e4), ("只", "count", 1.0), ("万只", "count", 1e4), ("羽", "count", 1.0), ("万羽", "count", 1e4),
    ("台", "count", 1.0), ("套", "count", 1.0),
    ("公里", "len", 1.0), ("km", "len", 1.0), ("米", "len", 1.0),
    ("千瓦", "power", 1.0), ("kW", "power", 1.0), ("兆瓦", "power", 1e3), ("MW", "power", 1e3), ("千伏", "volt", 1.0), ("kV", "volt", 1.0),
)


def kleene_any(c: Column) -> Column:
    """Aggregate OR: true if any row is, else null if any row is null, else false; null for no rows."""
    return F.when(F.max(c), True).when(F.count_if(c.isNull()) > 0, None).when(F.count(F.lit(1)) > 0, False)


def kleene_all(c: Column) -> Column:
    """Aggregate AND: false if any row is, else null if any row is null, else true; null for no rows."""
    return F.when(~F.min(c), False).when(F.count_if(c.isNull()) > 0, None).when(F.count(F.lit(1)) > 0, True)


def compare(value: Column, cmp: Column, threshold: Column) -> Column:
    """``value cmp threshold``; null if any is null or the comparator is unknown."""
    return F.when(cmp == ">=", value >= threshold).when(cmp == ">", value > threshold).when(cmp == "<=", value <= threshold).when(cmp == "<", value < threshold)


def converted(rows: DataFrame, units: DataFrame, value: str, unit: str, to: str, name: str) -> DataFrame:
    """``rows`` with ``value`` in the unit of column ``to``; null for unknown units or other dimensions.

    units: unit, dim, factor, a row a unit. Equal units need no table.
    """
    a = units.select(F.col("unit").alias("_ua"), F.col("dim").alias("_da"), F.col("factor").alias("_fa"))
    b = units.select(F.col("unit").alias("_ub"), F.col("dim").alias("_db"), F.col("factor").alias("_fb"))
    # a list of units is sent: merged, all rows of one unit would meet in one task
    d = rows.join(F.broadcast(a), rows[unit] == F.col("_ua"), "left").join(F.broadcast(b), F.col(to) == F.col("_ub"), "left")
    out = F.when(F.col(unit) == F.col(to), F.col(value)).when(F.col("_da") == F.col("_db"), F.col(value) * F.col("_fa") / F.col("_fb"))
    return d.withColumn(name, out).drop("_ua", "_da", "_fa", "_ub", "_db", "_fb")


def condition_results(facts: DataFrame, conditions: DataFrame, keys: list[str]) -> DataFrame:
    """Each condition's tri-state result on the facts of its keyword, in their order.

    facts: keys, keyword, ord, value (null if it can't be converted); conditions: cond, tier, keyword, cmp, threshold.
    The first fact that can't be converted makes the result unknown even if a later one satisfies it; so does having
    no fact at all.
    """
    # a rule list is sent; merged by keyword, all facts of one word would meet in one task. A subject's facts move once,
    # and what follows finds them in place
    rules = F.broadcast(conditions)
    d = facts.select(*keys, "keyword", "ord", "value").repartition(*keys)
    hit = compare(F.col("value"), F.col("cmp"), F.col("threshold"))
    met = d.join(rules, "keyword").select(*keys, "cond", "tier", F.lit(True).alias("met"), F.when(F.col("value").isNull(), F.col("ord")).alias("stop"), F.when(hit, F.col("ord")).alias("good"))
    every = d.select(*keys).distinct().crossJoin(F.broadcast(conditions.select("cond", "tier")))
    r = met.unionByName(every, allowMissingColumns=True).groupBy(*keys, "cond", "tier").agg(F.max("met").alias("met"), F.min("stop").alias("stop"), F.min("good").alias("good"))
    result = F.when(F.col("stop").isNull(), F.col("good").isNotNull()).when(F.col("good") < F.col("stop"), True)
    return r.select(*keys, "cond", "tier", F.when(F.col("met"), result).alias("result"))


def tiers(results: DataFrame, keys: list[str]) -> DataFrame:
    """Each tier's result, the OR of its conditions, and the tier decided: the first that is true or unknown.

    results: keys, tier (ordinal), result. decided is null if all tiers are false, and for a subject whose key is null;
    state tells true from unknown.
    """
    t = results.groupBy(*keys, "tier").agg(kleene_any(F.col("result")).alias("result"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.coalesce("result", F.lit(True)))
    state = F.coalesce(F.col("result").cast("string"), F.lit("unknown"))
    first = t.groupBy(*keys).agg(F.min(F.when(known, F.struct(F.col("tier").alias("decided"), state.alias("state")))).alias("f"))
    return first.select(*keys, "f.decided", "f.state")


def q_sum(items: DataFrame, keys: list[str], quantity: str = "quantity", threshold: str = "threshold") -> DataFrame:
    """Sum of quantity over threshold, items without either, and the Q class: null unless every item counts.

    Classes: 0 below 1, 1 below 10, 2 below 100, 3 from 100.
    """
    ratio = F.try_divide(F.col(quantity), F.col(threshold))
    d = items.groupBy(*keys).agg(F.round(F.sum(ratio), 6).alias("q"), F.count_if(ratio.isNull()).alias("lacking"), F.count(F.lit(1)).alias("items"))
    level = F.when(F.col("q") < 1, 0).when(F.col("q") < 10, 1).when(F.col("q") < 100, 2).otherwise(3)
    return d.withColumn("level", F.when((F.col("lacking") > 0) & F.coalesce(F.col("q") < 1, F.lit(True)), None).otherwise(level))


def over_threshold(items: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Whether any item of a subject exceeds its threshold; without items unknown, never false."""
    d = items.groupBy(key).agg(kleene_any(F.col("quantity") > F.col("threshold")).alias("over"))
    return subjects.join(d, key, "left")


def resolve(asked: DataFrame, table: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """Entries for names: by code, exact name, alias (as is, then upper, then lower case), then part of a name.

    asked: ask, code; table: ord, code, name; aliases: alias, name. Parts need ``least`` characters and the first entry
    in order wins; candidates share their first ``least`` characters somewhere in the name. Gives ask, code, ord, how.
    """
    q = asked.select("ask", "code").distinct()
    # of the entries of one code or name the first counts, so each is one row before it meets anything; merged, since
    # files that pack well look small enough to be sent
    codes = table.filter("code IS NOT NULL").groupBy("code").agg(F.min("ord").alias("ord"))
    names = table.filter("name IS NOT NULL").groupBy("name").agg(F.min("ord").alias("ord"))
    asks = q.select("ask").filter("ask IS NOT NULL").distinct()
    by_name = asks.join(names.hint("merge"), F.col("ask") == F.col("name")).select("ask", F.lit(1).alias("step"), "ord")
    forms = asks.select("ask", F.posexplode(F.array("ask", F.upper("ask"), F.lower("ask"))).alias("form", "alias"))
    by_alias = forms.join(aliases.hint("merge"), "alias").join(names.hint("merge"), "name").select("ask", (F.col("form") + 2).alias("step"), "ord")
    by_part = asks.filter(F.length("ask") >= least).withColumn("gram", F.substring("ask", 1, least))
    grams = names.filter(F.length("name") >= least).select("ord", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (least - 1)), lambda i: F.substring("name", i, F.lit(least))))).alias("gram"))
    by_part = by_part.join(grams.hint("merge"), "gram").filter(F.contains("name", F.col("ask"))).select("ask", F.lit(5).alias("step"), "ord")
    named = by_name.unionByName(by_alias).unionByName(by_part).groupBy("ask").agg(F.min(F.struct("step", "ord")).alias("b"))
    coded = codes.select("code", F.struct(F.lit(0).alias("step"), "ord").alias("c"))
    d = q.join(named.hint("merge"), "ask", "left").join(coded.hint("merge"), "code", "left").withColumn("b", F.coalesce("c", "b"))
    how = F.when(F.col("b").isNotNull(), F.element_at(F.array(*map(F.lit, ("code", "name", "alias", "alias", "alias", "part"))), F.col("b.step") + 1))
    return d.select("ask", "code", F.col("b.ord").alias("ord"), how.alias("how"))


#: Words of asked texts up to this number are sent to every task (some 10 MB); beyond, Spark shuffles both sides.
SENT_WORDS = 200_000


def catalog_scores(queries: DataFrame, items: DataFrame, least: int = 16, most: int = 5) -> DataFrame:
    """Best catalog entries of each query by words in common: len² a word, 60 a code; none if the best is below ``least``.

    queries: ask, terms (array); items: item, terms (array), codes (array). Words meet in a join, so pairs without one
    in common are never made. The entries stay where they are dealt: each task keeps the ``most`` best of each query.
    """
    q = queries.select("ask", F.explode(F.array_distinct("terms")).alias("term")).filter("term IS NOT NULL")
    none = F.array().cast("array<struct<term: string, points: int>>")
    words = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), (F.length(t) * F.length(t)).alias("points")))
    codes = F.transform(F.array_distinct("codes"), lambda t: F.struct(t.alias("term"), F.lit(60).alias("points")))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that what packs well isn't put into few tasks
    d = items.repartition(parts, "item").select("item", F.explode(F.concat(F.coalesce(words, none), F.coalesce(codes, none))).alias("w")).select("item", "w.term", "w.points")
    # files that pack well look small enough to be sent, so which side is sent is said here
    met = d.join(F.broadcast(q), "term") if q.count() <= SENT_WORDS else d.join(q.hint("merge"), "term")
    s = met.groupBy("ask", "item").agg(F.sum("points").cast("long").alias("score"))
    w = Window.partitionBy("ask")
    s = s.withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc(), "item"))).filter(F.col("place") <= most)
    best = s.withColumn("place", F.col("place").cast("long")).withColumn("_b", F.max("score").over(w))
    return best.filter(F.col("_b") >= least).drop("_b")


def suggested(features: DataFrame, standards: DataFrame, generic: tuple[str, ...], most: int) -> DataFrame:
    """Standards of each subject: 5 for a specific word in common, 1 for a generic one, and its citations up to 7.

    features: key, word; standards: code, word, citations.
    """
    hit = features.distinct().join(standards, "word").groupBy("key", "code").agg(F.sum(F.when(F.col("word").isin(*generic), 1).otherwise(5)).alias("w"), F.max("citations").alias("citations"))
    hit = hit.withColumn("score", (F.col("w") + F.least("citations", F.lit(7))).cast("long"))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "code")
    return hit.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most).select("key", "code", "score", "place")


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of two sources: a verified one wins, else the first; conflict if both are there and differ.

    a: key, value; b: key, value, verified.
    """
    x, y = a.select(key, F.col("value").alias("a")), b.select(key, F.col("value").alias("b"), "verified")
    d = x.join(y, key, "full_outer")
    value = F.when(F.coalesce("verified", F.lit(False)), F.coalesce("b", "a")).otherwise(F.coalesce("a", "b"))
    return d.select(key, value.alias("value"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts of (said, truth) booleans, precision and recall (null over zero), agreement and coverage.

    Rows whose truth is null count for coverage alone.
    """
    s, t = F.col("said"), F.col("truth")
    known = t.isNotNull()
    d = pairs.groupBy(*keys).agg(
        F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"), F.count_if(~s & ~t).alias("tn"),
        F.count_if(known).alias("judged"), F.count(F.lit(1)).alias("total"),
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 3)
    return d.select(*keys, "tp", "fp", "fn", "tn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("tp") + F.col("tn"), F.col("judged")).alias("agreement"), ratio(F.col("judged"), F.col("total")).alias("coverage"))


def upserted(base: DataFrame, edits: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """Items with their review: the human state if it is allowed and not empty, else the machine's, which stays as it is.

    base: key, state; edits: key, state, stamp; the latest edit of a key counts. Edits of unknown items are left out.
    """
    last = edits.filter(F.col("state").isin(*allowed)).groupBy(key).agg(F.max(F.struct("stamp", "state")).alias("e"))
    d = base.join(last, key, "left")
    return d.select(key, F.col("state").alias("machine"), F.col("e.state").alias("human"), F.coalesce(F.nullif(F.col("e.state"), F.lit("")), F.col("state")).alias("final"))


def round_robin(rows: DataFrame, kind: str, order: list[Column], most: int) -> DataFrame:
    """Rows one of each kind in turn: place, kinds in order of their names within a turn, ``most`` rows."""
    d = rows.withColumn("turn", F.row_number().over(Window.partitionBy(kind).orderBy(*order)).cast("long"))
    return d.orderBy("turn", kind).limit(most)  # the cut is the operator's own


def quota_buckets(rows: DataFrame, key: str, bucket: str, quotas: dict, fill: str, most: int, order: list[Column]) -> DataFrame:
    """Up to ``most`` rows a key: each bucket up to its quota, the bucket ``fill`` with what is left."""
    limit = F.coalesce(*[F.when(F.col(bucket) == b, F.lit(q)) for b, q in quotas.items()], F.lit(0))
    d = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)))
    d = d.filter((F.col(bucket) == fill) | (F.col("n") <= limit))
    rank = F.when(F.col(bucket) == fill, 1).otherwise(0)
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, bucket, *order)).cast("long"))
    return d.filter(F.col("place") <= most).drop("n")


def rising(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value is above all kept before; none of a key that keeps fewer than max(3, half its rows)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("_m", F.max(value).over(w)).withColumn("_k", F.coalesce(F.col(value) > F.col("_m"), F.col("_m").isNull()))
    all_rows = Window.partitionBy(*keys)
    d = d.withColumn("_n", F.count(F.lit(1)).over(all_rows)).withColumn("_s", F.count_if("_k").over(all_rows))
    return d.filter(F.col("_k") & (F.col("_s") >= F.greatest(F.lit(3), F.floor(F.col("_n") / 2)))).drop("_m", "_k", "_n", "_s")


def spans_without_overlap(spans: Column) -> Column:
    """Of (begin, end) spans, those taken going left to right, the longest first at a place, each after the last taken."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["begin"] != b["begin"], F.when(a["begin"] < b["begin"], -1).otherwise(1)).otherwise(F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)))
    none = F.filter(spans, lambda x: F.lit(False))
    start = F.struct(none.alias("out"), F.lit(0).alias("last"))
    return F.aggregate(ordered, start, lambda a, s: F.when(s["begin"] >= a["last"], F.struct(F.array_append(a["out"], s).alias("out"), s["end"].cast("int").alias("last"))).otherwise(a), lambda a: a["out"])


def nearest_target(rows: DataFrame, keys: list[str], distance: str, near: float = 500.0, enough: int = 3) -> DataFrame:
    """True if the nearest target is within ``near``; false if ``enough`` are known and all are beyond; else null."""
    d = rows.groupBy(*keys).agg(F.min(distance).alias("nearest"), F.count(distance).alias("known"))
    return d.withColumn("sensitive", F.when(F.col("nearest") <= near, True).when(F.col("known") >= enough, False))


def supported_sentences(sentences: DataFrame, facts: DataFrame) -> DataFrame:
    """Sentences with the reason to drop them, null to keep: numbers must be among the numbers of the facts referred to.

    sentences: key, k, text, refs (array of fact ids); facts: key, fact, numbers (array).
    """
    numbers = F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    s = sentences.withColumn("numbers", F.array_distinct(numbers))
    refs = s.select("key", "k", F.explode_outer("refs").alias("fact")).join(facts.withColumnRenamed("numbers", "known"), ["key", "fact"], "left")
    held = refs.groupBy("key", "k").agg(F.flatten(F.collect_list("known")).alias("known"), F.count_if(F.col("fact").isNotNull() & F.col("known").isNull()).alias("unknown"))
    d = s.join(held, ["key", "k"])
    reason = (
        F.when(F.col("unknown") > 0, "unknown reference")
        .when((F.size("numbers") > 0) & (F.size("refs") == 0), "number without reference")
        .when(F.size(F.array_except("numbers", "known")) > 0, "number not in facts")
    )
    return d.select("key", "k", reason.alias("reason"))
