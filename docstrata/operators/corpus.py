"""Operators on document tables: chunks, duplicates, overlap with passages, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import strip


def chunks_of(text: Column, target: int = 500, most: int = 900, separator: str = "\n\n") -> Column:
    """Chunks of a text by paragraphs, as an array.

    Paragraphs are trimmed; empty ones are dropped. A paragraph is added to the chunk unless it would take it over
    ``target``: each one added counts two characters more than it has, the one that begins a chunk after an overflow
    counts as it is. One of ``most`` characters or more stands alone, cut every ``most`` characters. A Markdown table
    stands alone; one over ``most`` is cut between rows and each piece repeats the two heading lines.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator, -1), strip), lambda p: p != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("any"))

    def flushed(a: Column) -> Column:
        return F.when(a["any"], F.array_append(a["out"], a["cur"])).otherwise(a["out"])

    def state(out: Column, cur: Column, n: Column, some: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), n.cast("int").alias("n"), some.alias("any"))

    def step(a: Column, p: Column) -> Column:
        size = F.length(p)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        alone = F.concat(flushed(a), F.when(is_table(p), F.when(size <= most, F.array(p)).otherwise(table_pieces(p, most))).otherwise(pieces))
        over = a["any"] & (a["n"] + size > target)
        return (
            F.when(is_table(p) | (size >= most), state(alone, F.lit(""), F.lit(0), F.lit(False)))
            .when(over, state(flushed(a), p, size, F.lit(True)))
            .otherwise(state(a["out"], F.when(a["any"], F.concat(a["cur"], F.lit(separator), p)).otherwise(p), a["n"] + size + 2, F.lit(True)))
        )

    return F.aggregate(paragraphs, start, step, flushed)


def is_table(paragraph: Column) -> Column:
    """Whether the first line begins with a pipe and the second is a rule of pipes, dashes and colons."""
    return paragraph.rlike(r"^[ \t]*\|[^\n]*\n[ \t]*[|\-:][|\-: ]*(\n|$)")


def table_pieces(paragraph: Column, most: int) -> Column:
    """A long table cut between rows into pieces of about ``most`` characters, each under the heading lines."""
    lines = F.split(paragraph, "\n", -1)
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    base = F.length(head) + 2

    def step(a: Column, row: Column) -> Column:
        size = F.length(row) + 1
        cut = (a["n"] > 0) & (base + a["n"] + size > most)
        return F.when(cut, F.struct(F.array_append(a["out"], a["cur"]).alias("out"), row.alias("cur"), size.alias("n"))).otherwise(
            F.struct(a["out"].alias("out"), F.when(a["n"] > 0, F.concat(a["cur"], F.lit("\n"), row)).otherwise(row).alias("cur"), (a["n"] + size).alias("n"))
        )

    rows = F.aggregate(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["out"], a["cur"])).otherwise(a["out"]))
    return F.transform(rows, lambda r: F.concat(head, F.lit("\n"), r))


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row a chunk: id, chunk_index, text."""
    return docs.select(id_col, F.posexplode(chunks_of(F.col(text_col), **rules)).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def context_header(title: Column, standard: Column, kind: Column) -> Column:
    """``[title] standard kind`` of what there is; the kind 'standard' is left out."""
    shown = F.when(kind != "standard", F.nullif(kind, F.lit("")))
    return F.concat_ws(" ", F.concat(F.lit("【"), F.nullif(title, F.lit("")), F.lit("】")), F.nullif(standard, F.lit("")), shown)


def shared_grams(docs: DataFrame, passages: DataFrame, size: int, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Documents and passages with word n-grams in common: id, item, shared (distinct grams), share of the passage's.

    A gram is two hashes of its words' 64-bit hashes, 96 bits together; different grams meet once in some 10^19 pairs. Grams of
    documents meet those of passages in a join on the hashes; only what met is then told apart, so the work is linear in
    the text and repeats within one cost no more. Texts of fewer words than a gram, and null ones, share nothing.
    """
    def grams(t: DataFrame, key: str) -> DataFrame:
        words = F.split(F.lower(F.regexp_replace(F.trim(F.regexp_replace(text_col, r"[\x20\x09-\x0D]+", " ")), r"^ +| +$", "")), " ")
        w = t.select(F.col(key), F.transform(words, lambda x: F.xxhash64(x)).alias("w"))

        def hashed(i: Column) -> Column:
            g = F.slice("w", i, size)
            return F.struct(F.xxhash64(g).alias("a"), F.hash(g).alias("b"))

        g = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), hashed)
        return w.filter(F.size("w") >= size).select(key, F.explode(g).alias("gram")).select(key, "gram.a", "gram.b")

    p = grams(passages, item_col).distinct()
    total = p.groupBy(item_col).agg(F.count(F.lit(1)).alias("grams"))
    hits = grams(docs, id_col).join(p, ["a", "b"]).distinct().groupBy(id_col, item_col).agg(F.count(F.lit(1)).alias("shared"))
    return hits.join(total, item_col).select(id_col, item_col, "shared", F.round(F.col("shared") / F.col("grams"), 6).alias("share"))


def first_of_content(rows: DataFrame, content: Column, name: str) -> DataFrame:
    """Rows whose content no row with a smaller name has, with its SHA-1."""
    d = rows.withColumn("sha1", F.sha1(content))
    kept = d.groupBy("sha1").agg(F.min(name).alias(name))
    return d.join(kept, ["sha1", name], "left_semi")


def changed_rows(now: DataFrame, before: DataFrame, key: str, digest: str = "sha1") -> DataFrame:
    """Rows of ``now`` that ``before`` lacks, or has with other content."""
    return now.join(before.select(key, digest), [key, digest], "left_anti")


def running_lines(pages: DataFrame, page: str, line: str, share: float = 0.3, least: int = 8) -> DataFrame:
    """Lines that ``share`` of all pages have, ``least`` pages at least; a page counts once. line, pages, ratio."""
    total = pages.select(F.countDistinct(page).alias("total"))
    counts = pages.select(page, line).distinct().groupBy(line).agg(F.count(F.lit(1)).alias("pages"))
    out = counts.join(F.broadcast(total)).withColumn("ratio", F.round(F.col("pages") / F.col("total"), 6))  # of one row
    return out.filter((F.col("pages") >= least) & (F.col("pages") >= share * F.col("total"))).drop("total")


def url_key(url: Column) -> Column:
    """A page's address without scheme, leading www., m. or blog., query, fragment and trailing slash, in lower case."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z]+://", "")
    bare = F.regexp_replace(bare, r"^(www|m|blog)\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def keep_newest(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each key, and the rest."""
    d = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return d.filter(F.col("place") <= most), d.filter(F.col("place") > most)
