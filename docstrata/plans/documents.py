"""Queries on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import corpus
from docstrata.operators.phrases import holding
from docstrata.plans.registry import register
from docstrata.sources.tables import spread, table

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents"


@register("chunk_paragraphs", f"""
WITH RECURSIVE p0 AS (SELECT doc_id, k, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS p FROM ({_LINES})),
p AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM p0 WHERE p <> ''),
w AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, false AS some, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS own FROM (SELECT DISTINCT doc_id FROM p)
  UNION ALL
  SELECT w.doc_id, p.i,
    CASE WHEN length(p.p) >= 900 THEN 0 WHEN w.some AND w.n + length(p.p) > 500 THEN length(p.p) ELSE w.n + length(p.p) + 2 END,
    length(p.p) < 900,
    CASE WHEN length(p.p) >= 900 THEN w.c + (CASE WHEN w.some THEN 1 ELSE 0 END) + (length(p.p) + 899) // 900
         WHEN w.some AND w.n + length(p.p) > 500 THEN w.c + 1 ELSE w.c END,
    CASE WHEN length(p.p) >= 900 THEN w.c + (CASE WHEN w.some THEN 1 ELSE 0 END)
         WHEN w.some AND w.n + length(p.p) > 500 THEN w.c + 1 ELSE w.c END
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
s AS (
  SELECT doc_id, own + unnest(range(0, (length(p) + 899) // 900)) AS chunk_index, substring(p, 900 * unnest(range(0, (length(p) + 899) // 900)) + 1, 900) AS text
  FROM w JOIN p USING (doc_id, i) WHERE length(p) >= 900
  UNION ALL
  SELECT doc_id, own, string_agg(p, chr(10) ORDER BY i) FROM w JOIN p USING (doc_id, i) WHERE length(p) < 900 GROUP BY doc_id, own)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, text FROM s""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, whose paragraphs end in one line feed. The lines with pipes aren't tables: no rule follows."""
    return corpus.chunk(table(spark, sf_dir, "documents"), separator="\n")


@register("context_headers", """
SELECT doc_id, concat_ws(' ', '【' || source || '】', nullif(regexp_extract(text, '([A-Z][a-z]+)', 1), ''), CASE WHEN lang <> 'en' THEN lang END) AS header,
       CAST(length(text) AS BIGINT) AS body_chars FROM documents""")
def context_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "standard").otherwise(F.col("lang"))
    return d.select("doc_id", corpus.context_header(F.col("source"), F.regexp_extract("text", "([A-Z][a-z]+)", 1), kind).alias("header"), F.length("text").cast("long").alias("body_chars"))


@register("corpus_counts", "SELECT lang, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars")).orderBy(F.desc("chunks"), "lang")


@register("cube_counts", "SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(grouping(lang) + 2 * grouping(source) AS BIGINT) AS level FROM documents GROUP BY CUBE (lang, source)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), (F.grouping("lang") + 2 * F.grouping("source")).cast("long").alias("level"))


@register("url_doc_key", r"""
SELECT page_id, key, CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS copies, string_split(key, '/')[1] AS host FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^(www|m|blog)\.', ''), '[?#].*$', ''), '/+$', '') AS key FROM pages)""")
def url_doc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", corpus.url_key(F.col("url")).alias("key"))
    copies = p.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    return p.join(copies, "key").select("page_id", "key", "copies", T.corpus_of(F.col("key")).alias("host"))


_GRAMS = r"string_split(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))), ' ')"


@register("contamination_overlap", f"""
WITH dw AS (SELECT doc_id, {_GRAMS} AS w FROM documents), bw AS (SELECT item_id, {_GRAMS} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM bw WHERE len(w) >= 8)),
t AS (SELECT item_id, count(*) AS grams FROM bg GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, round(shared / grams, 6) AS share FROM h JOIN t USING (item_id)""")
def contamination_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shared_grams(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 8)


@register("citation_check", """
WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(\\d{2,5})', 1))) AS code FROM documents),
s AS (SELECT DISTINCT p_size AS k FROM part)
SELECT doc_id, code, CASE WHEN EXISTS (SELECT 1 FROM s WHERE CAST(k AS VARCHAR) = left(code, 2)) THEN 'other' ELSE 'missing' END AS reason
FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE CAST(k AS VARCHAR) = code)""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that documents cite and the list of part sizes lacks; 'other' if the list has its first two digits."""
    cited = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.codes_in(F.col("text"), r"(\d{2,5})", 1)).alias("code"))
    known = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("code")).distinct()
    missing = cited.join(known, "code", "left_anti").withColumn("base", F.substring("code", 1, 2))
    out = missing.join(known.withColumnRenamed("code", "base").withColumn("same", F.lit(True)), "base", "left")
    return out.select("doc_id", "code", F.when(F.col("same"), "other").otherwise("missing").alias("reason"))


@register("dedupe_by_hash", """
SELECT doc_id, sha1(text) AS sha1 FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1""")
def dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_of_content(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "sha1")


@register("incremental_index", """
WITH old AS (SELECT doc_id, sha1(CASE WHEN lang = 'fr' THEN upper(text) ELSE text END) AS sha1 FROM documents WHERE lang <> 'de')
SELECT d.doc_id, sha1(d.text) AS sha1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.doc_id = d.doc_id AND o.sha1 = sha1(d.text))""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to index again if German ones are new and French ones have changed since the last index."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("lang != 'de'").select("doc_id", F.sha1(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))).alias("sha1"))
    return corpus.changed_rows(d.select("doc_id", F.sha1("text").alias("sha1")), old, "doc_id")


@register("header_detect", """
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<[a-z]+[^>]*>')) AS line FROM pages),
c AS (SELECT line, count(*) AS pages FROM l GROUP BY line), t AS (SELECT count(DISTINCT page_id) AS total FROM l)
SELECT line, CAST(pages AS BIGINT) AS pages, round(pages / total, 6) AS ratio FROM c, t WHERE pages >= 8 AND pages >= 0.3 * total""")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening tags that three in ten pages have."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(<[a-z]+[^>]*>)"), F.lit(1))).alias("line"))
    return corpus.running_lines(lines, "page_id", "line")


@register("quote_verify", r"""
WITH g AS (SELECT item_id, unnest(list_filter(string_split(text, '.'), lambda x: length(trim(x)) >= 6)) AS part FROM benchmark),
w AS (SELECT DISTINCT item_id, regexp_replace(part, '\s+', '', 'g') AS bare FROM g),
d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS bare FROM documents)
SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS quotes FROM w JOIN d ON contains(d.bare, w.bare) WHERE w.bare <> '' GROUP BY item_id, doc_id""")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold sentences of a benchmark passage, white space aside, and how many of them."""
    parts = F.filter(F.split("text", r"\.", -1), lambda x: F.length(F.trim(x)) >= 6)
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.explode(parts).alias("part")).select("item_id", T.blank_free(F.col("part")).alias("phrase")).filter("phrase != ''").distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.blank_free(F.col("text")).alias("text"))
    held = holding(docs, quotes).join(quotes, "phrase")
    return held.groupBy("item_id", F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("quotes"))


@register("anchor_levels", r"""
WITH q AS (SELECT item_id, text AS quote, (list_max(list_transform(string_split(text, ' '), lambda x: {'n': length(x), 'w': x}))).w AS word FROM benchmark),
x AS (SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, quote)) THEN 'exact' WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(word))) THEN 'keyword' ELSE 'none' END AS level FROM q)
SELECT level, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY level""")
def anchor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How benchmark passages are found in documents: whole, by their longest word, or not at all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    longest = F.array_max(F.transform(F.split("text", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    p = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), F.lower(longest["w"]).alias("word"))
    whole = holding(docs, p.select(F.col("quote").alias("phrase"))).select(F.col("phrase").alias("quote")).distinct().withColumn("exact", F.lit(True))
    heads = holding(docs.withColumn("text", F.lower("text")), p.select(F.col("word").alias("phrase"))).select(F.col("phrase").alias("word")).distinct().withColumn("keyword", F.lit(True))
    out = p.join(whole, "quote", "left").join(heads, "word", "left")
    level = F.when(F.col("exact"), "exact").when(F.col("keyword"), "keyword").otherwise("none")
    return out.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register("body_clean", r"""
SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*!\[.*?\]\(.*?\)\s*$')), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS sha1 FROM documents""")
def body_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.normalize_body(F.col("text"))).alias("sha1"))


@register("snippets", """
SELECT doc_id, trim(regexp_replace(substring(text, greatest(p - 30, 1), p + 3 + 30 - greatest(p - 30, 1)), '\\s+', ' ', 'g')) AS snippet FROM (SELECT doc_id, text, instr(text, 'the') AS p FROM documents) WHERE p > 0""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), "the", 30).alias("snippet"))
    return d.filter("snippet is not null")


@register("char_bigrams", """
WITH t AS (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM benchmark)
SELECT item_id, CAST(len(list_distinct(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)))) AS BIGINT) AS grams FROM t""")
def char_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.bigrams(F.lower("text"), "[^a-z]")).cast("long").alias("grams"))


@register("file_names", r"""
SELECT page_id, CASE WHEN length(b) > 0 THEN CASE WHEN lower(b) LIKE '%.html' THEN b ELSE b || '.html' END END AS name FROM (
  SELECT page_id, trim(regexp_replace(string_split(regexp_replace(url, '\\', '/', 'g'), '/')[-1], '[<>:"|?*]', '', 'g')) AS b FROM pages)""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url"), ".html").alias("name"))


@register("retention_topn", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS BIGINT) AS place FROM events QUALIFY place > 5""")
def retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backups that keeping each user's five newest lets go."""
    _, old = corpus.keep_newest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], 5)
    return old.select("user_id", "event_id", "place")


_BARE = "text"
for _ in range(3):  # a digit can end one match and begin the next
    _BARE = rf"regexp_replace({_BARE}, '(\d)[,，](\d\d\d)', '\1\2', 'g')"


@register("number_parse", rf"""
SELECT doc_id, CAST(nullif(regexp_extract(t, '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) * CASE WHEN regexp_extract(t, '-?\d+(?:\.\d+)?\s*(万)?', 1) = '万' THEN 10000.0 ELSE 1.0 END AS number FROM (SELECT doc_id, {_BARE} AS t FROM documents)""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.parse_number(F.col("text")).alias("number"))
