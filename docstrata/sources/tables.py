"""Readers of tables and files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan of few files dealt to all cores, for work that costs more than a shuffle; larger scans as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def markdown_bundle(spark: SparkSession, path: str) -> DataFrame:
    """path, meta (flat ``key: value`` lines of the front matter) and body of every .md file below ``path``.

    Files with an empty body are left out. A front matter that isn't flat gives what of it is.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    head, body = front_matter(F.col("value"))
    return files.select(F.col("_metadata.file_path").alias("path"), head.alias("meta"), body.alias("body")).filter(F.length(F.trim("body")) > 0)


def markdown_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Every .md file below ``path``, in order of paths, of the first ``limit``: path, place from 1, readable, meta and body.

    A file that isn't UTF-8 is there with readable false and no body, so that what was left out can be counted; Spark
    lists no files of no bytes. Files are read one by one in tasks; paths alone meet in one, for their places.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    places = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path).select("path")
    order = Window.orderBy("path")  # one row a file: a limit needs their order
    places = places.withColumn("place", F.row_number().over(order))
    if limit is not None:
        places = places.filter(F.col("place") <= limit)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"))
    head, body = front_matter(F.col("text"))
    d = files.join(places, "path").select("path", "place", text.alias("text"))
    return d.select("path", "place", F.col("text").isNotNull().alias("readable"), F.when(F.col("text").isNotNull(), head).alias("meta"), body.alias("body"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The map of the leading ``---`` block and the text after it; an empty map and the whole text without one."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
    block = F.regexp_extract(text, pattern, 1)
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_extract_all(x, F.lit(r"^([A-Za-z_][\w-]*):[ \t]*(.*)$"), F.lit(1))), lambda x: F.size(x) > 0)
    keys = F.transform(pairs, lambda x: x[0])
    values = F.transform(F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:")), lambda x: F.regexp_extract(x, r"^[A-Za-z_][\w-]*:[ \t]*(.*)$", 1))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: x["k"].isNotNull())
    meta = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.filter(first, lambda e: e["k"] == k)[0]["v"].alias("value"))))
    return F.when(text.rlike(r"(?s)^---\s*\n.*?\n---\s*\n"), meta).otherwise(F.create_map().cast("map<string,string>")), F.when(text.rlike(r"(?s)^---\s*\n.*?\n---\s*\n"), F.regexp_extract(text, pattern, 2)).otherwise(text)


def criteria(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of rules with its schema; an empty table if the file isn't there."""
    try:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def query_result(spark: SparkSession, sql: str, most: int = 500) -> dict:
    """Gold answer of a statement: columns and rows as strings up to ``most``, or the error."""
    try:
        df = spark.sql(sql)
        rows = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).limit(most + 1).collect()
    except Exception as e:  # noqa: BLE001  a statement may fail in any way; the failure is the result
        return {"ok": False, "error": str(e).split("\n")[0]}
    return {"ok": True, "columns": df.columns, "rows": [list(r) for r in rows[:most]], "row_count": min(len(rows), most), "truncated_at": most if len(rows) > most else None}


def gold_answers(gold: DataFrame, most: int = 500) -> DataFrame:
    """Gold answers as a table: id, sql, ok, row (from 0), field, value (a string).

    ``gold``: id and sql, a hand-written list. The first ``most`` rows of each statement are kept; a null statement, or
    one that Spark refuses, gives one row that isn't ok. Answers stay tables: none goes through the driver.
    """
    spark = gold.sparkSession
    out = spark.createDataFrame([], "id string, sql string, ok boolean, row long, field string, value string")
    for r in gold.select("id", "sql").orderBy("id").collect():
        told = [F.lit(r["id"]).alias("id"), F.lit(r["sql"]).cast("string").alias("sql")]
        try:
            answer = spark.sql(r["sql"]).limit(most) if r["sql"] else None
        except AnalysisException:
            answer = None
        if answer is None:
            rows = spark.range(1).select(*told, F.lit(False).alias("ok"), *[F.lit(None).cast(k).alias(c) for c, k in (("row", "long"), ("field", "string"), ("value", "string"))])
        else:
            fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"r.`{c}`").cast("string").alias("value")) for c in answer.columns]))
            place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1  # of ``most`` rows
            held = answer.select(place.cast("long").alias("row"), F.struct(*[F.col(f"`{c}`") for c in answer.columns]).alias("r"))
            rows = held.select("row", fields.alias("f")).select(*told, F.lit(True).alias("ok"), "row", "f.field", "f.value")
        out = out.unionByName(rows)
    return out
