"""Queries of the training-data operators over their whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.quality import calibrate, measure, verdict
    from docstrata.llm.store import materialize

    docs = table(spark, sf_dir, "documents")
    measured = materialize(measure(docs.select("doc_id", "lang", "text")).drop("text"), "measured")
    kept = verdict(measured, calibrate(measured, table(spark, sf_dir, "labels")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.suffixes import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.warc import archive_roundtrip

    return archive_roundtrip(table(spark, sf_dir, "pages")).drop("payload")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docstrata.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.manifest import verified_manifest

    return verified_manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.lm import score

    return score(table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstrata.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_near_dedup, op3_mixing, op4_line_dedup, op5_quality_rules, op6_suffix_dedup, op7_warc, op8_html_text, op9_vectors, op10_packing, op11_manifest, op12_lm_scores, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    from docstrata.llm import oracles

    return {"op1_substring_dedup": oracles.OP1, "op5_quality_rules": oracles.op5(), "op7_warc": oracles.OP7, "op9_vectors": oracles.OP9, "op11_manifest": oracles.op11(), "op13_resampling": oracles.OP13}
