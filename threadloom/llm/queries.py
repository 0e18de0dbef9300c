"""Queries over the driver's tables, one for each operator of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bradley_terry, collocations, mixing, mpeg_audio, periodic_runs, pii_weak, pivot_topk, quality_mcd, secret_scan, sentencepiece_offsets, simhash_gray, suffix_levels, warc

#: The installed tokenizers' file; a parameter of op7.
MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(mpeg_audio.stored_media(table(spark, sf_dir, "documents")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def source_domains(docs: DataFrame) -> DataFrame:
    """The tables name no domains, so sources are dealt to three by their numbers: (source, domain)."""
    number = F.regexp_extract(F.col("source").cast("string"), "([0-9]{1,9})$", 1).try_cast("long") % 3
    return docs.select("source").distinct().select("source", F.when(number == 1, "reference").when(number == 2, "forum").otherwise("web").alias("domain"))


#: The same in DuckDB.
DOMAIN_SQL = "CASE try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS BIGINT) % 3 WHEN 1 THEN 'reference' WHEN 2 THEN 'forum' ELSE 'web' END"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, source_domains(docs)).drop("row_key")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.report(pii_weak.find(table(spark, sf_dir, "documents")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_offsets.encode_texts(table(spark, sf_dir, "documents"), model_path(), digests=True)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.removed_passages(table(spark, sf_dir, "documents"), batches=5, words=True).drop("row_key")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_products(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_mpeg_audio": op1, "op2_simhash_gray": op2, "op3_secret_trigrams": op3, "op4_mixing_budgets": op4, "op5_bradley_terry": op5,
        "op6_pii_weak": op6, "op7_sentencepiece": op7, "op8_warc": op8, "op9_suffix_levels": op9, "op10_quality_mcd": op10,
        "op11_collocations": op11, "op12_periodic_runs": op12, "op13_pivot_topk": op13,
    }


#: The 160 bits of a SHA-1, five at a time, as letters.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex FROM p),
b AS (SELECT page_id, n, hex, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + i // 4 * 5, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT % 32)::INTEGER, 1) FOR i IN range(0, 32)], '') AS digest FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_trigrams": secret_scan.report_sql(), "op4_mixing_budgets": mixing.mix_sql(DOMAIN_SQL), "op8_warc": WARC_SQL, "op11_collocations": collocations.SQL, "op13_pivot_topk": pivot_topk.SQL}
