"""The thin queries over the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import alignment, codes, decontaminate, exact_dedup, language, minhash, packing, pii, pivots, quality, records, sql, substring, warc
from foliate.llm.common import shared_folder, table


#: For the query alone; in production the key is a secret of whoever runs the operator.
PII_KEY = "key of the registered query"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), key=PII_KEY)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), shared_folder(spark))
    return warc.read_warc(manifest).filter("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents"), shared_folder(spark), vocabulary())
    return records.read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), quality.trusted_ids(table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), n=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_pii_surrogates, op3_exact_dedup, op4_decontaminate, op5_warc, op6_token_records, op7_quality, op8_packing, op9_language_id, op10_minhash, op11_alignment, op12_vector_codes, op13_top_products)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
