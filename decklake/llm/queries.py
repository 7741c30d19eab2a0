"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, exact_dedup, filter_audit, language_id, mixing, packing, pii, simhash, syncmers, token_counts, toxicity, vector_codes, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, lambda s: mixing.ranked(s, [5, 2, 1]), max_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round(F.element_at("positions", 1), 9).alias("position"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, tokenizer("byte_bpe_50k.tiktoken"), bpe_pattern()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.assign_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), k=3, radius=3)
    return found.select("doc_id", simhash.as_hex(F.col("code")).alias("fingerprint"), "component_id")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return found.select("record_id", "canonical", "kind", "captured", "refers_to", "status", headers.alias("merged_headers"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end=2)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_token_counts, op4_language_id, op5_pii, op6_simhash, op7_byte_bpe, op8_exact_dedup, op9_warc_revisits, op10_syncmers, op11_packing, op12_filter_audit, op13_vector_codes)}
