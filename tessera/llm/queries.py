"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, html_text, langid, licenses, quality_rules, simhash, spelling, toxicity, vector_codes
from .common import in_training, table
from .jaccard_join import jaccard_components
from .mixing import mix
from .packing import pack
from .pii import find_pii
from .quality_rules import quality_verdicts


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_list").cast("binary"), 256).alias("base_sha256"), F.col("span_list").alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    sounds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), "embedding")
    return audio.align(audio.fingerprints(sounds, ("embedding",), audio.played))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), path, ids_crc32=F.crc32("ids"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(in_training(F.col("doc_id"))))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "cosine", "rejected"
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, width=3, similarity=(90, 100)).select("doc_id", "n_shingles", "component_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(in_training(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, radius=2)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii": op2_pii,
    "op3_license_scan": op3_license_scan,
    "op5_chroma_fingerprints": op5_chroma_fingerprints,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op3_license_scan": licenses.SQL, "op10_quality_rules": quality_rules.SQL, "op11_spelling_variants": spelling.SQL, "op13_vector_codes": vector_codes.SQL}
