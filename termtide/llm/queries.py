"""The operators of this package as queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.llm import (
    alignment, bpe, chat, extraction, imatch, jaccard, language, lm, mixing, oracles, pii, spelling,
    topk, toxicity)
from termtide.llm.common import crc_bucket, table

RANKS = "byte_bpe_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) == 2)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = crc_bucket("doc_id", 5)
    filters = language.learn(documents.where(remainder != 0))
    return language.predict(documents.drop("lang"), filters).select(
        "doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(table(spark, sf_dir, "conversations"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).select(
        "page_id", "url", F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the plain spans; n_added counts what deobfuscation adds."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("plain_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(_joined(F.col("plain_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("plain_spans")).cast("long").alias("n_added"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_runs(
        table(spark, sf_dir, "documents"), min_chars=6, min_count=5, drop_one_in=199)
    return spelling.variants(words, factor=5)


def aligned_vocabularies() -> tuple[str, str]:
    """Paths of the public vocabularies A and B that op12 aligns."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), *aligned_vocabularies())


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) > 0)
    model = toxicity.learn(documents, labels)
    return toxicity.score(documents, model).select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_recurrent_lm": op2_recurrent_lm,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_preference_format": op5_preference_format,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_source_mix": op8_source_mix,
    "op9_main_text": op9_main_text,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_toxicity": op13_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_fingerprints": oracles.edited_fingerprints(),
    "op6_exact_top_k": oracles.TOP_K,
    "op8_source_mix": oracles.SOURCE_MIX,
}
