"""The numbered queries: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_position, decontaminate, licenses, mixing, ngram_lm, pairwise_quality, pii, quality_rules, secrets, simhash, spherical_caps, token_prefix, whitening
from .shared import kept, table

TOKEN_LIMIT = 1024


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.trained(docs.where(~ngram_lm.held_out()))
    try:
        scored = ngram_lm.scores(docs, model).withColumn("held_out", ngram_lm.held_out()).withColumn("train_tokens", F.lit(model.totals["tokens"]).cast("long"))
        # scored once, so that the model's files can go
        return kept(scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    finally:
        model.files.delete()


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.trained(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    both = F.concat_ws(",", *(F.when(F.size(c) > 0, joined(c)) for c in ("base", "terms")))
    def number(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), both.alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_prefix.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col("fits").alias("chars_within_limit"))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = pairwise_quality.trained(docs.where(~fold), table(spark, sf_dir, "labels").where(~fold))
    return pairwise_quality.quality_scores(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")


def op11_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_lm_scoring, op3_source_mix, op4_quality_rules, op5_secret_scan, op6_license_scan, op7_simhash, op8_pii, op9_token_counts, op10_pairwise_quality, op11_spherical_caps, op12_whitening, op13_best_position)
    return {f.__name__: f for f in found}
