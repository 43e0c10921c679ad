"""The corpus queries opN_<name>, thin over their operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, merkle, mixing, ngram_join, packing, pii, quality, secret_scan, token_counts, topk, toxicity, url_filter, whitening


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__qr_tokens").alias("n_tokens"), F.col("__qr_epoch").alias("epoch"), F.col("__qr_block").alias("block"), F.col("__qr_order").alias("order_key"))


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("distance"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, thresholds = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, thresholds)
    held = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cleaned = line_dedup.dedup_lines(docs, out="clean_text")
    removed = F.col("removed_lines")
    return cleaned.select(
        "doc_id",
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"),
        F.length("clean_text").cast("long").alias("kept_chars"),
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=merkle.lowered(F.col("doc_id"), F.col("text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_pii, op3_temperature_mix, op4_quality_outliers, op5_best_fit_packing, op6_ngram_jaccard, op7_toxicity, op8_token_counts, op9_exact_topk, op10_line_dedup, op11_url_filter, op12_embedding_whitening, op13_merkle_manifest, pipeline)
}

ORACLES: dict[str, str] = {"op6_ngram_jaccard": ngram_join.ORACLE, "op9_exact_topk": topk.ORACLE, "op10_line_dedup": line_dedup.ORACLE, "op11_url_filter": url_filter.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
