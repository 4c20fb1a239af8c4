"""Registered queries of the corpus operators: thin wrappers that derive the
digest columns from the operators' own results."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import (bpe, exact_dedup, filter_audit, fingerprint, line_dedup, ngram_join, packing, periodic_runs, pii,
                        quality, secrets, token_files, toxicity)
from limnos.llm.common import documents, labels, ship


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(labels(spark, sf_dir))
    return quality.quality_rules(documents(spark, sf_dir), trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "llr")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
                        "n_spans", "n_added")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.cut_lines(documents(spark, sf_dir))
    return cut.select("doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.length("text").cast("long").alias("n_chars"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repository"))
    found = secrets.secret_scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(secrets.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.as_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
                        "n_live", "n_copied", "most_owners", "most_repositories")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract's edited texts: a tenth of all documents, by
    the checksum of doc_id, repeat a period from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(documents(spark, sf_dir), planted_period)
    best = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.as_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def _shipped(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe": op3_bpe,
    "op4_personal_data": op4_personal_data,
    "op5_fingerprints": op5_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_secret_scans": op8_secret_scans,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}
QUERIES = {name: _shipped(fn) for name, fn in QUERIES.items()}

ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": ngram_join.COMPONENTS_SQL,
    "op11_filter_audit": filter_audit.AUDIT_SQL,
    "op13_exact_dedup": exact_dedup.GROUPS_SQL,
}
