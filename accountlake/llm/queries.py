"""Registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accountlake.llm import (
    exact_dedup, fingerprints, jaccard_join, lbl, license_scan, mixing, revisits, secret_scan, suffix_pieces, token_counts, toxicity,
    turn_repair, whitening,
)
from accountlake.llm.common import prepare

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(_read(spark, sf_dir, "documents")))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.report(revisits.resolve_revisits(revisits.capture_log(_read(spark, sf_dir, "pages"))))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op5_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.scores(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_read(spark, sf_dir, "documents")).drop("bucket", "chain")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.piece_report(_read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(_read(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "class_size")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_read(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(_read(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(license_scan.license_spans(_read(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secrets": op2_secrets,
    "op3_revisits": op3_revisits,
    "op4_mix": op4_mix,
    "op5_lbl_scores": op5_lbl_scores,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_turn_repair": op12_turn_repair,
    "op13_license_scan": op13_license_scan,
}

ORACLE: dict[str, str] = {
    "op3_revisits": revisits.REPORT_SQL,
    "op4_mix": mixing.REPORT_SQL,
    "op6_exact_dedup": exact_dedup.COPIES_SQL,
}
