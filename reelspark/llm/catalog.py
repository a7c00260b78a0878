"""Corpus queries: ``key -> (spark, sf_dir) -> DataFrame`` and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import oracles
from reelspark.llm.ann import nearest_neighbours
from reelspark.llm.common import KEY
from reelspark.llm.decontaminate import contamination_report
from reelspark.llm.html_text import extract_text
from reelspark.llm.lang_id import identify
from reelspark.llm.license_scan import scan_licences
from reelspark.llm.line_dedup import dedup_runs
from reelspark.llm.merkle import verified_manifest
from reelspark.llm.near_dups import near_duplicates
from reelspark.llm.packing import pack
from reelspark.llm.secret_scan import findings, update_ledger
from reelspark.llm.simhash import simhash_duplicates
from reelspark.llm.toxicity import score_toxicity
from reelspark.llm.whitening import whiten
from reelspark.session import checkpoint_dir
from reelspark.sources.driver_tables import table


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts against a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents")
    return findings(docs, update_ledger(docs, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the text without repeated runs of lines, and what was removed."""
    return dedup_runs(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")).drop(KEY)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_licences, op2_packing, op3_html_text, op4_near_dups, op5_secrets, op6_toxicity, op7_decontaminate,
    op8_line_dedup, op9_ann, op10_language, op11_whitening, op12_simhash, op13_manifest)}

#: The other keys are trained models, hashing, graphs or packing, which SQL cannot state; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_licences": oracles.licences(), "op5_secrets": oracles.secrets(), "op7_decontaminate": oracles.contamination(),
    "op13_manifest": oracles.manifest()}
