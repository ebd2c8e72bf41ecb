"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

import os
import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import decontaminate as L8
from tally.llm import language_id as L3
from tally.llm import line_dedup as L1
from tally.llm import lm_score as L7
from tally.llm import mixing as L5
from tally.llm import pii as L4
from tally.llm import quality_crf as L10
from tally.llm import quality_rules as L9
from tally.llm import ranked_search as L13
from tally.llm import sentence_pieces as L11
from tally.llm import simhash as L6
from tally.llm import spelling_variants as L12
from tally.llm import token_binary as L2
from tally.llm.common import documents, fold
from tally.session import scratch_path

LANGUAGE_FIT = {"docs_per_language": 200, "max_chars": 20_000}
LANGUAGE = {"level": 6, "block": 4096, "min_margin": 0.005}
SIMHASH = {"shingle": 4, "max_bits": 4}
EDITS = {"error_rate": 0.1}
MIX = {"weights": (5.0, 2.0, 1.0), "share": 1.5, "max_epochs": 2}
END_ID = 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RUNS = {"min_lines": 3, "min_words": 50}
LM = {"min_count": 2, "backoff": 0.4}
#: A deployment names its secret (TALLY_PII_KEY); without one every process takes a new one,
#: so pseudonyms agree within a run and nobody can undo them by reading the source.
PII_KEY = os.environ.get("TALLY_PII_KEY") or secrets.token_hex(32)
CRF_FIT = {"folds": 5, "held_out": 0, "sample_per_label": 1500, "max_chars": 20_000}
GOOD = 0.3
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"min_length": 5, "min_count": 3, "one_in": 97}
TOP = 20


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def token_records(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return L2.encode_documents(docs, scratch_path(spark, "records"), TOKENIZER, END_ID)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L1.dedup_lines(documents(spark, sf_dir), **RUNS).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("clean_md5"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L4.pseudonymise(documents(spark, sf_dir), PII_KEY).select(
        "doc_id", "n_replaced", "text")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(spark, documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return L3.identify(docs, L3.fit(docs, **LANGUAGE_FIT), **LANGUAGE).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L5.plan(documents(spark, sf_dir), **MIX).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L6.near_duplicates(documents(spark, sf_dir), **SIMHASH).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L7.score(documents(spark, sf_dir), **LM).select(
        "doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("score", 6).alias("score"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L8.matches(documents(spark, sf_dir), benchmark(spark, sf_dir), **EDITS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L9.assess(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return L10.score(docs, L10.fit(docs, labels(spark, sf_dir), **CRF_FIT)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "n_lines")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = L11.decode(L11.encode(documents(spark, sf_dir), PIECES), PIECES)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L12.group(L12.count_words(documents(spark, sf_dir), **WORDS)).select(
        "word", "form", "root", "n", "n_near", "form_n")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L13.search(documents(spark, sf_dir), benchmark(spark, sf_dir), TOP)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_records, op3_language_id, op4_pseudonyms, op5_source_mix,
                                   op6_simhash_near_dedup, op7_lm_score, op8_decontaminate, op9_quality_rules, op10_quality_crf,
                                   op11_sentence_pieces, op12_spelling_variants, op13_ranked_search)}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": L1.ORACLE, "op7_lm_score": L7.ORACLE, "op9_quality_rules": L9.ORACLE,
                              "op13_ranked_search": L13.ORACLE}
