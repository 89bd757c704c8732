"""The queries opN_<name> over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .chat import chat_digests
from .exact import EXACT_SQL, exact_dedup
from .licenses import license_scan
from .lines import dedup_lines
from .mixing import MIX_SQL, mix_documents
from .pages import main_text
from .pieces import round_trip
from .pii import private_data
from .quality import quality_verdicts
from .search import SEARCH_SQL, search
from .simhash import simhash_groups
from .storage import table
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), model_file or public_tokenizers.path("piece_bpe_32k.model"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return chat_digests(table(spark, sf_dir, "conversations"), model_file or public_tokenizers.path("piece_bpe_32k.model"))


def op13_alignment(spark: SparkSession, sf_dir: str, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), a_file or public_tokenizers.path("byte_bpe_50k.json"), b_file or public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_personal_data, op3_license_scan, op4_line_dedup, op5_exact_dedup, op6_main_text, op7_quality_rules, op8_simhash, op9_mixing, op10_sentencepiece,
    op11_lexical_search, op12_chat_format, op13_alignment,
)}
ORACLES = {"op5_exact_dedup": EXACT_SQL, "op9_mixing": MIX_SQL, "op11_lexical_search": SEARCH_SQL}
