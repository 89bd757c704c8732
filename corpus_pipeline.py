"""The corpus pipeline: each stage reads all that the one before it kept. It is part of the training-data operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quaymark.llm.lines import dedup_lines
from quaymark.llm.mixing import mix, words_of
from quaymark.llm.pieces import round_trip
from quaymark.llm.simhash import simhash_groups
from quaymark.llm.storage import remove, scratch, shared_dir, table, whole_if_small, written
from quaymark.llm.toxicity import below, fit_from_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents at or above this score are rejected.
TOXIC = 0.3
#: Slots of the mix that stay together in one file.
STRETCH = 4096


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Trained on the labelled rows of `docs`; scored in one pass.

    Rows are judged by their text alone: null and empty texts score as one without n-grams, null ids and repeated rows as
    others. An empty table, or one without labelled rows, rejects nothing more than the score of the empty text says.
    """
    model = fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return below(docs, model, TOXIC, COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has alike or nearly so; n_chars follows the text.

    No row is dropped: a document may be left with an empty text. Null ids pass as they are, null texts stay null, and of rows
    that repeat id and text both keep what the first may keep.
    """
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; rows with a null id stay.

    Null and empty texts are one group. Rows that repeat the smallest id all stay, as nothing tells which is first.
    """
    copies = written(simhash_groups(docs).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(whole_if_small(copies), "doc_id", "left_anti").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: once for each begun round, none for those it leaves out.

    Rows stand in the order of the mix: stretches of slots are dealt to files, and sorted there. Null ids take part like
    others; rows alike in id, source and number of words are taken together, each once a round. Null and empty texts
    have no words, so the mix takes none of them.
    """
    sized = docs.withColumn("__size", words_of(F.col("text")))
    _, mixed = mix(sized.select("doc_id", "source", F.col("__size").alias("size")))
    begun = written(mixed.groupBy("doc_id", "source", "size", "round").agg(F.min("slot").alias("__slot")))
    begun = begun.select(F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("size").alias("__words"), "__slot")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__words"))
    taken = sized.join(begun, same).select(*COLUMNS, "__slot")
    return taken.repartition(F.floor(F.col("__slot") / STRETCH)).sortWithinPartitions("__slot", "doc_id").select(COLUMNS)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row for each row; a null text is the empty one."""
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage), ("line dedup", line_stage), ("simhash near-dedup", simhash_stage),
    ("mixing", mixing_stage), ("sentencepiece", tokenize_stage),
]
#: Fuzzy lines, trained scores and merges of pieces are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage wrote besides, and what the one
    before it returned, is deleted once it is done."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
