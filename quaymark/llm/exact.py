"""Exact document dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Every combining stage groups on digest *and* content, so equal digests of different texts never meet:
    1. each map task combines its own rows of (digest, salt, content);
    2. the shuffle merges those groups per salt, which spreads a group of any size over `salts` tasks;
    3. salt winners, at most `salts` rows a group, combine per (digest, content).
    The answer then returns to the rows by (digest, salt), again spread over the salts, and without any text: a second
    hash of the content stands beside the digest.

    Nulls count as the empty text. The largest id stays; rows that repeat that id all stay, as nothing tells them apart.
    A null id never wins against an id; a group of null ids only keeps them all. An empty table gives no rows. Only the
    two named columns are read, so further columns of any name are no matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")).select(
        "doc_id", "content",
        F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    groups = (
        salted.groupBy("text_sha256", "content")
        .agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
        .select("text_sha256", F.xxhash64("content").alias("check"), "keep_id", "group_size", "mask")
    )
    answers = groups.select(
        "text_sha256", "check", "keep_id", "group_size",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.call_function("getbit", "mask", s) == 1)).alias("salt"),
    )
    return (
        rows.select("doc_id", "text_sha256", "salt", F.xxhash64("content").alias("check"))
        .join(answers, ["text_sha256", "salt", "check"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


EXACT_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)
"""
