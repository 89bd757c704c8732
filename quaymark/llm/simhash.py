"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import bucket_links
from .storage import written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3, piece: int = 1 << 15) -> int:
    """64-bit SimHash: bit b is set when over half of the shingles' XXH64 (seed 42) have it. No words: 0."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_digest, b" ".join
    ones = np.zeros(64, np.int64)
    for start in range(0, n, piece):  # so a very long text needs no more memory than its words
        stop = min(n, start + piece)
        if n == 1:
            hashes = [digest(join(words), 42)]
        elif shingle == 3:
            hashes = [digest(a + b" " + b + b" " + c, 42) for a, b, c in zip(words[start:stop], words[start + 1:stop + 1], words[start + 2:stop + 2])]
        else:
            hashes = [digest(join(words[i:i + shingle]), 42) for i in range(start, stop)]
        ones += np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family (Pagh 2016).

    Bit i gets the non-zero vector phi(i) of radius + 1 bits; mask v keeps the bits whose phi has an odd product with v.
    Any `radius` differing bits span a proper subspace, so some non-zero v is orthogonal to all of them, and its mask
    leaves all the differing bits out: the pair collides in that table, for certain.
    """
    size = 1 << (radius + 1)
    phi = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(nodes: DataFrame, radius: int = 2, rounds: int = 1) -> DataFrame:
    """(fp, root) of fingerprints that have a link, over distinct fingerprints nodes(fp); root is the smallest one linked."""
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius))]))
    members = nodes.select(F.col("fp").alias("id"), tables.alias("b")).select(F.col("b.t").alias("t"), F.col("b.key").alias("key"), "id")
    busy = members.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = written(members.join(busy, ["t", "key"]))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    labels = bucket_links(members, ["t", "key"], lambda pairs: pairs.where(near), rounds, within=near)
    return labels.select(F.col("id").alias("fp"), F.col("component").alias("root"))


def simhash_groups(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable).

    Fingerprints are made once per row and deduplicated, so exact copies are one node however many they are; links at
    `radius` or fewer differing bits come from the covering tables; components join back by fingerprint, one row for each,
    so that the partition of a fingerprint held by a third of all rows can be split.

    Null and empty texts have fingerprint zero and link like any other. A null id never names a component unless all
    ids in it are null. Repeated rows each get a row. An empty table gives no rows; other columns are unread.
    """
    rows = written(fingerprints(docs, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = linked(nodes.select("fp"), radius)
    whole = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = whole.join(names, "root").select("fp", "component_id")
    # A hot fingerprint's rows are narrow, and the adaptive skew join splits their partition; the other side has one row.
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
