"""Ranked lexical search as a blocked sparse matrix product: items x terms times terms x documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .storage import written

#: Terms hold digits, letters and all that isn't ASCII; A-Z become a-z, every other byte becomes a space, and split() finds the terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at once.
CUT = 1 << 20
#: Terms of items that one pass over the documents looks for; items beyond it get passes of their own.
ITEM_TERMS = 1 << 18
#: Documents, and distinct terms of documents, of a block of the matrix at most (a document is never split).
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 1 << 20
BLOCK = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, places array<int>, counts array<int>"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, as lists of those in a stretch."""
    clean, at = raw.translate(TERM_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", at + CUT)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), distinct: rows of one id, null included, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, raw in zip(batch.column(0).to_pylist(), _utf8(batch.column(1))):
                own = sorted({t for part in terms_of(raw) for t in part})
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def _ints(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row with a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


def term_blocks(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the matrix terms x documents, by rows: for each term (number), how many documents of the block hold it (sizes), and
    their places and counts. `ids` and `lengths` are of documents with any of the terms; n_docs and n_terms are of all with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        cols: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        n_docs = n_terms = entries = 0

        def block() -> pa.RecordBatch:
            col = np.concatenate(cols) if cols else np.zeros(0, np.int32)
            order = np.argsort(col, kind="stable")
            terms, sizes = np.unique(col, return_counts=True)
            places = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols])[order]
            counts = (np.concatenate(tfs) if tfs else np.zeros(0, np.int64))[order]
            lists = [_ints(x, pa.int32()) for x in (terms, sizes, places, counts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), _ints(ids, pa.int64()), _ints(lengths, pa.int64()), *lists],
                ["n_docs", "n_terms", "ids", "lengths", "terms", "sizes", "places", "counts"],
            )

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), _utf8(batch.column(1))):
                n, seen = 0, []
                for part in terms_of(raw):
                    n += len(part)
                    at = np.fromiter(map(number.get, part, repeat(-1)), np.int32, len(part))
                    seen.append(at[at >= 0])
                n_docs += n > 0
                n_terms += n
                col, tf = np.unique(np.concatenate(seen), return_counts=True) if seen else ((), ())
                if len(col):
                    ids.append(i)
                    lengths.append(n)
                    cols.append(col)
                    tfs.append(tf)
                    entries += len(col)
                if len(ids) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield block()
                    ids, lengths, cols, tfs = [], [], [], []
                    n_docs = n_terms = entries = 0
        yield block()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BLOCK)


def document_counts(blocks: DataFrame, n: int) -> DataFrame:
    """(term, df): documents that hold each of n terms, summed over the blocks of a task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                total[_row(batch.column(0), row)] += _row(batch.column(1), row)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    return blocks.select("terms", "sizes").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _row(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _mean_lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L, in Python's integers where 64 bits don't hold the product."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // words for x in n], np.int64)
    return 50 + 50 * n * docs // words


def best_of_blocks(blocks: DataFrame, items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each item's k best documents of each task's blocks.

    Gustavson's product: the row of an item is the merge of the rows of its terms, each term's impacts added where its documents
    stand. A block's k best are merged with those of the blocks before it, so a task gives at most k rows an item.
    """

    def best(score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, ids, null = score[keep], ids[keep], null[keep]
        order = np.lexsort((ids, null, -score))[:k]
        return score[order], ids[order], null[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for row in range(batch.num_rows):
                raw = column["ids"][row].values
                null, ids = raw.is_null().to_numpy(zero_copy_only=False), raw.fill_null(0).to_numpy(zero_copy_only=False)
                terms, sizes, places, tf = (_row(column[c], row) for c in ("terms", "sizes", "places", "counts"))
                if not len(terms):
                    continue
                tf = tf.astype(np.int64)
                m = _mean_lengths(_row(column["lengths"], row), n_docs, n_terms)
                impact = np.repeat(weight[terms], sizes) * (1_000_000_000 * tf // (1000 * tf + 20 * m[places]))
                ends = np.cumsum(sizes)
                at = np.full(len(weight), -1, np.int32)
                at[terms] = np.arange(len(terms))
                for item, (_, wanted) in enumerate(items):
                    here = at[wanted]
                    here = here[here >= 0]
                    if not len(here):
                        continue
                    score = np.zeros(len(ids), np.int64)
                    for r in here.tolist():
                        span = slice(ends[r] - sizes[r], ends[r])
                        score[places[span]] += impact[span]
                    hit = np.flatnonzero(score > 0)
                    new = best(score[hit], ids[hit], null[hit])
                    old = found.get(item)
                    found[item] = best(*map(np.concatenate, zip(old, new))) if old else new
        for item, (score, ids, null) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([items[item][0]] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return blocks.select("ids", "lengths", "terms", "sizes", "places", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents by the sum of its terms' impacts, above 0.

    Items are dealt by a hash of their ids to blocks of about `item_terms_at_once` terms, which is what tasks and the driver hold of
    them; every block of items meets every document. All counts are of all documents.
    Null texts have no terms; items without terms, and those that no document answers, have no rows. Rows that repeat an item's id
    are one item, rows that repeat a document's are documents of their own; null ids are ids, of documents the last among equal
    scores. An empty table on either side gives no rows. Further columns are unread.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items))
    passes = max(1, math.ceil(asked.count() / item_terms_at_once))
    parts = []
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        vocabulary = sorted({r["term"].encode() for r in rows})
        number = {t: i for i, t in enumerate(vocabulary)}
        by_item: dict[int | None, list[int]] = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append(number[r["term"].encode()])
        if not vocabulary:
            continue
        blocks = written(term_blocks(docs, number))
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in document_counts(blocks, len(vocabulary)).collect():
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        parts.append(best_of_blocks(blocks, [(i, np.array(sorted(c), np.int32)) for i, c in by_item.items()], weight, n_docs, n_terms, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = f"""
with d as (select row_number() over () as r, doc_id, text from documents),
t as (select r, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) as term from d),
c as (select r, term, count(*) as tf from t group by 1, 2),
n as (select r, count(*) as n from t group by 1),
s as (select count(*) as docs, cast(sum(n) as bigint) as words from n),
w as (select term, cast(floor(1000::double * ln(cast(2 * any_value(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from c cross join s group by 1),
m as (select r, 50 + (50 * n * docs) // words as m from n cross join s),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) as term from benchmark),
x as (select item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
      from q join c using (term) join w using (term) join m using (r) join d using (r) group by 1, 2, 3),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from x where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""
