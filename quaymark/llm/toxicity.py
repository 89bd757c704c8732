"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning 2012)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import whole_if_small, written

LENGTHS = (3, 4, 5, 6)
#: Buckets that n-grams are hashed to, as a power of two; labelled rows that one task counts.
BITS, ROWS_PER_TASK = 22, 8192
#: Step of the gradient descent.
RATE = 0.005
#: Characters hashed at a time, so that a text of any length needs bounded memory.
PIECE = 1 << 19


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Lower-case code points in overlapping pieces that together hold every n-gram; short texts are padded by spaces."""
    text = f" {(text or '').lower()} "
    step = PIECE - max(LENGTHS) + 1
    for start in range(0, max(1, len(text) - max(LENGTHS) + 1), step):
        yield np.frombuffer(text[start:start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length, the buckets of the n-grams at every place."""
    h, n = points, 1
    for length in LENGTHS:
        while n < length and len(h) > 1:
            h = h[:-1] * np.uint32(0x01000193) + points[n:]
            n += 1
        if n == length and len(h):
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * length & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def presence(text: str | None) -> np.ndarray:
    """The different buckets of a text's n-grams, in order."""
    found = [np.unique(np.concatenate(list(buckets(p)) or [np.zeros(0, np.uint32)])) for p in pieces(text)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    """Weights of the buckets `at`, all others being zero, and the intercept."""

    at: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self) -> Callable[[str | None], float]:
        """Score of a text; the weights are laid out over all buckets once."""
        every = np.zeros(1 << BITS, np.float32)
        every[self.at] = self.weights

        def score(text: str | None) -> float:
            hits = [at[hit] for p in pieces(text) for at in buckets(p) if (hit := every[at] != 0).any()]
            x = self.intercept + (float(every[np.unique(np.concatenate(hits))].sum(dtype=np.float64)) if hits else 0.0)
            return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))

        return score

    def score(self, text: str | None) -> float:
        return self.scorer()(text)


def _counts(rows: DataFrame, n: int) -> DataFrame:
    """(bucket, pos, neg): texts of rows(text, label), n in all, that have an n-gram of the bucket; tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                total[label.as_py(), presence(text.as_py())] += 1
        at = np.flatnonzero(total.any(axis=0)).astype(np.int32)
        for part in np.array_split(at, len(at) // 65536 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[1][part]), pa.array(total[0][part])], ["bucket", "pos", "neg"])

    few = rows.coalesce(n // ROWS_PER_TASK + 1)  # few tasks, so that what is shuffled grows with the rows and not with their files; texts stay where they are read
    counted = few.mapInArrow(run, "bucket int, pos int, neg int")
    # A task has each bucket once, so there is nothing to add up before the exchange.
    return counted.repartition("bucket").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _sample(rows: DataFrame, label: int, n: int) -> DataFrame:
    """(text, label) of the first n rows of a class of rows(doc_id, text, label, digest), by hashes of id and text.

    Keys are ranked without their texts, or each task would pass on n texts to the one that ranks them all. Texts are those of the keys picked,
    n at most but for repeated rows, so they are ranked and cut again.
    """
    own, order = rows.where(F.col("label") == label), (F.xxhash64("doc_id"), "doc_id", "digest")
    keys = own.select("doc_id", "digest").orderBy(*order).limit(n)
    return own.join(F.broadcast(keys), ["doc_id", "digest"], "left_semi").orderBy(*order).limit(n).select("text", "label")


def _presence(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(label, has): which of the chosen buckets each text of rows(text, label) has, as 32-bit places in `chosen`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        for batch in batches:
            has = [(p := place[presence(t.as_py())])[p >= 0].astype("<u4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(has, pa.binary())], ["label", "has"])

    return rows.mapInArrow(run, "label int, has binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1000, sure: float = 3.0, penalty: float = 1.0, rounds: int = 200) -> Model:
    """Train on the rows of docs(doc_id, text) that labels(doc_id, label) marks 0 or 1.

    Counts for the log-count ratios and the class balance cover all labelled rows, in Spark. A ratio is drawn towards zero by
    the share that `sure` has in the signed root of its likelihood ratio, which is standard normal for a bucket that says nothing;
    every bucket with a ratio left takes part, however many there are. The linear weights over ratio-scaled presence are fitted by gradient steps on at most `sample`
    labelled rows of each class, picked by a hash of the id and weighted back to the classes' sizes. The driver holds the
    buckets with a ratio, at most 2^BITS, and which of them each sampled row has.

    Rows without text, with a null label or another label are left out. With a class missing, every score is its share.
    """
    known = written(labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    rows = written(docs.where("text is not null").join(whole_if_small(known), "doc_id").select("doc_id", "text", "label", F.xxhash64("text").alias("digest")))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((pos + 0.5) / (neg + 0.5))))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    ratio = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (neg + 1))
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    fixed = (pos + neg) * np.log(pos + neg) - pos * np.log(pos) - neg * np.log(neg)
    evidence = F.sqrt(2 * F.greatest(part(a) + part(b) + part(pos - a) + part(neg - b) - part(a + b) - part(pos + neg - a - b) + F.lit(float(fixed)), F.lit(1e-9)))
    counts = _counts(rows.select("text", "label"), pos + neg).select("bucket", ratio.alias("r"), evidence.alias("sd"))
    found = counts.where(F.col("sd") > sure).select("bucket", (F.col("r") * (1 - sure / F.col("sd"))).cast("float").alias("r")).toArrow()
    order = np.argsort(found.column(0).to_numpy())
    chosen, r = found.column(0).to_numpy()[order], found.column(1).to_numpy()[order].astype(float)
    picked = [_sample(rows, k, sample) for k in (0, 1)]
    got = _presence(picked[0].unionByName(picked[1]), chosen).collect()
    y = np.array([g["label"] for g in got], float)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(g["has"]) // 4 for g in got])
    col = np.frombuffer(b"".join(bytes(g["has"]) for g in got), "<u4").astype(np.int32)
    weigh = np.where(y == 1, pos / max(1, y.sum()), neg / max(1, (1 - y).sum()))
    weigh /= weigh.sum()
    w, b = np.zeros(len(chosen)), float(np.log(pos / neg))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, (w * r)[col], len(y))
        g = weigh * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        gw, gb = np.bincount(col, g[row], len(w)) * r + penalty * w / len(y) / 100, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        k, n = 1 - 0.9**t, 1 - 0.99**t
        w -= RATE * (m / k) / (np.sqrt(v / n) + 1e-8)
        b -= RATE * (mb / k) / (np.sqrt(vb / n) + 1e-8)
    # A bucket that no sampled text has keeps what the ratios of the others are worth on the whole.
    seen = np.bincount(col, minlength=len(w)) > 0
    w[~seen] = max(0.0, np.average(w[seen], weights=np.abs(r[seen]))) if seen.any() else 0.0
    return Model(chosen, (w * r).astype(np.float32), b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null and empty texts get the score of a text without n-grams of weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, threshold: float, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of the rows whose score is under `threshold`, in one pass over them."""
    rows = docs.select(*columns)
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_from_labels(docs: DataFrame, labels: DataFrame, **params) -> Model:
    """Fit on the labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    marked = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), marked, **params)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Only texts are inputs of a score. Null ids are scored, never trained on. Repeated rows are scored alike; a repeated
    id with two labels counts as label 1. Empty tables give no rows. Further columns are not read.
    """
    scored = score(docs, fit_from_labels(docs, labels, **params))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
