"""Each stage works on what the one before kept, does what its operator decides, and holds for nulls, ties and repeats."""

import itertools
import re
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.llm.storage import table
from test_dedup import brute_fingerprint, brute_mix, roots, windows

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "one line of text here\nand another line of text", "en", "a", 1), (2, "one line of text here\nsomething else altogether", "en", None, 2),
    (3, None, None, "a", None), (4, "", "en", "b", 0), (5, "same text in two rows of the table", "en", "b", 1), (5, "same text in two rows of the table", "en", "b", 1),
    (None, "a text without an id", "en", "b", 1), (None, "another text without one", None, "a", 1), (6, "long " * 20000, "en", "a", 1),
]


def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("__clash", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("slot", F.lit("clash")).select(*SCHEMA.replace(",", "").split()[::2])


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_a_stage_holds_for_an_empty_table(spark, name, stage):
    assert stage(spark, edge(spark).limit(0), SMALL).count() == 0


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_a_stage_keeps_the_columns_and_adds_no_text(spark, name, stage):
    out = stage(spark, edge(spark), SMALL)
    assert set(out.columns) == COLUMNS
    have, were = {(r["doc_id"], r["text"]) for r in out.collect()}, {(r[0], r[1]) for r in ROWS}
    if name == "toxicity":
        assert len(have) >= len(were) - 1
    if name == "line dedup":
        assert out.count() == len(ROWS) and (None, ROWS[6][1]) in have and (2, "something else altogether") in have and (3, None) in have
    if name == "simhash near-dedup":
        assert {i for i, _ in have} == {1, 2, 3, 5, 6, None} and out.where("doc_id = 5").count() == 2 and out.where("doc_id is null").count() == 2
    if name == "mixing":
        assert have <= were and {i for i, _ in have} >= {6} and not {3, 4} & {i for i, _ in have}


def test_near_copies_by_brute_force(spark):
    d = table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = roots(list(texts), [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r["doc_id"] for r in P.simhash_stage(spark, d, SMALL).collect()} == {i for i in texts if root[i] == i}


def test_mixing_by_brute_force(spark):
    d = table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in d.collect()]
    taken, _, _ = brute_mix(rows)
    size = {i: n for i, _, n in rows}
    got = Counter(r["doc_id"] for r in P.mixing_stage(spark, d, SMALL).collect())
    # Taken words say how many rounds a document was begun in, but for where a stretch ends in the first words of a round.
    assert got == Counter({i: -(-t // size[i]) for i, t in taken.items() if t})


def test_stages(spark):
    docs, seen = table(spark, SMALL, "documents"), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SMALL).cache()
        seen.append((name, docs, out))
        if k < len(P.STAGES) - 1:
            assert set(out.columns) == COLUMNS
        docs = out
    (_, d, tox), (_, _, lines), (_, _, near), (_, _, mixed), (_, _, ids) = seen
    assert 0 < tox.count() < d.count() and lines.count() == tox.count()
    kept = [x for r in lines.collect() for x in r["text"].split("\n") if x.strip()]
    assert len(kept) == len({x.strip() for x in kept})
    sets = [windows(x.strip()) for x in kept]
    by_shingle = {}
    for n, s in enumerate(sets):
        for w in s:
            by_shingle.setdefault(w, []).append(n)
    near_pairs = {(a, b) for at in by_shingle.values() for a, b in itertools.combinations(at[:50], 2)}
    missed = [p for p in near_pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    dropped = sum(len([x for x in r["text"].split("\n") if x.strip()]) for r in tox.collect()) - len(kept)
    assert len(missed) <= 0.1 * max(dropped, 10)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    assert near.count() <= lines.count() and near.count() == near.select("doc_id").distinct().count()
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], len(lib.encode(r["text"])) + 2) for r in mixed.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in ids.collect()) == want


def test_run_is_its_stages(spark):
    assert P.run(spark, SMALL).count() > 0
