"""Lexical search, chat formatting and cross-tokenizer alignment against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.llm.alignment import Aligner, Transducer, align_tokenizers, byte_level_tokens
from quaymark.llm.chat import HOSTILE, _choose, chat_digests, chat_windows, escape, parse, render, unescape
from quaymark.llm.search import SEARCH_SQL, item_terms, search, term_blocks, terms_of
from quaymark.llm.storage import table

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "\n\tx", "naïve café 北京 🙂🙂", "a▁b", "x\x00y", "<|endoftext|> <s> </s> <0x41>", "word " * 3000, "z" * 5000, "ab" * 3001, "\u00a0 \u2003 '’s don't", "é", "0123 4567 89", "A.B;C"]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clashing(df):
    for name in ("row", "pair", "n", "a", "score", "rank", "term", "first", "cell", "before", "place", "task", "tokens", "own", "loss"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def texts_of(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    for t in [*(t or "" for t in ODD), *("".join(rng.choice("aZ09 ._-@[`{é北\x7f\x80\u0130\u212a\n") for _ in range(60)) for _ in range(300))]:
        assert [x.decode() for part in terms_of(t.encode()) for x in part] == texts_of(t)


def ranked(docs, items, k):
    words = [texts_of(t) for _, t in docs]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(texts_of(t))
    out = set()
    for i, terms in asked.items():
        scores = []
        for (d, _), w, c in zip(docs, words, counts):
            if w:
                m = 50 + 50 * len(w) * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
                if s > 0:
                    scores.append((-s, d is None, d or 0))
        out |= {(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])}
    return out


SEARCHED = [(1, "The cat sat"), (2, None), (3, ""), (4, "the CAT, the cat; the dog"), (5, "..."), (7, "dog dog dog"), (7, "dog dog dog"), (None, "cat"), (None, "cat"), (9, "cat " * 40000), (10, "İ café CAFÉ 北京"), (11, "zebra quagga")]
ASKED = [(1, "Cat dog"), (1, "bird"), (2, None), (3, "nothing known"), (None, "café İ"), (5, "the the THE"), (6, "dog"), (6, "dog")]


@pytest.mark.parametrize("at_once", [1 << 18, 2])
def test_search_by_brute_force(spark, at_once):
    docs = clashing(spark.createDataFrame(SEARCHED, "doc_id long, text string"))
    items = clashing(spark.createDataFrame(ASKED, "item_id long, text string"))
    for k in (2, 50):
        got = search(docs.repartition(3), items, k=k, item_terms_at_once=at_once)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert {tuple(r) for r in got.collect()} == ranked(SEARCHED, ASKED, k)


def test_search_of_the_tables(spark, duck):
    docs, items = (table(spark, SMALL, n) for n in ("documents", "benchmark"))
    got = {tuple(r) for r in search(docs, items).collect()}
    assert got == {tuple(r) for r in duck.execute(SEARCH_SQL).fetchall()}
    assert got == ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 50)


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "cat")], "doc_id long, text string")
    asked = one.withColumnRenamed("doc_id", "item_id")
    assert search(none, asked).count() == 0 and search(one, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert [tuple(r) for r in search(one, asked).collect()] == sorted(ranked([(1, "cat")], [(1, "cat")], 50))


def test_blocks_keep_documents_whole(spark, monkeypatch):
    from quaymark.llm import search as module

    monkeypatch.setattr(module, "BLOCK_DOCS", 2)
    docs = spark.createDataFrame(SEARCHED, "doc_id long, text string").coalesce(1)
    terms = sorted(r["term"].encode() for r in item_terms(spark.createDataFrame(ASKED, "item_id long, text string")).collect())
    rows = term_blocks(docs, {t: i for i, t in enumerate(dict.fromkeys(terms))}).collect()
    assert len(rows) > 3 and max(len(r["ids"]) for r in rows) == 2 and sum(r["n_docs"] for r in rows) == sum(1 for _, t in SEARCHED if texts_of(t))
    assert {tuple(r) for r in search(docs, spark.createDataFrame(ASKED, "item_id long, text string"), k=3).collect()} == ranked(SEARCHED, ASKED, 3)


CONTROLS = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\/INST]", "<", "</s", "\\</s>", "[[INST]]", "<\\\\/s>", "<<s>s>", " [/INST] ", "<s>[INST] user [/INST] hi</s>"]


def test_escaping_is_reversible():
    rng = random.Random(1)
    for t in [*CONTROLS, *("".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "a", "\n", "é"]) for _ in range(12)) for _ in range(3000))]:
        said = escape(t)
        assert unescape(said) == t and not re.search(r"</?s>|\[/?INST\]", said)
        assert parse(render("user", t)[0] + render(t, "x")[0]) == [("user", t), (t, "x")]


def told(rows):
    """Digests of conversations by hand."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for *_, r, _, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, _, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def chats():
    rng = random.Random(8)
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "yes " * 700), (2, 0, "user", None), (2, 1, "assistant", ""), (None, 0, "user", "who"), (None, 0, "user", "who"), (None, 1, "assistant", "me"), (3, None, "system", "s"), (3, 1, None, "r"), (3, 1, "assistant", "q"), (3, 1, "assistant", "p")]
    rows += [(4, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), rng.choice(CONTROLS) + " word" * rng.randrange(60)) for t in range(400)]
    rows += [(5, t, ("user", "assistant")[t % 2], rng.choice(CONTROLS)) for t in range(90)]
    return rows


def test_windows(spark):
    rows = chats()
    rng = random.Random(2)
    shuffled = rng.sample(rows, len(rows))
    convs = clashing(spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string")).repartition(5)
    windows = chat_windows(convs, B_FILE, budget=200, history=60, cell=2).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    size = lambda turn: len(model.encode(render(*turn)[0]))
    by = defaultdict(list)
    for w in windows:
        by[w["conv_id"]].append(w)
    for conv, ws in by.items():
        ws.sort(key=lambda w: w["first"])
        before = []
        for w in ws:
            turns = parse(w["text"])
            old, new = turns[: w["n_repeated"]], turns[w["n_repeated"] :]
            assert w["first"] == len(before) and w["n_tokens"] == sum(map(size, turns))
            assert w["n_tokens"] <= 200 or len(new) == 1  # a turn that fits nowhere stands alone
            system = bool(before) and before[0][0] == "system"
            assert old[:1] == before[:1] if system else True  # the system turn is retained
            kept = old[1:] if system else old
            assert kept == before[len(before) - len(kept) :] and sum(map(size, kept)) <= 60
            assert "".join(unescape(w["text"][a:b]) for a, b in w["loss"]) == "".join(x for r, x in new if r == "assistant")
            before += new
        assert len(before) == sum(1 for c, *_ in rows if c == conv)
    assert len(by[4]) > 20 and any(w["n_repeated"] > 1 for w in by[4])
    # Within a cell windows are as full as can be: none could have taken the next one's first turn.
    one_cell = sorted(chat_windows(convs, B_FILE, budget=200, history=60, cell=1000).where("conv_id in (4, 5)").collect(), key=lambda w: (w["conv_id"], w["first"]))
    assert len(one_cell) > 20
    for a, b in zip(one_cell, one_cell[1:]):
        assert a["conv_id"] != b["conv_id"] or a["n_tokens"] + size(parse(b["text"])[b["n_repeated"]]) > 200


def test_chat_digests(spark):
    rows = chats()
    convs = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_digests(convs, B_FILE).collect()}
    assert got == told([*rows, *HOSTILE])
    assert got[-7][2] == len(HOSTILE[0][3])
    assert {r["conv_id"] for r in chat_digests(convs.limit(0), B_FILE).collect()} == {-7}


def test_chat_digests_of_the_table(spark):
    convs = table(spark, SMALL, "conversations")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_digests(convs, B_FILE).collect()}
    assert got == told([*(tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()), *HOSTILE])


def test_a_turn_too_long_stands_alone():
    turns = [("system", "", 10, 0, True), ("user", "", 500, 1, True), ("assistant", "", 50, 2, True), ("user", "", 30, 3, True)]
    assert list(_choose(turns, 100, 40)) == [(0, 0, 1), (1, 1, 2), (2, 2, 4)]


def aligned_by_hand(texts):
    a = tokenizers.Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    names = byte_level_tokens(A_FILE)
    docs = []
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [names[i] for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            docs.append(None)
            continue
        ea, eb = (list(itertools.accumulate(map(len, parts))) for parts in (ba, bb))
        cuts = sorted(set(ea) & set(eb))
        groups, x, y = [], 0, 0
        for c in cuts:
            p, q = ea.index(c, x) + 1, eb.index(c, y) + 1
            groups.append((ia[x:p], ib[y:q]))
            x, y = p, q
        docs.append((ia, ib, groups))
    seen = Counter(pair for d in docs if d for pair in {(i, j) for g in d[2] for i in g[0] for j in g[1]})
    best = defaultdict(int)
    for (i, _), n in seen.items():
        best[i] = max(best[i], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, groups = d
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((len(ia), len(ib), len(groups), sum(links.values()), sum(n for p, n in links.items() if seen[p] == best[p[0]]), sum(n * seen[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_alignment_by_brute_force(spark):
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice([" ", "the", "ing", "é", "北", "🙂", "\n", "ab", "A", "7", "'s", "  ", ".", "ation"]) for _ in range(rng.randrange(1, 80))) for _ in range(150))]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in align_tokenizers(docs, A_FILE, B_FILE).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, aligned_by_hand([t for _, t in rows])))
    assert align_tokenizers(docs.limit(0), A_FILE, B_FILE).count() == 0


def test_alignment_of_the_table(spark):
    docs = table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in align_tokenizers(docs, A_FILE, B_FILE).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, aligned_by_hand([t for _, t in rows])))


def test_stretches_change_nothing(monkeypatch):
    """Groups of a text cut into stretches are those of the text encoded whole, however little is remembered."""
    from quaymark.llm import alignment

    texts = ["Some words, and more of them: naïve 北京 don't  stop. " * 40, "a b", None, "", "x▁y", "same words, and more of them: stop. z"]
    whole = list(map(Aligner(A_FILE, B_FILE).align, texts))
    monkeypatch.setattr(alignment, "CUT", 50)
    monkeypatch.setattr(alignment, "REMEMBER", 3)
    aligner = Aligner(A_FILE, B_FILE)
    assert len(list(aligner.stretches(texts[0]))) > 20
    for x, t in zip(whole, texts):
        y = aligner.align(t)
        assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()
    assert whole[0][0] > 400 and [x[4] for x in whole[2:5]] == ["", "", ""]


def test_both_encoders_of_the_first_side_agree():
    """Merging by rank gives the tokenizer's ids around every kind of character, and long runs go to the tokenizer."""
    a = Aligner(A_FILE, B_FILE)
    rng = random.Random(11)
    points = [*range(0x3100), *rng.sample(range(0x3100, 0xD800), 3000), *rng.sample(range(0xE000, 0x110000), 6000)]
    texts = [f" a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}.{chr(c)}" for c in points] + ["  ".join(rng.choice(["don't", "I'LL", "x'sy", "\n\n", "\u00a0", "12", "é"]) for _ in range(9)) for _ in range(500)]
    assert a.quick is not None and [e.ids for e in a.a.encode_batch(texts, add_special_tokens=False)] == [a.quick.encode_ordinary(t) for t in texts]
    for run in ("z" * 300_000, " " * 300_000, "ab" * 1000 + " c"):
        ids, _ = a.ids(" " + run)
        assert ids == a.a.encode(" " + run, add_special_tokens=False).ids


def test_the_transducer_alone():
    t = Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"x"])
    assert t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([2, 3, 0, 1], [2, 0, 1]) == ([2, 4], [1, 3])
    assert t.groups([0, 1], [0, 3]) is None and t.groups([0], [0, 1]) is None and t.groups([0, 1], [0]) is None and t.groups([], []) == ([], []) and t.groups([], [0]) is None
    large = Aligner.__new__(Aligner)
    large.width = 10
    keys, times = large._links(np.array([1, 2] * 50 + [4]), np.array([3] * 100 + [5]), np.array([100, 101]), np.array([100, 101]))
    assert dict(zip(keys.tolist(), times.tolist())) == {13: 5000, 23: 5000, 45: 1}
