"""Toxicity, personal data, licenses, quality, pages and pieces against plain versions and held-out rows."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SMALL
from quaymark.llm import licenses, pages, pieces, pii, quality, toxicity
from quaymark.llm.queries import QUERIES
from quaymark.llm.storage import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "null id"), (5, "word " * 30000)]


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for name in ("score", "label", "bucket", "ids", "n_words", "kept", "places", "spans", "w", "g"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_toxicity_held_out(spark):
    rows = toxicity.toxicity(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")).collect()
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.85


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20, 40)], "doc_id long, quality int, toxic int")
    rows = [(i, "you idiot clown" if i % 2 else "kind words only") for i in range(20, 40)] + TEXTS
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r["score"] is not None for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (21, 23)} == {1} and {r["predicted"] for r in got if r["doc_id"] in (20, 22)} == {0}
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.toxicity(docs(spark, TEXTS), labels.limit(0)).count() == len(TEXTS)


def test_email_search_is_the_pattern():
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab@@.. -_é1") for _ in range(rng.randrange(30)))
        assert list(pii.emails(t)) == [m.span() for m in pattern.finditer(t)], t


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(3000):
        t = "".join(rng.choice("0123456789012345678. -+()a") for _ in range(rng.randrange(60)))
        want = [(1, *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, *m.span()) for m in card.finditer(t) if 13 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(3, *m.span()) for m in phone.finditer(t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert [s for s in pii.base_spans(t) if s[0]] == want, t


def test_the_field_adds_spans_and_keeps_base_ones(spark):
    field = pii.train(pii.training_texts(table(spark, SMALL, "documents")))
    t = "call +1 (988) 555-2485 4111111111111111 or mail a.b@c.example.com, version 2.0 of 2024-01-05"
    base, every = pii.find_spans(t, field)
    assert set(base) <= set(every)
    assert {(pii.KINDS[k], t[a:b]) for k, a, b in every} == {("phone", "+1 (988) 555-2485"), ("card", "4111111111111111"), ("email", "a.b@c.example.com")}
    got = pii.pii(docs(spark, TEXTS + [(9, t)]), field).collect()
    assert len(got) == len(TEXTS) + 1 and [r["n_email"] for r in got if r["doc_id"] == 9] == [1]
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got if r["doc_id"] != 9)


def test_spelled_addresses_are_found_without_a_digit_near(spark):
    field = pii.train(pii.training_texts(table(spark, SMALL, "documents")))
    for said in ("john at example dot com", "john [at] example [dot] com", "john(at)example(dot)com", "anna dot smith at example dot com", "anna dot smith at mail dot example dot co dot uk"):
        for text in (f"please write to {said} for a copy of it", f"room 12 on floor 3, or {said} by friday", said):
            found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_spans(text, field)[1]]
            assert ("email", said) in found, (text, found)
    for text in ("they stared at the dot on the wall", "nobody at home, dot your letters", "print at a dot matrix speed"):
        assert pii.find_spans(text, field) == ([], []), text
    groups = "12 34 56 78 90 12 34"
    w = next(pii.windows(f"so {groups} it is"))
    assert any(w.text[w.tokens[j - size][0]:w.tokens[j - 1][1]] == groups for j in range(1, len(w.tokens) + 1) for size in range(1, min(j, pii.LONGEST) + 1))


def test_segmentation_is_the_best_one(spark):
    """The dynamic programme agrees with trying every segmentation of a short window."""
    rng = np.random.default_rng(3)
    field = pii.Field(rng.normal(size=(5, len(pii.NAMES))), rng.normal(size=(5, 5)))
    text = "x 12 3.4.5.6 y@z.com"
    w = next(pii.windows(text))
    s, n = field.scores(w), len(w.tokens)

    def every(at, last):
        if at == n:
            yield 0.0, []
        for size in range(1, min(pii.LONGEST, n - at) + 1):
            for y in range(5):
                if s[at + size, size - 1, y] > -np.inf:
                    for rest, spans in every(at + size, y):
                        yield field.follow[last, y] + s[at + size, size - 1, y] + rest, [(at, at + size, y), *spans]

    best = max(every(0, 0))[1]
    want = [(y - 1, *pii.trimmed(text, w.tokens[a][0], w.tokens[b - 1][1])) for a, b, y in best if y]
    assert field.spans(w, margin=-1e9) == want


def test_license_scan(spark):
    rows = [(10, "Licensed under the Apache License, Version 2.0."), (11, "licensd undr the Apache Licence version 2.0"), (12, "The MIT LICENSE mit license"), (13, "nothing of the sort")]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows + TEXTS)).collect()}
    assert (got[10]["n_words"], got[10]["n_base"], got[10]["first_word"], got[10]["labels"]) == (8, 1, 3, "apache,apache-2.0")
    assert got[11]["n_base"] == 0 and got[11]["first_word"] is None and got[11]["labels"] == "apache-2.0" and 0.8 < got[11]["score"] < 1
    assert (got[12]["n_base"], got[12]["first_word"], got[12]["last_word"]) == (2, 1, 3) and got[13]["score"] == 0 and got[1]["n_words"] == 0


def loose(notice):
    """Places of a notice at which an edit leaves its telling words as they are."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", notice) if m[0] not in licenses.TELLING]
    return [i for a, b in words for i in range(a, b)]


def edited(notice, at, rng):
    t = list(notice)
    for i in at:
        t[i] = rng.choice(["", "q", t[i] + "z"])
    return "".join(t)


def test_license_seeds_find_every_match_within_the_errors():
    rng, s = random.Random(6), licenses.Scanner()
    for notice, k, label in licenses.NOTICES:
        for _ in range(15):
            t = edited(notice, [i for i in rng.sample(loose(notice), min(len(loose(notice)), rng.randrange(k + 1)))], rng)
            found = s.fuzzy("lead in " + t + " and on")
            n = [x for x, _, _ in licenses.NOTICES].index(notice)
            assert any(f.length for f in found) and (s.patterns[n].search(t) is not None)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_notices_side_by_side_are_all_found():
    """Each of two edited copies, whichever is the better one, has a find with no more errors than a full comparison counts."""
    rng, s = random.Random(9), licenses.Scanner()
    for n, (notice, k, _) in enumerate(licenses.NOTICES):
        for _ in range(12):
            copies = []
            for _ in range(2):
                t = list(notice)
                inner = [i for i in loose(notice) if 2 <= i < len(t) - 2]
                copies.append(edited(notice, rng.sample(inner, min(len(inner), rng.randrange(k + 1))), rng))
            text = "so " + " or ".join(copies) + " it is"
            got, start = list(s.places(n, text, 0, len(text))), 3
            assert len(got) == 2
            for copy in copies:
                assert any(m.start() < start + len(copy) and start < m.end() and sum(m.fuzzy_counts) <= distance(copy, notice) for m in got), text
                assert any(f.start < start + len(copy) and start < f.end for f in s.fuzzy(text)), text
                start += len(copy) + 4
    two = s.fuzzy("licensd undr the gnu general public licence version 2 or licensed under the gnu general public license version 3")
    assert [(f.label, f.errors) for f in two] == [("gpl-2.0", 3), ("gpl-3.0", 0)]


def test_quality_counts(spark):
    d = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(docs(spark, TEXTS).select("doc_id", "text"))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for r in d.collect():
        w, lines = word.findall(r["text"] or ""), [x for x in (r["text"] or "").split("\n") if word.search(x)]
        seen, covered = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i:i + 5])] > 1:
                covered.update(range(i, i + 5))
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"] or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.quality_verdicts(d).collect()
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(want, key=repr)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    assert quality.quality_verdicts(docs(spark, [])).count() == 0


def test_label_model_finds_planted_rates():
    """80 % good texts with few votes to drop, and three ways of being bad: one seen by one rule, one by another, one by two."""
    rng, votes = random.Random(8), Counter()
    seen = {0: (0.01, 0.03, 0.02, 0.02), 1: (0.9, 0.03, 0.02, 0.02), 2: (0.01, 0.8, 0.02, 0.02), 3: (0.01, 0.03, 0.9, 0.85)}
    for _ in range(30000):
        c = rng.choices([0, 1, 2, 3], [0.8, 0.08, 0.07, 0.05])[0]
        votes[tuple(0 if rng.random() < 0.1 else -1 if rng.random() < p else 1 for p in seen[c])] += 1
    model = quality.label_model(sorted(votes.items()))
    assert abs(model.shares[0] - 0.8) < 0.06
    for k, p in enumerate(seen[0]):
        r = model.rates[0][k]
        assert abs(r[-1] / (r[-1] + r[1]) - p) < 0.03
    good = lambda *v: model.posterior(v)[0]
    assert good(1, 1, 1, 1) > 0.95 and good(-1, 1, 1, 1) < 0.5 and good(1, 1, -1, -1) < 0.05


def test_label_model_without_documents():
    assert quality.label_model([]).shares == [0.9]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>no";</script></head><body><header class=top>Site</header><nav><a href=/>Home</a></nav>
<div class="content"><h1>Head &amp; line</h1><p>First <b>bold</b>face para&shy;graph that is long enough to matter.<p>Second<br>one, with a <a href=x>link</a> in it.</div>
<div class="sidebar">Side text that is rather long as well, to tempt a scorer that counts characters only</div><div id="comments"><p>Reader says hello</p></div><form>Sign up</form><footer>&copy; us</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://a.example.com/{i}", PAGE) for i in range(4)] + [(5, None, None), (6, "http://b.example.com/", ""), (6, "http://b.example.com/", ""), (7, "nonsense", "plain text only"), (8, "http://a.example.com/x", "<p>lone"), (9, "http://a.example.com/y", PAGE[:400])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("paths", F.lit(1))
    got = {r["page_id"]: r for r in pages.main_text(df).collect()}
    assert got[0]["text"] == "Head & line First boldface para\xadgraph that is long enough to matter. Second one, with a link in it."
    assert got[0]["n_chars"] == len(got[0]["text"]) and got[0]["path"] == "html>body>div.content"
    assert (got[5]["text"], got[6]["n_chars"], got[7]["text"], got[8]["text"]) == ("", 0, "plain text only", "lone") and got[9]["text"].startswith("Head & line First")
    assert pages.main_text(df.limit(0)).count() == 0


def test_pieces_are_the_librarys(spark):
    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Codec(MODEL), random.Random(1)
    texts = ["", " ", "  a  b ", "a\nb\tc", "日本語 é", "ﬁ①　x", "\x00", "🤗🤗", "<s> x </s>", "a" * 500, "ab" * 300] + [" " * k + "a b" for k in range(70)] + [" " * k for k in range(70)]
    texts += ["".join(rng.choice("aabeet hinsr  \n▁é🤗日") for _ in range(rng.randrange(200))) for _ in range(800)] + ["".join(rng.choice("thequickbrown") for _ in range(4000))]
    for t, ids in zip(texts, codec.encode_all(texts)):
        want = [1, *lib.encode(t), 2]
        assert ids.tolist() == want and codec.decode(ids) == lib.decode(want), repr(t[:60])
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259)]) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, np.int64)) == lib.decode(ids)


def test_round_trip(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.round_trip(docs(spark, TEXTS), MODEL).collect()
    want = []
    for i, t in TEXTS:
        ids = [1, *lib.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    back = pieces.decode_table(pieces.encode_table(docs(spark, TEXTS), MODEL), MODEL).collect()
    assert sorted((r["text"] for r in back)) == sorted((t or "") for _, t in TEXTS)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("op1_toxicity",)))
def test_queries_cover_their_tables(spark, name):
    t = "pages" if name.startswith("op6") else "documents"
    assert QUERIES[name](spark, SMALL).count() == table(spark, SMALL, t).count()


def quick(seconds, f, *args):
    began = time.perf_counter()
    out = f(*args)
    assert time.perf_counter() - began < seconds
    return out


def test_long_runs_take_time_in_proportion():
    field = pii.Field(np.zeros((5, len(pii.NAMES))), np.zeros((5, 5)))
    assert quick(10, pii.base_spans, "7" * 1_000_000) == []
    assert len(quick(20, pii.base_spans, "10.1.2.3 " * 50_000)) == 50_000
    assert len(quick(60, pii.find_spans, "a@b.cd and then some " * 3_000, field)[0]) == 3_000
    s = licenses.Scanner()
    assert len(quick(60, s.fuzzy, "licensed under the mit license and then some other words " * 1_000)) == 1_000
    cells = "<table>" + "<tr><td class=c>some words in a cell" * 20_000
    assert quick(60, pages.extract, cells, ["table>tr>td.c"])[0].count("cell") == 20_000
    assert quick(60, pages.extract, "<div>" * 3_000 + "words" + "</p>" * 50_000, [])[0] == "words"


WRAPPERS = ("layout no-sidebar", "content has-sidebar", "post-with-comments", "single header-fixed", "article-page cookie-accepted", "page search-enabled", "row related-off", "nav-open wrapper", "sidebar", "promo")


def test_a_wrapper_keeps_its_article():
    """What a name says of a wrapper doesn't empty the page; what is junk inside still goes."""
    article = "<p>" + "the words of the article go on. " * 20 + "</p>"
    for name in WRAPPERS:
        for attribute in ("class", "id"):
            page = f"<body><nav><a href=x>Home</a></nav><div {attribute}='{name}'><article>{article}<div class='comment-list'>bad</div><aside>bad</aside><p>end</p></article></div><div class=site-footer>bad</div><div id=cookieBanner>bad</div></body>"
            text, _ = pages.extract(page, [])
            assert text.startswith("the words") and text.endswith("on. end") and "bad" not in text and "Home" not in text, name
    assert [pages.doubtful(n) for n in ("site-footer", "comment-list", "mainNav", "ad", "related-posts widget", "share-buttons")] == [True] * 6
    assert not any(pages.doubtful(n) for n in ("", "header2column", "download", "story", "advanced", "shared-memory", "is-menu"))


def test_a_host_may_keep_its_articles_where_names_say_otherwise(spark):
    """Votes of a host's pages overrule the word list, also for its page with too little text to do so alone."""
    long, short = "some words of a long article here " * 12, "a short one"
    page = lambda text, rest: f"<body><div class=promo><p>{text}</p></div><div class=other><p>{rest}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(long + str(i), "x")) for i in range(6)] + [(9, "http://h.example/9", page(short, "another text, as long as that one"))]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == short and got[3] == (long + "3").strip()
    assert pages.extract(rows[-1][2], [])[0] != short


def test_hostile_pages_take_time_in_proportion():
    for unit in ("<a ", '<a "', "<a '\"", '<div class="x', "<", "<!--", "<a href='x' ", "<script>", "<blockquote>x", "<li>y", "</p>", "<p class='a", '<i ""', "<b a=\"'\""):
        quick(30, pages.extract, unit * (500_000 // len(unit)), [])
        quick(30, pages.extract, unit * (500_000 // len(unit)) + '">', ["a>b"])


def test_tags_are_those_of_the_pattern():
    """The scanner finds what one pattern over the whole page finds."""
    pattern = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>"']*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
    rng = random.Random(5)
    for _ in range(4000):
        source = "".join(rng.choice(["<", ">", '"', "'", "a", "/", " ", "!", "--", "=", "<p", "</p", "<!--", "-->", "?"]) for _ in range(rng.randrange(25)))
        want = [(m.start(), m.end(), m[1] == "/", (m[2] or "").lower(), m[3] or "") for m in pattern.finditer(source)]
        tags, at, got = pages.Tags(source), 0, []
        while found := tags.next(at):
            got.append(found)
            at = found[1]
        assert got == want, source


def plain_pages(rows):
    """Scores, votes and texts of a whole table, straight from their definitions."""
    best, votes = {}, {}
    for i, url, source in rows:
        page = pages.parse(source)
        inside = lambda n, k: k == n or (k > 0 and inside(n, page.nodes[k].parent))
        texts = [(n, p, k in page.linked) for k, (n, p) in enumerate(page.events) if p is not None and not page.nodes[n].hard]
        scores = []
        for n, node in enumerate(page.nodes):
            if node.hard or node.tag in pages.LEAVES:
                continue
            own = 0.0
            for at, piece, linked in texts:
                holder = page.nodes[at].holder
                own += 0 if linked else len(piece.strip()) * ((holder == n) + 0.5 * (holder > 0 and page.nodes[holder].parent == n))
            weight = 1.5 if node.tag in ("article", "main") else 1.25 if node.names & pages.GOOD else 1.0
            around, doubt = n, False
            while around > 0:
                doubt, around = doubt or page.nodes[around].doubtful, page.nodes[around].parent
            if own > 0:
                scores.append((own * weight * (0.1 if doubt else 1.0), -n))
        best[i] = sorted(scores, reverse=True)[:3]
        host = re.match(pages.HOST, url or "")
        of = votes.setdefault(host[1].lower() if host else "", {})
        for score, n in best[i]:
            path = ">".join(page.nodes[-n].path)
            of[path] = of.get(path, 0) + round(1e6 * score / sum(s for s, _ in best[i]))
    out = {}
    for i, url, source in rows:
        page, host = pages.parse(source), re.match(pages.HOST, url or "")
        of = votes[host[1].lower() if host else ""]
        led = sorted(of, key=lambda p: (-of[p], p))[:3]
        led = [p for p in led if of[p] >= 0.2 * of[led[0]]]

        def said(n):
            def kept(k):
                return k == n or (not page.nodes[k].hard and not page.nodes[k].doubtful and kept(page.nodes[k].parent))

            return " ".join("".join("\0" if p is None else p for p in [p if p is None or kept(k) else "" for k, p in page.events[page.nodes[n].first:page.nodes[n].last]]).replace("\0", " ").split())

        text = ""
        for path in led:
            at = [n for n, node in enumerate(page.nodes) if not node.hard and ">".join(node.path) == path]
            outer = [n for n in at if not any(m != n and page.nodes[m].first <= page.nodes[n].first and page.nodes[n].last <= page.nodes[m].last and m < n for m in at)]
            text = " ".join(filter(None, map(said, outer)))
            if text:
                break
        out[i] = text or (said(-best[i][0][1]) if best[i] else "")
    return out


def test_pages_of_the_table_by_plain_votes(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "pages").select("page_id", "url", "html").collect()]
    rows += [(1000 + k, f"http://w.example/{k}", f"<body><div class='{name}'><p>{'words here ' * (k + 3)}</p><div class=related>see also {k}</div></div><div class=comments>{'loud ' * 9 * (k % 3)}</div></body>") for k, name in enumerate(WRAPPERS)] + [(2000, None, "<p>alone"), (2001, "x", None)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == plain_pages(rows)


def test_spelled_addresses_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice([" ", "  ", "a", "b.c", "at", "dot", "[at]", "(dot)", "{ at }", "<", "]", "x-y", " at ", " dot ", "\n", "AT", "é", "1"]) for _ in range(rng.randrange(3, 14)))
        if "at at" not in " ".join(text.lower().split()):  # which of two signs in a row is a name is a matter of taste
            assert list(pii.spelled_addresses(text)) == [m.span() for m in pii.SPELLED.finditer(text)], text
    field = pii.Field(np.zeros((5, len(pii.NAMES))), np.zeros((5, 5)))
    for unit in ("a dot ", "a dot b at ", "at ", "dot ", "[at] ", "  ", " at", "x[ dot"):
        found = quick(20, lambda t: list(pii.spelled_addresses(t)), unit * (1_000_000 // len(unit)))
        assert bool(found) == (unit == "a dot b at ")
        quick(60, pii.base_spans, unit * 20_000)
    assert len(quick(60, pii.find_spans, "word dot " * 30_000, field)[0]) == 0


def test_pages_with_tags_left_out():
    for page in ("<html><head><title>t</title><body><article><p>the words of a page", "<html><head><meta charset=x><p>the words of a page", "<div><p><a href=x>link<p>the words of a page</div>"):
        text, _ = pages.extract(page, [])
        assert text.endswith("the words of a page")
    deep = lambda outer: pages.parse(f"<{outer}>" + "<div>" * 14 + "x")
    assert deep("main").nodes[-1].path != deep("section").nodes[-1].path and len(deep("main").nodes[-1].path) == pages.LEVELS


def test_licenses_are_not_taken_for_one_another():
    """A notice has its own label and no other; what isn't listed has none, however near it is."""
    s = licenses.Scanner()
    labels = lambda text: {f.label for f in s.scan(text)[2]}
    for notice, _, label in licenses.NOTICES:
        assert labels(f"so it is {notice} and on") == {label}, notice
    for text, want in (
        ("This work is licensed under CC BY 4.0.", set()), ("licensed under CC BY, 2019", set()), ("licensed under CC BY-ND 4.0", {"cc-by-nd"}), ("licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}), ("released under the BSD license", {"bsd"}),
        ("the ISC license", set()), ("licensed under the ISC license", {"isc"}), ("licensed under the EPL license", {"epl"}), ("licensed under the GNU General Public License version 1", set()), ("Licensed undr the GNU Genral Public License, version 3", set()),
        ("Licensd undr the GNU General Public Licence, version 3", {"gpl-3.0"}), ("licensed under the WTF license", set()), ("SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}), ("SPDX-License-Identifier: MPL-2.0", set()), ("licensed under the MITE license", set())):
        assert labels(text) == want, text


def test_license_search_is_that_of_all_windows():
    """Every stretch of a text that a full comparison finds within the errors of a notice meets a find, without seeds."""
    rng, s = random.Random(12), licenses.Scanner()
    for n, (notice, k, _) in enumerate(licenses.NOTICES[:8]):
        for _ in range(4):
            t = edited(notice, rng.sample(loose(notice), k), rng)
            text = " ".join(["words before it", t, notice, "and between", t[::-1], "end"])
            finds = s.fuzzy(text)
            for size in (len(notice), len(notice) - k):
                for at in range(0, len(text) - size, 3):
                    if distance(text[at:at + size], notice) <= k - 2:
                        assert any(f.start < at + size and at < f.end for f in finds), (text, at)


def test_scores_are_those_of_a_plain_scorer(spark):
    """Weights looked up n-gram by n-gram give the same score, in texts shorter and longer than a piece."""
    rng = np.random.default_rng(2)
    at = np.flatnonzero(rng.random(1 << toxicity.BITS) < 0.3)
    model = toxicity.Model(at, (rng.normal(size=len(at)) / 100).astype(np.float32), -1.0)
    weight = dict(zip(at.tolist(), model.weights.tolist()))

    def bucket(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x01000193 + ord(c)) % 2**32
        h = ((h ^ (h >> 15)) * 0x9E3779B1 + 0x85EBCA6B * len(gram)) % 2**32
        return h >> (32 - toxicity.BITS)

    texts = [None, "", "a", "Some WORDS é 🤗 and more", "ab " * 300, "x1 " * 200_000]
    for text in texts:
        t = f" {(text or '').lower()} "
        seen = {bucket(t[i:i + n]) for n in toxicity.LENGTHS for i in range(len(t) - n + 1)}
        x = -1.0 + sum(weight.get(b, 0.0) for b in seen)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-4)
    got = toxicity.score(docs(spark, list(enumerate(texts))), model).collect()
    assert [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])] == pytest.approx([model.score(t) for t in texts])


def test_an_id_with_two_labels_counts_as_toxic(spark):
    rows = [(i, "you idiot clown" if i % 2 else "kind words only") for i in range(20, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 60)] + [(i, 0) for i in range(21, 60, 2)] + [(20, None), (None, 1), (22, 7)], "doc_id long, label int")
    model = toxicity.fit(docs(spark, rows).select("doc_id", "text"), labels)
    assert model.score("you idiot") > 0.5 > model.score("kind words")
