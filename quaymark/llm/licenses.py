"""License scans: short notices found with errors, beside phrases found as they stand."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Phrases whose places are always reported, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices and the errors (characters put in, left out or changed) that still make one, with the label they give.
NOTICES = (
    ("licensed under the apache license version 2 0", 4, "apache-2.0"),
    ("licensed under the gnu general public license version 3", 5, "gpl-3.0"),
    ("licensed under the gnu general public license version 2", 5, "gpl-2.0"),
    ("licensed under the gnu lesser general public license", 5, "lgpl"),
    ("licensed under the gnu affero general public license", 5, "agpl"),
    ("released under the mit license", 3, "mit"),
    ("licensed under the mit license", 3, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", 7, "mit"),
    ("licensed under cc by nc", 2, "cc-by-nc"),
    ("licensed under cc by sa", 2, "cc-by-sa"),
    ("licensed under cc by nd", 2, "cc-by-nd"),
    ("licensed under cc by nc sa", 2, "cc-by-nc-sa"),
    ("licensed under cc by nc nd", 2, "cc-by-nc-nd"),
    ("dedicated to the public domain under cc0", 4, "cc0"),
    ("licensed under creative commons attribution", 4, "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", 8, "bsd"),
    ("licensed under the bsd license", 3, "bsd"),
    ("released under the bsd license", 3, "bsd"),
    ("licensed under the isc license", 3, "isc"),
    ("released under the isc license", 3, "isc"),
    ("permission to use copy modify and or distribute this software for any purpose", 7, "isc"),
    ("licensed under the epl license", 3, "epl"),
    ("licensed under the eclipse public license", 4, "epl"),
    ("subject to the terms of the mozilla public license", 5, "mpl"),
    ("this is free and unencumbered software released into the public domain", 7, "unlicense"),
    ("spdx license identifier apache 2 0", 3, "apache-2.0"),
    ("spdx license identifier mit", 3, "mit"),
    ("spdx license identifier gpl 2 0", 3, "gpl-2.0"),
    ("spdx license identifier gpl 3 0", 3, "gpl-3.0"),
    ("spdx license identifier bsd 3 clause", 3, "bsd"),
    ("all rights reserved", 2, "all-rights-reserved"),
)
#: Words that tell one notice from another: where a notice has one, it must stand there as a word, without an error.
TELLING = {
    "0", "2", "3", "affero", "apache", "attribution", "bsd", "by", "cc", "cc0", "commons", "domain", "eclipse", "epl", "general", "gnu", "gpl", "isc", "lesser", "mit", "mozilla", "nc", "nd", "sa", "spdx", "unencumbered",
}
#: Words are digits, letters a to z after lower-casing, and everything beyond ASCII; in UTF-8 that is a set of bytes.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Find:
    label: str
    word: int  # place of its first word
    start: int  # characters of the normalised text
    end: int
    errors: int
    length: int


def normalised(text: str | None) -> str:
    """The words of a text, lower-cased in A-Z, with one space between."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split(b" ")
    return b" ".join(filter(None, words)).decode("utf-8", "surrogatepass")


class Scanner:
    """Pigeonhole search: a notice with at most k errors holds one of its k + 1 parts unchanged.

    The parts of all notices are seeds of one Aho-Corasick automaton. Where a seed occurs, the stretch of text that the whole
    notice could take is searched with the regex library's bounded-error matching, which settles errors and span.
    """

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices, self.phrases = notices, phrases
        self.patterns = [self.pattern(text, k) for text, k, _ in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (text, k, _) in enumerate(notices):
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for seed, at in seeds.items():
            self.seeds.add_word(seed, (len(seed), at))
        self.seeds.make_automaton()

    @staticmethod
    def pattern(notice: str, k: int) -> regex.Pattern:
        """Telling words as they are; what lies between them with up to k errors. The errors of all parts are counted when it is found."""
        out, loose = [], ""

        def close() -> None:
            nonlocal loose
            if loose:
                out.append(f"(?:{regex.escape(loose)}){{e<={k}}}" if loose.strip() else " ")
            loose = ""

        for i, word in enumerate(notice.split(" ")):
            loose += " " if i else ""
            if word in TELLING:
                close()
                out.append(f"(?<![^ ]){regex.escape(word)}(?![^ ])")
            else:
                loose += word
        close()
        return regex.compile("(?be)" + "".join(out))

    def base(self, text: str) -> list[tuple[int, str]]:
        """(word, label) of every place where a phrase stands in a normalised text."""
        padded, found = f" {text} ", []
        for phrase, label in self.phrases:
            sought, at = f" {phrase} ", padded.find(f" {phrase} ")
            while at >= 0:
                found.append((at, label))
                at = padded.find(sought, at + 1)
        found.sort()
        out, word, last = [], 0, 0
        for at, label in found:
            word += padded.count(" ", last, at)
            last = at
            out.append((word, label))
        return out

    def places(self, n: int, text: str, lo: int, hi: int) -> Iterator[regex.Match]:
        """Disjoint matches of a notice in a stretch: the best one, then those left and right of it, and so on."""
        notice, k, _ = self.notices[n]
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            m = self.patterns[n].search(text, lo, hi) if hi - lo >= len(notice) - k else None
            if m and sum(m.fuzzy_counts) <= k:  # the best one; where it has too many errors all have
                yield m
                todo += [(lo, m.start()), (m.end(), hi)]

    def stretches(self, n: int, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """A window without the places where the notice stands unchanged, which nothing beats, in pieces of a few lengths of the
        notice that overlap by the longest match: every other place lies whole in one of them."""
        notice, k, _ = self.notices[n]
        size = len(notice) + k
        while lo < hi:
            at = text.find(notice, lo, hi)
            end = at if at >= 0 else hi
            for a in range(lo, max(lo + 1, end - size), 3 * size):
                yield a, min(end, a + 4 * size)
            if at < 0:
                break
            yield at, at + len(notice)
            lo = at + len(notice)

    def fuzzy(self, text: str) -> list[Find]:
        """The notices in a normalised text; of those that overlap, the one with the smallest share of errors."""
        spaces = [m.start() for m in regex.finditer(" ", text)]
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for n, offset in where:
                notice, k, _ = self.notices[n]
                lo = end - size + 1 - offset
                lo, hi = max(0, lo - k), min(len(text), lo + len(notice) + k)
                mine = windows.setdefault(n, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(lo, mine[-1][0]), max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        out = []
        for n, spans in windows.items():
            notice, _, label = self.notices[n]
            for lo, hi in spans:
                for a, b in self.stretches(n, text, lo, hi):
                    if text.startswith(notice, a) and b - a == len(notice):
                        out.append(Find(label, bisect_left(spaces, a), a, b, 0, len(notice)))
                        continue
                    for m in self.places(n, text, a, b):
                        start = m.start() + (m[0][:1] == " ")
                        out.append(Find(label, bisect_left(spaces, start), start, m.end(), sum(m.fuzzy_counts), len(notice)))
        best: list[Find] = []
        starts: list[int] = []  # of the finds kept, which don't overlap
        for f in sorted(out, key=lambda f: (f.errors / f.length, -f.length, f.start, f.label)):
            at = bisect_left(starts, f.start)
            if (not at or best[at - 1].end <= f.start) and (at == len(best) or f.end <= starts[at]):
                best.insert(at, f)
                starts.insert(at, f.start)
        return best

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Find]]:
        words = normalised(text)
        return (words.count(" ") + 1 if words else 0), self.base(words), self.fuzzy(words)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, places (word, label of every phrase) and finds (notices with errors, and spans).

    Spans are in characters of the normalised text: words lower-cased in A-Z, one space between. A null text is the empty
    one, with no words and no finds. Null ids and repeated rows are rows like others; an empty table gives no rows; only
    the two named columns are read. Whole texts are searched, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        find = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            got = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in got], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in b] for _, b, _ in got], place),
                pa.array([[vars(f) for f in x] for _, _, x in got], find),
            ], ["doc_id", "n_words", "places", "finds"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<word:long,label:string>>, "
        "finds array<struct<label:string,word:long,start:long,end:long,errors:long,length:long>>",
    )


def license_scan(docs: DataFrame, **params) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score and n_finds.

    score is 1 where a phrase stands, else the best notice's share of characters without error, else 0.
    """
    spans = license_spans(docs, **params)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("finds", lambda f: 1 - f["errors"] / f["length"]))
    return spans.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.word")).alias("first_word"), F.array_max(F.col("places.word")).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat(F.col("places.label"), F.col("finds.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("finds").cast("long").alias("n_finds"),
    )

