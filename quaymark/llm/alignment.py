"""Tokens of two tokenizers aligned by a transducer over dangling suffixes, and how often their ids meet."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .storage import whole_if_small, written

#: Both tokenizers begin anew before a single space between a visible character and a letter of ASCII: long texts are encoded in
#: stretches of about CUT characters that end there.
SAFE = re.compile(r"(?<=[!-~])(?= [A-Za-z])")
CUT = 1 << 16
#: Runs that an encoder by ranks takes quadratic time for; stretches with one are encoded by the tokenizer itself.
RUN = re.compile(r"\S{1000}|\s{1000}")
# Fixed value: how a byte-level tokenizer cuts a text before it merges.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Transitions remembered by a worker before it begins anew, and pairs of a group's tokens from which on its ids are counted first.
REMEMBER, LARGE = 1 << 20, 4096
PAIRS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>"


class Transducer:
    """Reads two token sequences over the same bytes and closes a group wherever both end at one place.

    A state is which side is ahead and the bytes by which it is; the other side's next token either uses up part of them, or all
    and is ahead by the rest, or contradicts them. Transitions are kept by state and token.
    """

    def __init__(self, a_bytes: dict[int, bytes] | list[bytes], b_bytes: list[bytes]):
        self.of = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[bool, bytes]] = [(False, b"")]  # (A is ahead, by these bytes)
        self.ahead: list[bool] = [False]
        self.number = {self.states[0]: 0}
        self.steps: list[dict[int, int]] = [{}]
        self.both: dict[tuple[int, int], int] = {}  # from the empty residual by a token of either side
        self.room = REMEMBER

    def _step(self, state: int, token: int) -> int:
        """The state after the side that is behind (A, where neither is) reads a token; -1 where the bytes differ."""
        a_ahead, rest = self.states[state]
        new = self.of[1 if a_ahead else 0][token]
        if rest.startswith(new):
            after = (a_ahead, rest[len(new) :])
        elif new.startswith(rest):
            after = (not a_ahead, new[len(rest) :])
        else:
            return -1
        after = after if after[1] else (False, b"")
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
            self.ahead.append(after[0])
            self.steps.append({})
        self.room -= 1
        self.steps[state][token] = self.number[after]
        return self.number[after]

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of each side are read at the end of each group; None where the bytes differ or one side is left over."""
        if self.room < 0:
            self.forget()
        steps, ahead, both = self.steps, self.ahead, self.both
        i = j = 0
        a_ends: list[int] = []
        b_ends: list[int] = []
        n = len(a)
        try:
            while i < n:
                pair = (a[i], b[j])
                i += 1
                j += 1
                state = both.get(pair)
                if state is None:
                    state = self._step(0, pair[0])
                    state = both[pair] = self._step(state, pair[1]) if state > 0 else -1
                    self.room -= 1
                while state > 0:
                    if ahead[state]:
                        token = b[j]
                        j += 1
                    else:
                        token = a[i]
                        i += 1
                    after = steps[state].get(token)
                    state = self._step(state, token) if after is None else after
                if state < 0:
                    return None
                a_ends.append(i)
                b_ends.append(j)
        except IndexError:
            return None
        return (a_ends, b_ends) if j == len(b) else None


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1, else the
    next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_tokens(path: str) -> dict[int, bytes]:
    """Bytes of a byte-level vocabulary's entries; added tokens are plain text in UTF-8."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    entries = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return {t["id"]: t["content"].encode() for t in spec["added_tokens"]} | entries


def piece_tokens(model) -> list[bytes]:
    """Bytes of a sentencepiece model's pieces."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.vocab_size()) for p in [model.id_to_piece(i)]]


def by_ranks(path: str):
    """An encoder of a byte-level tokenizer's file that merges by rank, or None where ids don't stand in the order of the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")
    if not plain or made != sorted(made) or made[:1] != [256] or len(model["vocab"]) != 256 + len(made):
        return None
    added = {t["id"] for t in spec["added_tokens"]}
    ranks = {b: i for i, b in byte_level_tokens(path).items() if i not in added}
    return tiktoken.Encoding("byte-level", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.quick = by_ranks(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes, self.b_bytes = byte_level_tokens(a_file), piece_tokens(self.b)
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.width = max(self.b.vocab_size(), 1)
        self.top = (max(self.a_bytes) + 1) * self.width
        # Ids as text with what follows: a comma, or the end of the group's side.
        self.a_text = [np.array([f"{i}{sign}" for i in range(max(self.a_bytes) + 1)], "S") for sign in ",|"]
        self.b_text = [np.array([f"{i}{sign}" for i in range(self.width)], "S") for sign in ",;"]

    def stretches(self, text: str) -> Iterator[str]:
        """Stretches of space+text that are encoded apart."""
        full, at = " " + text, 0
        while at < len(full):
            cut = SAFE.search(full, at + CUT)
            end = cut.start() if cut else len(full)
            yield full[at:end]
            at = end

    def ids(self, part: str) -> tuple[list[int], list[int]]:
        a = self.a.encode(part, add_special_tokens=False).ids if self.quick is None or RUN.search(part) else self.quick.encode_ordinary(part)
        return a, self.b.encode(part[1:])

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, digest of the groups, distinct id pairs that are linked, and how many links each has."""
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return none
        digest, n_a, n_b, n_groups, found = hashlib.sha256(), 0, 0, 0, []
        for part in self.stretches(text):
            a, b = self.ids(part)
            ends = self.transducer.groups(a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == part.encode() else None
            if ends is None:
                return none
            a, b, a_ends, b_ends = (np.array(x, np.int64) for x in (a, b, *ends))
            said = self._said(a, b, a_ends, b_ends)
            digest.update(b";" + said if n_groups else said)
            n_a, n_b, n_groups = n_a + len(a), n_b + len(b), n_groups + len(a_ends)
            found.append(self._links(a, b, a_ends, b_ends))
        keys, times = _summed(*map(np.concatenate, zip(*found))) if len(found) > 1 else found[0]
        return n_a, n_b, n_groups, int(times.sum()), digest.hexdigest(), keys, times

    def _said(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
        """Groups as `a1,a2|b1;...`: every id's text is put at its place in one array, and what pads them is taken out."""
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_ends - 1] = b_last[b_ends - 1] = True
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(a) + len(b), f"S{max(self.a_text[0].itemsize, self.b_text[0].itemsize)}")
        out[np.arange(len(a)) + np.r_[0, b_ends][group_a]] = np.where(a_last, self.a_text[1][a], self.a_text[0][a])
        out[np.arange(len(b)) + a_ends[group_b]] = np.where(b_last, self.b_text[1][b], self.b_text[0][b])
        return out.tobytes().translate(None, b"\0")[:-1]

    def _links(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a * width + b, times) of all pairs within groups. Small groups are laid out pair by pair, at once; in a large one the ids are
        counted first, so it costs its distinct pairs and not its length squared."""
        size_a, size_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        large = size_a * size_b > LARGE
        out = []
        for g in np.flatnonzero(large).tolist():
            ua, ca = np.unique(a[a_ends[g] - size_a[g] : a_ends[g]], return_counts=True)
            ub, cb = np.unique(b[b_ends[g] - size_b[g] : b_ends[g]], return_counts=True)
            out.append(((ua[:, None] * self.width + ub).ravel(), (ca[:, None] * cb).ravel()))
        # Each A token of a small group meets the group's B tokens, which stand together.
        each = np.repeat(np.where(large, 0, size_b), size_a)
        first = np.repeat(b_ends - size_b, size_a)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        keys, times = np.unique(np.repeat(a * self.width, each) + b[np.repeat(first, each) + place], return_counts=True)
        return _summed(*map(np.concatenate, zip(*out, (keys, times)))) if out else (keys, times)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(keys) else times


def _aligner(a_file: str, b_file: str) -> Aligner:
    """One aligner a worker process (see pieces._codec)."""
    held = sys.modules.setdefault("_quaymark_aligners", ModuleType("_quaymark_aligners")).__dict__
    if (a_file, b_file) not in held:
        held[a_file, b_file] = Aligner(a_file, b_file)
    return held[a_file, b_file]


def aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: counts, the digest of its groups, and its distinct linked pairs (a * width + b) with their links.

    Pairs are 32-bit where both vocabularies' product is (as the driver sees in their files). `row` is a number of the row, for
    joins; it holds once this frame is written.
    """
    tables = _aligner(a_file, b_file)
    narrow = tables.top < 1 << 31
    kind, dtype = ("int", pa.int32()) if narrow else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = _aligner(a_file, b_file), TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                cols = list(zip(*(aligner.align(t) for t in batch.column(1).to_pylist())))
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in c])], pa.int32()), pa.array(np.concatenate(c), k)) for c, k in ((cols[5], dtype), (cols[6], pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                row += batch.num_rows

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PAIRS.format(kind=kind))


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of links(row, pair, times): how many documents have it, and whether no pair of its A id is in more."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(W.partitionBy("a"))).alias("best"))


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Texts are encoded and aligned once, and what is linked is written: distinct pairs and their links, by document. Pairs are
    counted over all documents; the counts, whose number the vocabularies bound, are sent whole if their file is small and else
    joined by a shuffle, and summed by document.
    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have zeros and an empty digest. Null ids and
    repeated rows are rows like others and count as documents; an empty table gives no rows; further columns are unread.
    """
    width = _aligner(a_file, b_file).width
    found = written(aligned(docs, a_file, b_file, id_col, text_col))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = whole_if_small(written(pair_counts(links, width)))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).cast("long").alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
