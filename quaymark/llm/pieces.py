"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The model's sign for a space.
SPACE = "▁"
NONE = 32767  # a symbol that is no piece
NEVER = np.int32(1 << 30)
FEW = SPACE * 33
#: A word begins at a space that follows something else; no piece holds a space behind another character.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters of text whose words are merged together, and bytes of words remembered, by a worker.
GATHER, REMEMBER = 1 << 18, 24 << 20
#: Bytes that a remembered word takes besides its characters and ids.
ENTRY = 220


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


class Codec:
    """Tables of a BPE model with byte fallback, identity normalisation and a dummy prefix, for numpy."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        assert n < NONE, "symbols are packed two in an integer"
        self.bos, self.eos = model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        plain = {names[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte_id = np.array(byte, np.int32)  # in the order of the bytes
        self.char_id = np.full(0x110000, NONE, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.rank = np.full(NONE + 1, NEVER)
        self.rank[list(plain.values())] = [-int(model.get_score(i)) for i in plain.values()]
        pairs = {(plain[p[:k]] << 15) | plain[p[k:]]: i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.keys = np.array(sorted(pairs), np.int32)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.bytes_of = [p.encode() for p in names]
        for i in range(n):
            if model.is_control(i):
                self.bytes_of[i] = b""
            elif model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        for b, i in enumerate(byte):
            self.bytes_of[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.room = REMEMBER
        # Words are cut and runs of spaces merged apart on the strength of these two properties.
        runs = {len(p): i for p, i in plain.items() if len(p) > 1 and not p.strip(SPACE)}
        assert all(SPACE not in p[1:] or len(p) in runs for p in plain)
        assert len({int(self.rank[i]) for i in runs.values()}) < 2 and all(self.rank[i] >= self.rank[list(plain.values())].max() for i in runs.values())
        self.runs = runs | ({1: plain[SPACE]} if SPACE in plain else {})
        codecs.register_error("each-byte", _each_byte)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or NONE."""
        key = (left << 15) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers.

        All words' symbols lie in one flat array. In each round every word finds the smallest rank among its pairs and
        merges all pairs of that rank, from the left and without overlap; symbols close up; words without a pair leave.
        Where merging several at once would make a pair of no greater rank, which must come before the rest, that word
        merges only its leftmost pair in this round: the order of merges is that of the one-at-a-time algorithm.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        sym, word, origin = self.char_id[points], np.repeat(np.arange(len(words), dtype=np.int32), lengths), np.arange(len(points), dtype=np.int32)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def paired(sym, word):
            made = np.full(len(sym), NONE, np.int32)
            if len(sym) > 1:
                same = np.flatnonzero(word[:-1] == word[1:])
                made[same] = self._join(sym[same], sym[same + 1])
            return made

        made = paired(sym, word)
        while len(sym):
            rank = self.rank[made]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low < NEVER, size)
            if not live.all():
                done.append((word[~live], sym[~live], origin[~live]))
                sym, word, origin, made, rank = sym[live], word[live], origin[live], made[live], rank[live]
                size, low = size[low < NEVER], low[low < NEVER]
                if not len(sym):
                    break
            low = np.repeat(low, size)
            pick = rank == low
            # In a run of overlapping pairs of that rank every other one is taken, from the left.
            where = np.flatnonzero(pick)
            run = np.r_[True, np.diff(where) > 1] if len(where) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            take = where[(np.arange(len(where)) - first) % 2 == 0]
            while True:
                keep = np.ones(len(sym), bool)
                keep[take + 1] = False
                new = sym.copy()
                new[take] = made[take]
                s, w = new[keep], word[keep]
                at = (np.cumsum(keep) - 1)[take]
                m = made[keep]
                touch = np.zeros(len(s) + 1, bool)
                touch[at] = touch[at - 1] = True  # the place before the first is the spare one at the end
                touched = np.flatnonzero(touch[:-1])
                last = np.r_[w[1:] != w[:-1], True][touched]
                nxt = np.minimum(touched + 1, len(s) - 1)
                m[touched] = np.where(last, NONE, self._join(s[touched], s[nxt]))
                many = np.r_[False, word[take][1:] == word[take][:-1]]
                if not many.any():
                    break
                early = w[touched][self.rank[m[touched]] <= low[keep][touched]]
                side = take[:-1][(np.diff(take) == 2) & many[1:]]  # the right neighbour is itself about to be merged
                early = np.r_[early, word[side][self.rank[self._join(made[side], sym[side + 2])] <= low[side]]]
                back = many & np.isin(word[take], early)
                if not back.any():
                    break
                take = take[~back]
            sym, word, origin, made = s, w, origin[keep], m
        word, sym, origin = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(word, kind="stable")
        word, sym, origin = word[order], sym[order], origin[order]
        lost = np.flatnonzero(sym == NONE)
        if len(lost):  # characters that are no piece become the pieces of their bytes
            chars = points[origin[lost]]
            width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            raw = np.frombuffer(chars.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            times = np.ones(len(sym), np.int64)
            times[lost] = width
            bare = np.repeat(sym == NONE, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[bare] = self.byte_id[raw]
        blob = sym.astype("<u4").tobytes()
        ends = np.searchsorted(word, np.arange(len(words)), side="right") * 4
        return [blob[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def _after_run(self, word: str) -> bytes:
        """Ids of a word with many spaces before it: pieces of spaces tie in rank, behind all others, so once the last
        space has met the word the leftmost pair goes first, which is a walk with a stack."""
        n = len(word) - len(word.lstrip(SPACE))
        rest = self.merge([SPACE + word[n:]])[0] if n < len(word) else b""
        if n < len(word):
            alone = np.frombuffer(rest[:4], "<u4")[0] == self.runs[1]
            n, rest = (n, rest[4:]) if alone else (n - 1, rest)
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return np.array([self.runs[k] for k in stack], "<u4").tobytes() + rest

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text with begin and end ids, in order; words are merged once for a group of texts."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars < GATHER):
                text = (texts[at] or "").replace(" ", SPACE)
                group.append(WORD.findall(SPACE + text) if text else [])
                chars += len(text)
                at += 1
            if self.room < 0:
                self.known.clear()
                self.room = REMEMBER
            fresh = list({w for words in group for w in words if w not in self.known})
            spaced = [w for w in fresh if w.startswith(FEW) and 1 in self.runs]
            fresh = [w for w in fresh if not (w.startswith(FEW) and 1 in self.runs)]
            new = dict(zip(fresh, self.merge(fresh)))
            new.update((w, self._after_run(w)) for w in spaced)
            self.room -= sum(ENTRY + 4 * len(w) + len(ids) for w, ids in new.items())
            self.known.update(new)
            for words in group:
                ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
                yield np.r_[np.uint32(self.bos), ids, np.uint32(self.eos)].astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes of pieces joined, each stray byte a replacement sign, spaces back, the prefix gone."""
        parts = [b for b in map(self.bytes_of.__getitem__, ids.tolist()) if b]
        text = b"".join(parts).decode("utf-8", "each-byte").replace(SPACE, " ")
        return text[1:] if parts and parts[0].startswith(SPACE.encode()) else text


def _codec(model_file: str) -> Codec:
    """One codec a worker process. Functions travel by value, so the globals of this module are new in each task: what is to
    outlive a task hangs on a module of the process itself."""
    held = sys.modules.setdefault("_quaymark_codecs", ModuleType("_quaymark_codecs")).__dict__
    if model_file not in held:
        held[model_file] = Codec(model_file)
    return held[model_file]


def encode_table(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each text, begin and end included. A null text is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file)
        for batch in batches:
            ids = [x.astype(np.int32) for x in codec.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file)
        for batch in batches:
            texts = [codec.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", part: int = 64) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded from the ids.

    A null text is the empty one and has the begin and end ids only. Null ids and repeated rows are rows like others; an
    empty table gives no rows; further columns are unread. A text is held whole, with its ids, by the worker that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file)
        for whole in batches:
            for start in range(0, whole.num_rows, part):
                batch = whole.slice(start, part)
                n, a, b = [], [], []
                for ids in codec.encode_all(batch.column(1).to_pylist()):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    b.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
