"""Personal data: fixed patterns, and a semi-Markov conditional random field (Sarawagi and Cohen 2004) that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import written

# Kinds in their order, and the patterns whose matches always stand. Quantifiers are possessive where what
# follows can't match what they took, so that long runs cost no more than their length.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # within a run of digits no place matches where its first doesn't
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"\S+")
ANCHOR = re.compile(r"[0-9@]")
#: Addresses with their signs written out, in brackets or between spaces.
_AT, _DOT = (rf"(?:\s*[\[({{<]\s*{w}\s*[\])}}>]\s*|\s+{w}\s+)" for w in ("at", "dot"))
_HOST = r"[\w-]++(?:\.[\w-]++)*+"
SPELLED = re.compile(rf"(?i)(?<![\w.+%-])[\w.+%-]++(?:{_DOT}[\w.+%-]++)*{_AT}{_HOST}(?:{_DOT}{_HOST})+")
SIGN = re.compile(r"(?i)(?<=[\s\[({<])(?:at|dot)(?=[\s\])}>])")
HOST = re.compile(_HOST)
BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|dot)\s*[\])}>]")
#: Ends that tell an address from a phrase with the same words.
TOPS = {"com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "dev", "app", "eu", "uk", "de", "fr", "it", "es", "nl", "se", "no", "ch", "at", "be", "pl", "ru", "in", "jp", "cn", "br", "au", "ca", "us", "nz", "ie", "test", "example"}
#: Tokens an entity may have (two names, a host of four parts and five signs; or the groups of a number), and tokens of context on
#: either side of an anchor: a token with a digit or an at sign, or one of a spelled address.
LONGEST, CONTEXT = 11, 2
CUES = {
    "email": {"email", "e-mail", "mail", "contact", "write"}, "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "mastercard", "credit", "account"}, "phone": {"tel", "phone", "call", "mobile", "fax", "cell"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, at sign and dotted domain, looking only around at signs."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not re.search(r"[0-9]", text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


@dataclass
class Window:
    """A stretch of tokens around anchors: (start, end) of each token in the text, and the token before."""

    text: str
    tokens: list[tuple[int, int]]
    before: str


def _sign(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The written sign whose word is text[a:b], with the brackets or spaces that make it one."""
    before, after = a, b
    while before and text[before - 1].isspace():
        before -= 1
    while after < len(text) and text[after].isspace():
        after += 1
    if before and after < len(text) and text[before - 1] in "[({<" and text[after] in "])}>":
        before, after = before - 1, after + 1
        while before and text[before - 1].isspace():
            before -= 1
        while after < len(text) and text[after].isspace():
            after += 1
        return before, after
    return (before, after) if before < a and after > b else None


def spelled_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of SPELLED, found from their at signs: names joined by dots are walked to the left, hosts to the
    right. A walk ends at the next at sign, so all of them together pass a text twice."""
    ats, starts, ends = [], {}, {}
    for m in SIGN.finditer(text):
        if sign := _sign(text, *m.span()):
            if len(m[0]) == 2:
                ats.append(sign)
            else:
                starts[sign[0]], ends[sign[1]] = sign[1], sign[0]

    def word_before(at: int, floor: int) -> int:
        while at > floor and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
            at -= 1
        return at

    floor = 0
    for a, b in ats if starts else ():
        first = word_before(a, floor)
        if first == a:
            continue
        while first in ends and ends[first] > floor and (further := word_before(ends[first], floor)) < ends[first]:
            first = further
        host, parts = HOST.match(text, b), 0
        while host and (dot := starts.get(host.end())) and (part := HOST.match(text, dot)):
            host, parts = part, parts + 1
        if parts:
            yield first, host.end()
            floor = host.end()


def windows(text: str) -> Iterator[Window]:
    """Stretches with every token that has a digit or an at sign or is part of a spelled address, and CONTEXT tokens on either side."""
    spelled = list(spelled_addresses(text)) if "dot" in text.lower() else []
    if not spelled and not ANCHOR.search(text):
        return
    at = 0
    run: list[tuple[int, int]] = []
    recent: list[tuple[int, int]] = []
    since, before = CONTEXT + 1, ""
    for m in TOKEN.finditer(text):
        while at < len(spelled) and spelled[at][1] <= m.start():
            at += 1
        if ANCHOR.search(text, *m.span()) or (at < len(spelled) and spelled[at][0] < m.end()):
            if since > CONTEXT:
                before = text[slice(*recent[0])] if len(recent) > CONTEXT else ""
                run = list(recent[-CONTEXT:])
            run.append(m.span())
            since = 0
        else:
            since += 1
            if since <= CONTEXT:
                run.append(m.span())
            elif run:
                yield Window(text, run, before)
                run = []
        recent = [*recent[-CONTEXT:], m.span()]
        if since > CONTEXT:
            run = []
    if run:
        yield Window(text, run, before)


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A stretch without punctuation around it; brackets stay where their partners are inside."""
    while a < b and (text[a] in "\"'<[{,;:.!?*" or (text[a] == "(" and ")" not in text[a:b])):
        a += 1
    while b > a and (text[b - 1] in "\"'>]},;:.!?*&%$#" or (text[b - 1] == ")" and "(" not in text[a:b])):
        b -= 1
    return a, b


DIGIT_STEPS = (0, 3, 6, 8, 12, 15, 16, 19)
NAMES = (
    "bias", "one", "two", "three", "many", *[f"digits<={n}" for n in DIGIT_STEPS], "digits>", "at", "address", "spelled", "bracketed", "top level", "plus",
    "brackets", "hyphens", "quad", "dotted", "luhn", "no letters", "letters", "phone signs", "card signs", "fours", "first bare",
    "last bare", "inner stop", "grouped", *[f"cue {k}" for k in KINDS],
)


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, before: str) -> list[int]:
    """Features of the whole span of tokens i..j-1, as places in NAMES."""
    a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
    s = text[a:b]
    digits = "".join(re.findall(r"[0-9]", s))
    letters = sum(c.isalpha() for c in s)
    parts = s.split(".")
    on = ["bias", ("one", "two", "three", "many")[min(j - i, 4) - 1]]
    on.append(next((f"digits<={n}" for n in DIGIT_STEPS if len(digits) <= n), "digits>"))
    spelled = "dot" in s.lower() and bool(SPELLED.fullmatch(s))
    bare = [not ANCHOR.search(text, *t) for t in (tokens[i], tokens[j - 1])]
    checks = {
        "at": "@" in s,
        "address": s.count("@") == 1 and bool(re.fullmatch(r"\S+@[\w-]+(\.[\w-]+)+", s)),
        "spelled": spelled, "bracketed": spelled and bool(BRACKETED.search(s)), "top level": spelled and re.split(r"\W+", s)[-1].lower() in TOPS,
        "plus": s.startswith("+"), "brackets": "(" in s and ")" in s, "hyphens": bool(re.search(r"[0-9]-[0-9]", s)),
        "quad": len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts),
        "dotted": 1 < len(parts) != 4 and all(p.isascii() and p.isdigit() for p in parts),
        "luhn": 13 <= len(digits) <= 19 and luhn(digits), "no letters": not letters, "letters": letters > len(s) / 2,
        "phone signs": bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", s)), "card signs": bool(re.fullmatch(r"[0-9](?:[\x20-]?[0-9])*", s)),
        "fours": bool(re.fullmatch(r"[0-9]{4}([\x20-][0-9]{4}){3}", s)), "first bare": bare[0], "last bare": bare[1],
        "inner stop": bool(re.search(r"[,;:!?.]\s", s)), "grouped": bool(re.search(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", s)),
    }
    on += [name for name, holds in checks.items() if holds]
    last = re.sub(r"\W", "", text[slice(*tokens[i - 1])] if i else before).lower()
    on += [f"cue {k}" for k in KINDS if last in CUES[k]]
    return [PLACE[name] for name in on]


PLACE = {name: n for n, name in enumerate(NAMES)}
LABELS = ("other", *KINDS)


def possible(on: list[int]) -> list[bool]:
    """Labels that a span with these features may have: an address needs its sign, the others hold no letters."""
    bare = PLACE["no letters"] in on
    return [True, PLACE["at"] in on or PLACE["spelled"] in on, bare, bare, bare]


@dataclass(frozen=True)
class Field:
    """Weights of span features by label, and of one label after another."""

    weights: np.ndarray  # labels x features
    follow: np.ndarray  # labels x labels

    def scores(self, w: Window) -> np.ndarray:
        """[end, length - 1, label]: score of the span of that length that ends there; other has length one only."""
        n = len(w.tokens)
        out = np.full((n + 1, LONGEST, len(LABELS)), -np.inf)
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                on = features(w.text, w.tokens, i, j, w.before)
                s = np.where(possible(on), self.weights[:, on].sum(axis=1), -np.inf)
                out[j, j - i - 1, 1:] = s[1:]
                if j == i + 1:
                    out[j, 0, 0] = s[0]
        return out

    def spans(self, w: Window, margin: float = 2.0) -> list[tuple[int, int, int]]:
        """Best joint segmentation by dynamic programming; entities that beat the best one without them by `margin`."""
        s = self.scores(w)
        n, k = len(w.tokens), len(LABELS)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0.0
        came: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for size in range(1, min(LONGEST, j) + 1):
                step = best[j - size][:, None] + self.follow  # before x label
                frm = step.argmax(axis=0)
                total = step[frm, range(k)] + s[j, size - 1]
                for y in np.flatnonzero(total > best[j]):
                    best[j, y] = total[y]
                    came[j, y] = (j - size, int(frm[y]))
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i, y0 = came[j, y]
            gain = s[j, j - i - 1, y] - sum(s[t, 0, 0] for t in range(i + 1, j + 1))
            if y and gain >= margin:
                a, b = trimmed(w.text, w.tokens[i][0], w.tokens[j - 1][1])
                out.append((y - 1, a, b))
            j, y = i, y0
        return out[::-1]


def _variants(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A marked text, and others with its entities rewritten as people write them, set side by side, or spoilt."""
    out = [(text, spans)]
    for kind, a, b in spans:
        s = text[a:b]
        digits = re.sub(r"[^0-9]", "", s)
        if kind == 3 and len(digits) >= 10:
            d = digits[-10:]
            forms = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"+{digits[:-10]} {d[:3]} {d[3:6]} {d[6:]}"]
        elif kind == 2 and len(digits) == 16:
            forms = [" ".join(digits[i:i + 4] for i in range(0, 16, 4)), digits]
        elif kind == 0:
            user, _, host = s.partition("@")
            name, _, top = host.rpartition(".")
            plain = re.sub(r"[0-9]+", "", user).strip("._%+-") or "someone"
            apart, far = plain.replace(".", " dot "), name.replace(".", " dot ")
            forms = [f"{user} [at] {name} [dot] {top}", f"{user} at {name} dot {top}"]
            # Every form without digits as well, and phrases with the same words that are none.
            for g in (f"{plain} [at] {name} [dot] {top}", f"{plain}(at){name}(dot){top}", f"{plain} at {name} dot {top}", f"{apart} at {far} dot {top}", f"{apart} at mail dot {far} dot {top}"):
                g = re.sub(r"[0-9]+", "", g)
                out.append((text[:a] + g + text[b:], [(kind, a, a + len(g))]))
            for g in ("looked at the dot on", "right at each dot above", "sits at a dot matrix"):
                out.append((text[:a] + g + text[b:], []))
        else:
            forms = [s]
        f = rng.choice(forms)
        out.append((text[:a] + f + text[b:], [(kind, a, a + len(f))]))
        card = _card(rng)
        both = f"{s} {card}" if rng.random() < 0.5 else f"{card} {s}"
        at = both.find(s)
        out.append((text[:a] + both + text[b:], [(kind, a + at, a + at + len(s)), (2, a + (0 if at else len(s) + 1), a + (0 if at else len(s) + 1) + len(card))]))
        bad = rng.choice([
            str(rng.randrange(10 ** rng.randrange(1, 9))), f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
            f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}", "%032x" % rng.getrandbits(128), f"{rng.randrange(300, 999)}.{rng.randrange(999)}.{rng.randrange(999)}.{rng.randrange(999)}",
            f"{rng.randrange(1, 13)}:{rng.randrange(60):02d}", "".join(rng.choice("0123456789") for _ in range(rng.randrange(20, 40))), f"{rng.randrange(1, 99)},{rng.randrange(1000):03d}.{rng.randrange(100):02d}",
            f"key={rng.getrandbits(60):x}", "AK" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), f"@{'abc'[rng.randrange(3)]}{rng.randrange(99)}",
        ])
        out.append((text[:a] + bad + text[b:], []))
    return out


def _card(rng: random.Random) -> str:
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 150, penalty: float = 0.01, seed: int = 7, longest: int = 20) -> Field:
    """Maximum conditional likelihood over windows of marked texts and their variants, all windows side by side in numpy.

    Spans with the same features share a row of the feature matrix, which is thus as large as there are different ones; windows stand
    from the longest to the shortest, and each place is worked out for those that reach it. Windows of more than `longest` tokens
    are left out of the training, so that the arrays have a bound.
    """
    rng = random.Random(seed)
    cases: list[tuple[Window, list[tuple[int, int, int]]]] = []
    for text, spans in samples:
        for t, marks in _variants(text, spans, rng):
            for w in windows(t):
                if len(w.tokens) > longest:
                    continue
                gold, at = [], 0
                for kind, a, b in sorted(marks, key=lambda m: m[1]):
                    inside = [n for n, (x, y) in enumerate(w.tokens) if x < b and y > a]
                    if inside and inside[0] >= at and len(inside) <= LONGEST and possible(features(t, w.tokens, inside[0], inside[-1] + 1, w.before))[kind + 1]:
                        gold += [(n, n + 1, 0) for n in range(at, inside[0])] + [(inside[0], inside[-1] + 1, kind + 1)]
                        at = inside[-1] + 1
                gold += [(n, n + 1, 0) for n in range(at, len(w.tokens))]
                cases.append((w, gold))
    n, k, f = len(cases), len(LABELS), len(NAMES)
    weights, follow = np.zeros((k, f)), np.zeros((k, k))
    if not n:
        return Field(weights, follow)
    cases.sort(key=lambda c: -len(c[0].tokens))
    t = len(cases[0][0].tokens)
    kinds: dict[tuple[int, ...], int] = {(): 0}
    kind = np.zeros((n, t + 1, LONGEST), np.int32)  # of the span that ends there with that length; 0 where there is none
    may = np.zeros((n, t + 1, LONGEST, k), bool)
    ends = np.array([len(w.tokens) for w, _ in cases], np.int64)
    target, target_follow = np.zeros((k, f)), np.zeros((k, k))
    for c, (w, gold) in enumerate(cases):
        for i in range(len(w.tokens)):
            for j in range(i + 1, min(len(w.tokens), i + LONGEST) + 1):
                on = features(w.text, w.tokens, i, j, w.before)
                kind[c, j, j - i - 1] = kinds.setdefault(tuple(on), len(kinds))
                may[c, j, j - i - 1] = possible(on)
        last = 0
        for i, j, y in gold:
            target[y, features(w.text, w.tokens, i, j, w.before)] += 1
            target_follow[last, y] += 1
            last = y
    may[:, :, 1:, 0] = False  # other is one token long
    x = np.zeros((len(kinds), f))
    for on, row in kinds.items():
        x[row, list(on)] = 1
    reach = [int((ends >= j).sum()) for j in range(t + 2)]  # windows with so many tokens
    m, v = np.zeros(k * (f + k)), np.zeros(k * (f + k))
    low = -1e9
    for step in range(1, rounds + 1):
        s = (x @ weights.T)[kind]
        s[~may] = low
        # fwd and led: all ways up to a place by its label, and by the label after it; bwd and on: from a place by its label, and by the next.
        fwd, led, bwd, on = (np.full((n, t + 1, k), low) for _ in range(4))
        fwd[:, 0, 0] = 0
        led[:, 0] = follow[0]
        for j in range(1, t + 1):
            c, size = reach[j], min(LONGEST, j)
            fwd[:c, j] = _lse(led[:c, j - size : j][:, ::-1] + s[:c, j, :size], 1)
            led[:c, j] = _lse(fwd[:c, j][:, :, None] + follow, 1)
        bwd[np.arange(n), ends] = 0
        for i in range(t - 1, -1, -1):
            c, size = reach[i + 1], min(LONGEST, t - i)
            sizes = np.arange(size)
            on[:c, i] = _lse(s[:c, i + 1 + sizes, sizes] + bwd[:c, i + 1 : i + 1 + size], 1)
            bwd[:c, i] = _lse(follow + on[:c, i][:, None, :], 2)
        total = _lse(fwd[np.arange(n), ends], 1)
        shares = np.zeros((n, t + 1, LONGEST, k))
        grad_follow = -target_follow.copy()
        for j in range(1, t + 1):
            c, size = reach[j], min(LONGEST, j)
            shares[:c, j, :size] = np.exp(np.clip(led[:c, j - size : j][:, ::-1] + s[:c, j, :size] + bwd[:c, j][:, None] - total[:c, None, None], -700, 0)) * may[:c, j, :size]
            grad_follow += np.exp(np.clip(fwd[:c, j - 1][:, :, None] + follow + on[:c, j - 1][:, None, :] - total[:c, None, None], -700, 0)).sum(axis=0)
        held = np.stack([np.bincount(kind.ravel(), shares[..., y].ravel(), len(kinds)) for y in range(k)])
        g = np.r_[((held @ x - target) / n + penalty * weights).ravel(), (grad_follow / n + penalty * follow).ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, follow = weights - d[: k * f].reshape(k, f), follow - d[k * f:].reshape(k, k)
    return Field(weights, follow)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def find_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), by kind and start: the field adds spans that touch none of the base ones."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    more = []
    for w in windows(text):
        for kind, a, b in field.spans(w):
            before = bisect_left(starts, b)  # base spans that begin before this one ends; does any of them end after its start?
            if not before or ends[before - 1] <= a:
                more.append((kind, a, b))
    return base, sorted({*base, *more})


def training_texts(docs: DataFrame, sample: int = 200) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Surroundings of at most `sample` spans of the fixed patterns, those of smallest hashes; each task hands on no more than that."""

    each = sample // len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[list[tuple]] = [[] for _ in KINDS]  # the rows of each kind with the smallest hashes that this task has seen
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                for kind, a, b in base_spans(text) if ANCHOR.search(text) else ():
                    lo, hi = max(0, a - 40), b + 40
                    near = text[lo:hi]
                    near, cut = (near[near.find(" ") + 1:], near.find(" ") + 1) if lo and " " in near[: a - lo] else (near, 0)
                    row = (zlib.crc32(near.encode("utf-8", "surrogatepass")), near, kind, a - lo - cut, b - lo - cut)
                    mine = least[kind]
                    if (len(mine) < each or row < mine[-1]) and base_spans(near) == [row[2:]]:
                        mine.insert(bisect_left(mine, row), row)
                        del mine[each:]
        rows = [row for mine in least for row in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["hash", "text", "kind", "a", "b"])

    found = written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "hash long, text string, kind int, a int, b int"))
    kept = [found.where(F.col("kind") == k).orderBy("hash", "text", "a").limit(each) for k in range(len(KINDS))]
    rows = kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3]).collect()
    return [(r["text"], [(r["kind"], r["a"], r["b"])]) for r in rows]


def pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the fixed patterns, spans (all, as kind:start:end).

    Places are code points, ends exclusive. A null text is the empty one: no spans. Whole texts are read. Null ids and
    repeated rows are rows like others; an empty table gives no rows; only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                base, every = find_spans(text.as_py() or "", field)
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            columns = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def private_data(docs: DataFrame, sample: int = 200) -> DataFrame:
    """Train the field on a bounded sample of pattern matches and their variants, then find spans in all documents."""
    return pii(docs, train(training_texts(docs, sample)))
