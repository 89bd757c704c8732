"""Quality rules under weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .storage import written

#: White space that separates words.
SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Rule:
    """Votes keep (1) at or inside `good`, drop (-1) at or beyond `bad`, and abstains between them.

    `low` rules read a value that should be large, the others one that should be small.
    """

    name: str
    value: str
    good: float
    bad: float
    low: bool = False

    def vote(self) -> Column:
        v = F.expr(self.value)
        keep, drop = (v >= self.good, v <= self.bad) if self.low else (v <= self.good, v >= self.bad)
        return F.when(drop, -1).when(keep, 1).otherwise(0)


RULES = (
    Rule("length", "n_words", 30, 9, low=True),
    Rule("word_length_short", "word_chars / n_words", 3.0, 2.5, low=True),
    Rule("word_length_long", "word_chars / n_words", 9.0, 12.0),
    Rule("symbols", "n_symbols / n_words", 0.05, 0.3),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.1, 0.5),
    Rule("repeats", "n_repeat_words / n_words", 0.2, 0.3),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", 0.15, 0.5),
    Rule("marks", "n_marks / n_words", 0.4, 0.8),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules read, over whole texts; a null text has no words.

    Repeats: five-word windows are hashed (64 bits, compared within one text only) with their places and sorted; places
    of windows that have an equal neighbour are the ones found twice, and the words covered are their union. A text whose
    windows are all distinct, the usual case, is told by array_distinct and never sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    words = F.array_remove(F.split("t", f"[{SPACE}]+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    solid = F.col("t")
    for blank in " \t\n\x0b\x0c\r":
        solid = F.replace(solid, F.lit(blank), F.lit(""))
    found = lambda chars: F.regexp_count("t", F.lit(chars))
    one = base.select(
        "doc_id", words.alias("w"), lines.alias("l"), F.length(solid).alias("word_chars"), found("[#*$%&|<>]").alias("n_symbols"),
        found("[A-Z]").alias("n_upper"), found(r"[!?{}\[\]=_~^\\]").alias("n_marks"),
    )
    two = one.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.col("n_upper").cast("long"), F.col("n_marks").cast("long"),
        F.when(F.size("w") >= 5, _windows("w")).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks"]
    # Each step is a column of its own, so that none is evaluated again where the next one names it twice.
    pair, none = "array<struct<h:bigint,i:int>>", F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    order = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.select(*counts, F.when(F.size("g") > F.size(F.array_distinct("g")), order).otherwise(F.array().cast(pair)).alias("k"))
    # Neighbours in the sorted order are compared by zipping the array with itself moved by one either way.
    behind = F.zip_with("k", F.slice(F.concat(none, "k"), 1, F.size("k")), lambda x, p: F.struct(x["h"].alias("h"), x["i"].alias("i"), p["h"].alias("p")))
    marked = F.zip_with(behind, F.slice(F.concat("k", none), 2, F.size("k")), lambda x, q: F.when((x["h"] == x["p"]) | (x["h"] == q["h"]), x["i"]))
    four = three.select(*counts, F.when(F.size("k") > 0, F.array_sort(F.filter(marked, lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>")).alias("places"))
    steps = F.zip_with(F.slice("places", 1, F.size("places") - 1), F.slice("places", 2, F.size("places") - 1), lambda x, y: F.least(y - x, F.lit(5)))
    repeated = F.when(F.size("places") > 0, 5 + F.aggregate(steps, F.lit(0), lambda total, x: total + x)).otherwise(0)
    return four.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "n_lines", "n_upper", "n_marks")


def _windows(w: str) -> Column:
    """Hashes of the five-word windows of an array of words, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(-1, 4)]))


@dataclass(frozen=True)
class LabelModel:
    """Shares of the classes, good texts first, then one way of being bad for each rule; rates[class][rule][vote] among
    the votes that aren't abstentions, which say nothing."""

    shares: list[float]
    rates: list[list[dict[int, float]]]

    def logs(self, votes: tuple[int, ...]) -> list[float]:
        return [math.log(p) + sum(math.log(r[v]) for r, v in zip(rates, votes) if v) for p, rates in zip(self.shares, self.rates)]

    def posterior(self, votes: tuple[int, ...]) -> list[float]:
        logs = self.logs(votes)
        parts = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(parts) for x in parts]


def label_model(patterns: list[tuple[tuple[int, ...], int]], prior: float = 0.9, rounds: int = 500) -> LabelModel:
    """Shares and vote rates by expectation-maximisation over vote patterns: (votes, number of documents).

    Bad texts seldom fail every rule: most are bad in one way. So besides the good ones there is a class for each rule's kind
    of badness, which other rules may notice too; rules vote independently given the class. To begin with, a class's own
    rule votes to drop, and all others vote as on good texts, which get few votes to drop. Counts are smoothed by one
    document shared out like those first rates. What rules say of good and bad texts, and how much of each there is, comes from the data.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    fair, own = {-1: 0.02, 1: 0.98}, {-1: 0.95, 1: 0.05}
    first = [[fair] * n_rules] + [[own if k == c else fair for k in range(n_rules)] for c in range(n_rules)]
    model = LabelModel([prior] + [(1 - prior) / max(n_rules, 1)] * n_rules, first)
    for _ in range(rounds if total else 0):
        sums = [[dict(r) for r in rates] for rates in first]
        mass = [1.0] * (n_rules + 1)
        for votes, n in patterns:
            for c, p in enumerate(model.posterior(votes)):
                mass[c] += n * p
                for k, v in enumerate(votes):
                    if v:
                        sums[c][k][v] += n * p
        new = LabelModel([m / sum(mass) for m in mass], [[{v: x / sum(r.values()) for v, x in r.items()} for r in rates] for rates in sums])
        still = max(abs(x - y) for x, y in zip(new.shares, model.shares)) < 1e-9
        model = new
        if still:
            break
    return model


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its counts, base_failed, kept and the posterior `quality`.

    Rules vote keep, drop or abstain; the table of vote patterns, at most 3^rules rows whatever the corpus, is counted
    over all documents and gives the rules' accuracies and the shares of good and bad texts by expectation-maximisation; the
    posterior probability of a good text decides. base_failed (fewer than 10 words, or over a fifth of the words in repeated windows)
    is final. A text without words has base_failed. Null ids and repeated rows are rows like others; no rows, no result.
    """
    m = written(measures(docs, id_col, text_col))
    votes = [F.when(F.col("n_words") > 0, r.vote()).otherwise(0).cast("int").alias(f"v{k}") for k, r in enumerate(rules)]
    names = [f"v{k}" for k in range(len(rules))]
    m = m.select("*", *votes)
    patterns = [(tuple(r[k] for k in names), r["count"]) for r in m.groupBy(*names).count().collect()]
    model = label_model(sorted(patterns))
    logs = []
    for share, rates in zip(model.shares, model.rates):
        log = F.lit(math.log(share))
        for name, rate in zip(names, rates):
            log = log + F.when(F.col(name) == 1, math.log(rate[1])).when(F.col(name) == -1, math.log(rate[-1])).otherwise(0.0)
        logs.append(log)
    m = m.withColumns({f"log{c}": log for c, log in enumerate(logs)})
    bad = sum((F.exp(F.least(F.col(f"log{c}") - F.col("log0"), F.lit(500.0))) for c in range(1, len(logs))), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    quality = 1 / (1 + bad)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality"),
    )
