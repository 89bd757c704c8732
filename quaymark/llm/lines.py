"""Fuzzy line dedup by MinHash, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .components import bucket_links
from .storage import whole_if_small, written

#: Characters of a shingle; a shorter line is its own only one.
WIDTH = 12
#: Minima of a signature, and shingles whose hashes are made in one row.
MINIMA, BLOCK = 8, 16
#: Words of 64 bits in a line's map of shingles; a line of 500 shingles fills a quarter of it.
WORDS = 32
#: The permutations of a 32-bit hash are its exclusive ors with multiples of this mixing constant.
MIX = 0x9E3779B97F4A7C15
BLANK = " \t\x0b\x0c\r"


def _int(x: int) -> Column:
    x = (x >> 24) & 0xFFFFFFFF
    return F.lit(x - (1 << 32) if x >> 31 else x).cast("int")


def trimmed(line: Column) -> Column:
    """A line without white space around it; only lines that have some are searched for its end."""
    return F.when(reduce(Column.__or__, [f(line, F.lit(c)) for c in BLANK for f in (F.startswith, F.endswith)]), F.btrim(line, F.lit(BLANK))).otherwise(line)


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line, h1, h2) of the lines of docs(doc, text) with more than white space, trimmed; h1 and h2 are hashes."""
    return (
        docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select("doc", "pos", trimmed(F.col("raw")).alias("line")).where("line <> ''")
        .select("doc", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(MINIMA), "line").alias("h2"))
    )


def signatures(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, m0...): for each distinct line how often it stands, and the minima of its shingles' permuted hashes.

    A line is spread over rows of BLOCK places each; the hashes of the shingles at these places (characters as 16-bit units, so
    that a place is found without counting) and their minima are made in that row. Minima are then combined in the
    map task, so neither texts nor shingles are shuffled: of a line held by a third of all rows each task sends one row.
    """
    points = lines.select("h1", "h2", F.encode("line", "UTF-16BE").alias("u"))
    placed = points.select("h1", "h2", "u", F.greatest(F.expr(f"length(u) div 2 - {WIDTH}"), F.lit(0)).cast("int").alias("last"))
    blocks = placed.select("h1", "h2", "u", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(BLOCK))).alias("i"))
    at = lambda j: F.substring("u", F.least(F.col("i") + j, F.col("last")) * 2 + 1, F.lit(2 * WIDTH))
    hashed = blocks.select("h1", "h2", (F.col("i") == 0).cast("int").alias("one"), *[F.hash(at(j)).alias(f"s{j}") for j in range(BLOCK)])
    low = lambda k: F.min(F.least(*[F.col(f"s{j}").bitwiseXOR(_int(MIX * (2 * k + 1))) for j in range(BLOCK)]))
    return hashed.groupBy("h1", "h2").agg(F.sum("one").alias("n"), *[low(k).alias(f"m{k}") for k in range(MINIMA)])


def band_keys(rows: int, bands: int) -> Column:
    """Keys of the bands: band b takes the minima b, b + 1, b + 3, b + 6 ... (cyclic), so that two bands share few."""
    steps = [k * (k + 1) // 2 for k in range(rows)]
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{(b + s) % MINIMA}" for s in steps]) for b in range(bands)])


def windows(line: Column) -> Column:
    """A 64-bit hash of every shingle of a line, by code points."""
    size = 4 * WIDTH
    cut = lambda u: F.transform(F.sequence(F.lit(1), F.greatest(F.length(u) - size, F.lit(0)) + 1, F.lit(4)), lambda i: F.xxhash64(F.substring(u, i, F.lit(size))))
    return F.transform(F.array(F.encode(line, "UTF-32")), cut)[0]  # as an array of one, so that the line is encoded once


def alike(threshold: float, a: str, b: str) -> Column:
    """Whether two lines, line_<a> and line_<b>, with n_<a> and n_<b> different shingles, have the exact Jaccard similarity."""
    both = F.size(F.array_intersect(windows(F.col(f"line_{a}")), windows(F.col(f"line_{b}"))))
    exact = F.exists(F.array(both), lambda x: x >= threshold * (F.col(f"n_{a}") + F.col(f"n_{b}") - x))
    return F.when(F.least(f"n_{a}", f"n_{b}") >= threshold * F.greatest(f"n_{a}", f"n_{b}"), exact).otherwise(False)


def bitmap(texts: DataFrame) -> DataFrame:
    """(id, n, w0...): for each line a map of its shingle set, one bit a shingle; words of the map are made first, then put side by side."""
    bit = texts.select("id", "n", F.explode(windows(F.col("line"))).alias("h"))
    words = bit.groupBy("id", "n", F.expr(f"cast(shiftrightunsigned(h, 6) & {WORDS - 1} as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    return words.groupBy("id", "n").agg(*[F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(WORDS)])


def line_groups(docs: DataFrame, threshold: float, bands: int, rows: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(places: id, doc, pos, h1 of the lines that may be dropped or make others drop; groups: id, component) of docs(doc, text).

    Lines that share a band key are candidates. Bands share minima: 8 bands of 3 out of 8 minima find a pair of similarity 0.8 with
    probability 0.97, one of 0.85 with 0.99, one of 0.9 with 0.998, and one of 0.36 with less than 0.3. A key of two lines is one pair; keys of more go
    through stars. Only lines that stand more than once or are candidates are read again, with their texts where needed.
    """
    lines = written(signatures(split_lines(docs)).select(F.monotonically_increasing_id().alias("id"), "*"))
    keyed = lines.select("id", F.posexplode(band_keys(rows, bands)).alias("band", "key"))
    meets = written(keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("a"), F.max("id").alias("b")).where("c > 1"))
    # Most keys are of one line: where the crowded ones are few, the others are dropped where they are made, not shuffled again.
    two, crowds = meets.where("c = 2").select("a", "b"), written(meets.where("c > 2").select("key"))
    members = written(keyed.join(whole_if_small(crowds), "key"))
    near = two.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct().withColumn("near", F.lit(True))
    wanted = written(lines.select("id", "h1", "h2", "n").join(near, "id", "left").where("n > 1 or near").select("id", "h1", "h2", F.coalesce("near", F.lit(False)).alias("near")))
    places = written(split_lines(docs).join(whole_if_small(wanted), ["h1", "h2"]).select("id", "doc", "pos", "h1", F.when(F.col("near"), F.col("line")).alias("line")))
    texts = places.where("line is not null").groupBy("id").agg(F.first("line").alias("line"))
    texts = written(texts.select("id", "line", F.size(F.array_distinct(windows(F.col("line")))).alias("n")))

    def similar(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(alike(threshold, "a", "b")).select("a", "b")

    # Bits of the map that only one line has are shingles that only it has, so they bound what two lines can have in common.
    alone = lambda x, y: sum((F.bit_count(F.expr(f"w{k}_{x} & ~w{k}_{y}")) for k in range(1, WORDS)), F.bit_count(F.expr(f"w0_{x} & ~w0_{y}")))
    # As the element of an array each bound is made once, and Spark cuts the long sum into methods that are compiled.
    enough = lambda x, y: F.exists(F.array(F.col(f"n_{x}") - alone(x, y)), lambda most: most >= threshold * (F.col("n_a") + F.col("n_b") - most))
    even = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    within = F.when(even, F.when(enough("a", "b"), F.when(enough("b", "a"), alike(threshold, "a", "b")).otherwise(False)).otherwise(False)).otherwise(False)
    # Of the crowded keys that two lines share only the first tells whether they are alike: where its bucket is done, they have met or are of one component.
    first = F.coalesce(*[F.when(F.col(f"k{b}_a") == F.col(f"k{b}_b"), F.col(f"k{b}_a")) for b in range(bands)])
    own = lambda ids: members.join(ids, "id").groupBy("id").agg(*[F.max(F.when(F.col("band") == b, F.col("key"))).alias(f"k{b}") for b in range(bands)])
    sketch = lambda ids: bitmap(texts.join(ids, "id")).join(own(ids), "id").join(texts.select("id", "line"), "id")
    carry = ("n", "line", *[f"w{k}" for k in range(WORDS)], *[f"k{b}" for b in range(bands)])
    return places, bucket_links(members.select("key", "id"), ["key"], similar, rounds, 2, two.distinct(), sketch, carry, F.when(first == F.col("key_a"), within).otherwise(False), exact=True)


def dedup_lines(docs: DataFrame, threshold: float = 0.8, bands: int = 8, rows: int = 3, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with text_col reduced to the lines that stay, and n_lines and n_kept beside the other columns.

    Lines of similarity `threshold` or more (exact Jaccard of their shingle sets) are linked; of every connected group of
    equal or linked lines, over the whole corpus, only the first stays: smallest document id, then smallest line
    number. Equal lines are told by 128 bits of hashes. Lines of white space separate others and stay. Shingles of 12
    characters start at every character, so that each character of a line counts, in URLs, paths and texts without spaces too.

    A null text stays null and has no lines. Documents with a null id pass through untouched and take no part. Rows that
    repeat an id and text both keep what the first may keep; with other texts they are told apart by the lines' hashes.
    A document whose lines are all dropped stays, with an empty text (or its blank lines). An empty table gives an empty table.
    Columns named n_lines and n_kept are replaced; names that begin with two underscores are the operator's own.
    """
    text = F.col(text_col)
    own = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text.cast("string").alias("text"))
    places, groups = line_groups(own, threshold, bands, rows, rounds)
    at = F.struct("doc", "pos")
    first = places.groupBy("id").agg(F.min(at).alias("at")).join(groups, "id", "left")
    first = written(first)
    best = written(first.where("component is not null").groupBy("component").agg(F.min("at").alias("best")))
    rules = first.join(best, "component", "left").select("id", F.coalesce("best", "at").alias("stays"))
    gone = places.join(rules, "id").where(at != F.col("stays"))
    gone = written(gone.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("pos", "h1"))).alias("__gone")))
    marked = docs.withColumn("__doc", F.col(id_col).cast("long")).join(whole_if_small(gone.withColumnRenamed("doc", "__doc")), "__doc", "left").drop("__doc")
    all_lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # Places whose line is the dropped one, taken from all places as a set: in proportion to the lines, however many go.
    gone_of = lambda lines: F.transform(F.filter("__gone", lambda g: F.xxhash64(trimmed(F.get(lines, g["pos"]))) == g["h1"]), lambda g: g["pos"])
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_of(lines))
    joined = F.transform(F.array(all_lines), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))[0]  # as an array of one, so that the text is split once
    kept = F.when(F.col("__gone").isNull(), text).otherwise(joined)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(all_lines, lambda x: trimmed(x) != "")))
    out = marked.withColumn("n_lines", n_lines.cast("long")).withColumn("n_kept", (F.col("n_lines") - F.coalesce(F.size("__gone"), F.lit(0))).cast("long"))
    return out.withColumn(text_col, kept).drop("__gone")
