"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import written

#: Fractional part of the golden ratio in units of 1 / UNIT: points are whole numbers, so that they are exact everywhere.
GOLDEN, UNIT = 618033988749894848, 10**18
#: Neighbouring places of a running sum that one task adds up, and cells that sources' stretches are looked up by.
SPAN, CELLS = 4096, 4096


def plan_targets(totals: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(k, source, source_size, target) of totals(source, source_size): water filling in one ordered pass over the sources.

    Sources by code point, null last, get the weights in turn. All share `share` of all sizes by weight, none above cap times
    its size; what a full source can't take is shared anew. Ordered by the level at which they are full, sources fill one
    after the other, so the level of the first that stays below its cap is that of all after it.
    The pass reads one row a source, whatever the number of documents.
    """
    named = totals.withColumn("k", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") % len(weights) + 1)
    full = named.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("w"))
    everything, before = W.partitionBy(), W.orderBy("full_at", "k").rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = full.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "k", "level"))).over(everything)["level"])
    return levels.select("k", "source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), "most")).alias("target"))


def running(counts: DataFrame, by: list[str], place: str, n: str) -> DataFrame:
    """counts with `base`, the sum of n over smaller places alike in `by`, in two levels: spans of places, then places within one."""
    spanned = counts.withColumn("__span", F.floor(F.col(place) / SPAN))
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    spans = spanned.groupBy(*by, "__span").agg(F.sum(n).alias("__n")).select(*by, "__span", F.coalesce(F.sum("__n").over(before(by, "__span")), F.lit(0)).alias("__base"))
    within = spanned.withColumn("__in", F.coalesce(F.sum(n).over(before([*by, "__span"], place)), F.lit(0)))
    return within.join(spans, [*by, "__span"]).select(*counts.columns, (F.col("__base") + F.col("__in")).alias("base"))


def schedule(sources: DataFrame, block: int, step: int = GOLDEN) -> DataFrame:
    """(slot, k, rank): slot j belongs to the source whose stretch of cumulative target weights holds frac(j * golden ratio).

    There are as many slots as blocks in the targets. Owners are looked up by the cell of [0, 1) that a point lies in; ranks within
    a source come from counts of chunks of slots, so no source's slots are gathered in one task.
    """
    spark = sources.sparkSession
    words = F.floor("target").cast("decimal(38,0)")
    total, n = sources.agg(F.sum(words), F.floor((F.coalesce(F.sum(words), F.lit(0)) + block - 1) / block).cast("long")).first()
    if not total:
        return spark.createDataFrame([], "slot long, k int, rank long")
    bound = lambda x: F.floor(x * F.lit(UNIT).cast("decimal(19,0)") / F.lit(int(total)).cast("decimal(20,0)")).cast("long")
    ends = sources.withColumn("end", F.sum(words).over(W.orderBy("k"))).select("k", bound(F.col("end") - words).alias("lo"), bound(F.col("end")).alias("hi")).where("lo < hi")
    width = UNIT // CELLS + 1
    cells = written(ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))))
    point = F.expr(f"cast((cast(id as decimal(19,0)) * {step}BD) % {UNIT}BD as bigint)")
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("p")).withColumn("cell", F.floor(F.col("p") / width))
    owned = points.join(cells, "cell").where("p >= lo and p < hi").select("slot", "k", F.floor(F.col("slot") / SPAN).alias("chunk"))
    base = running(owned.groupBy("k", "chunk").agg(F.count("*").alias("n")), ["k"], "chunk", "n").select("k", "chunk", "base")
    place = F.row_number().over(W.partitionBy("k", "chunk").orderBy("slot")) - 1
    return owned.withColumn("i", place).join(base, ["k", "chunk"]).select("slot", "k", (F.col("base") + F.col("i")).alias("rank"))


def mix(
    docs: DataFrame, size_col: str = "size", id_col: str = "doc_id", source_col: str = "source",
    weights: list[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 32, seed: int = 20, step: int = GOLDEN,
) -> tuple[DataFrame, DataFrame]:
    """(documents with what the mix takes of them, the mix: slot, source, doc_id, size, round, words).

    1. Targets by water filling over source totals.
    2. A schedule of slots, dealt to the sources by low-discrepancy points and ranked within each.
    3. Each source's documents, shuffled by a seeded hash, form a stream read round and round up to `cap` times the source, cut
       into blocks of `block` words; block r of a source is joined to its slot of rank r, and the mix is the blocks that
       have one. Places in the stream come from bucket totals and running sums within small hash buckets.
    A document's `taken` sums its parts of those blocks, and never exceeds `cap` times its size; first_slot and n_slots say where in
    the mix it begins and how many slots it has part in. A source gets as many blocks as points fall to it, which differs from
    its share by a few: its taken words are within about ten blocks of its target.

    Null text or size counts 0 and takes 0, with null first_slot; the null source comes last; sources without words get target 0.
    Rows alike in id, source and size (repeated rows, null ids) stand together in the stream, and what the mix takes of them is shared
    out evenly. An empty table gives no rows. Reruns give the same rows: nothing depends on partitions or on the number of rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
    )
    alike = written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    totals = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    sizes = written(totals)
    sources = written(plan_targets(sizes.drop("n"), list(weights), share, cap))
    slots = written(schedule(sources, block, step))
    got = slots.groupBy("k").agg(F.count("*").alias("blocks"))
    # The mix ends where the blocks do, or where the cap does.
    limit = F.least(F.coalesce("blocks", F.lit(0)) * block, F.floor(F.lit(float(cap)) * F.col("source_size")))
    sources = written(sources.join(got, "k", "left").withColumn("limit", limit).drop("blocks"))
    # As many small hash buckets as the rows of the largest source ask for: each holds a few thousand rows of one source.
    bits = max(0, ((sizes.agg(F.max("n")).first()[0] or 0) // SPAN).bit_length())
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    place = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    placed = alike.where("size > 0").join(sources.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    placed = placed.withColumn("place", place).withColumn("bucket", F.shiftright("place", 60 - bits)).withColumn("words", F.col("size") * F.col("copies"))
    buckets = running(placed.groupBy("k", "bucket").agg(F.sum("words").alias("n")), ["k"], "bucket", "n").select("k", "bucket", "base")
    within = W.partitionBy("k", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    streams = placed.withColumn("in", F.coalesce(F.sum("words").over(within), F.lit(0))).join(buckets, ["k", "bucket"]).withColumn("at", F.col("base") + F.col("in"))
    # Round r holds the document at r * source_size + at.
    parts = (
        streams.where("limit > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(limit - 1) div source_size"))))
        .withColumn("from", F.col("round") * F.col("source_size") + F.col("at")).withColumn("to", F.least(F.col("from") + F.col("words"), F.col("limit"))).where("`from` < `to`")
        .withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
        .select("k", "rank", "source", "doc_id", "size", "round", (F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)).alias("words"))
    )
    mixed = written(parts.join(slots, ["k", "rank"]).select("slot", "k", "source", "doc_id", "size", "round", "words"))
    taken = mixed.groupBy("k", "doc_id", "size").agg(F.sum("words").alias("all"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    a, t, s = alike.alias("a"), taken.alias("t"), sources.alias("s")
    out = (
        a.join(s, F.col("a.source").eqNullSafe(F.col("s.source")))
        .join(t, (F.col("s.k") == F.col("t.k")) & F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.size") == F.col("t.size")), "left")
        .select("a.doc_id", "a.source", "a.size", "a.copies", "s.source_size", "s.target", F.coalesce("t.all", F.lit(0)).alias("all"), "t.first_slot", F.coalesce("t.n_slots", F.lit(0)).alias("n_slots"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("taken", (F.floor(F.col("all") / F.col("copies")) + F.when(F.col("copy") < F.col("all") % F.col("copies"), 1).otherwise(0)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")
    )
    return out, mixed.drop("k")


def words_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    return mix(docs.select("doc_id", "source", words_of(F.col("text")).alias("size")), **params)[0]


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
alike as (select doc_id, source, size, count(*) as copies from d group by all),
t as (
  select *, row_number() over (order by source is null, encode(source)) - 1 as k from (select source, sum(size * copies)::bigint as source_size from alike group by source)
),
f as (select *, 2.0::double * source_size as most, case k % 3 when 0 then 3.0::double when 1 then 1 else 2 end as w from t),
l as (
  select *, most / w as full_at,
    (1.5::double * sum(source_size) over () - coalesce(sum(most) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from f window b as (order by most / w, k rows between unbounded preceding and 1 preceding)
),
g as (select k, source, source_size, least(most, coalesce((select level from l where level < full_at order by full_at, k limit 1) * w, most)) as target from l),
total as (select sum(floor(target)::hugeint) as words from g),
e as (select k, sum(floor(target)::hugeint) over (order by k) as hi, floor(target)::hugeint as own from g),
slots as (
  select slot, k, row_number() over (partition by k order by slot) - 1 as rank
  from (select range as slot, (range::hugeint * 618033988749894848) % 1000000000000000000 as p from range(0, (select ((words + 31) // 32)::bigint from total)))
  join e on p >= (hi - own) * 1000000000000000000 // (select words from total) and p < hi * 1000000000000000000 // (select words from total)
),
s as (select g.*, least(32 * coalesce(n, 0), floor(2.0::double * source_size))::bigint as lim from g left join (select k, count(*) as n from slots group by k) using (k)),
p as (
  select s.k, s.source, s.source_size, lim, doc_id, size, size * copies as words,
    coalesce(sum(size * copies) over (
      partition by s.k order by ('0x' || substr(md5('20:' || coalesce(doc_id::varchar, '') || ':' || size::varchar), 1, 15))::bigint, doc_id nulls first, size
      rows between unbounded preceding and 1 preceding
    ), 0) as begins
  from alike join s on alike.source is not distinct from s.source where size > 0
),
r as (select *, r * source_size + begins as lo, least(r * source_size + begins + words, lim) as hi from p, range(0, 2) x(r)),
b as (select k, doc_id, size, lo, hi, unnest(range((lo // 32)::bigint, ((hi - 1) // 32 + 1)::bigint)) as rank from r where lo < hi),
m as (select b.*, slot, least(hi, (b.rank + 1) * 32) - greatest(lo, b.rank * 32) as words from b join slots using (k, rank)),
took as (select k, doc_id, size, sum(words) as words, min(slot) as first_slot, count(distinct slot) as n_slots from m group by all)
select a.doc_id, a.source, a.size, s.source_size, s.target,
  (coalesce(words, 0) // copies + case when copy < coalesce(words, 0) % copies then 1 else 0 end)::bigint as taken, first_slot, coalesce(n_slots, 0) as n_slots
from (select *, unnest(range(copies)) as copy from alike) a join s on a.source is not distinct from s.source
left join took on took.k = s.k and took.doc_id is not distinct from a.doc_id and took.size = a.size
"""
