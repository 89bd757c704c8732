"""Distributed union-find over an edge list, and links within buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .storage import shared_dir, written


#: Edges a task holds in the iteration: small graphs need few tasks, whatever the session's shuffle partitions.
EDGES_PER_TASK = 100_000
#: Members of a bucket that one task compares with the bucket's other side; larger buckets are dealt over several.
SIDE = 512


def _ends(edges: DataFrame) -> tuple[int, int]:
    """Of distinct edges(a, b), the larger id first: how many they are, and how many nodes keep them from being stars, as
    they hang on several others or on one that hangs itself. A node's edges are counted by partial aggregation."""
    end = lambda c, up: F.struct(F.col(c).alias("id"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).groupBy("e.id").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.col("up") + F.col("down") > 1)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step re-hangs neighbours on the smallest one,
    so a node's label falls to the component's minimum in O(log^2 n) steps and the number of edges never grows.
    Minima are taken by partial aggregation, so a node of huge degree is never gathered in one task. Edges that are stars on their
    smallest ids are done, without a step to see that nothing moves.
    Self loops and null ends are ignored; no edges gives an empty frame.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a <> b and a is not null and b is not null")
        .distinct().checkpoint()
    )
    for step in range(rounds + 1):
        count, open_ = _ends(now)
        if not open_:
            break
        if step == rounds:
            raise RuntimeError("union-find did not settle")
        now = now.coalesce(max(1, count // EDGES_PER_TASK))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct().coalesce(max(1, count // EDGES_PER_TASK)).checkpoint()
        )
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


#: Pairs of two components of which one side, a, is outside the largest; of two outside it each once.
APART = "ca <> cb and (cb = mc or a < b)"


def _finish(live: DataFrame, keys: list[str], labels: DataFrame, meet: Callable[[DataFrame, DataFrame, Column, str], DataFrame]) -> DataFrame:
    """labels(id, component) with the links that `meet` finds among live(keys..., id, c, mc, all), buckets of several components with mc the largest.

    Links are between components, so the union-find works on the components that have one, not on their members.
    """
    out, main = live.where("c <> mc"), live.where("c = mc")
    found = written(meet(out, main, F.lit(True), "left_semi").select(F.col("ca").alias("a"), F.col("ma").alias("b")).distinct())
    moved = components(found)
    to = lambda x: moved.select(F.col("id").alias(x), F.col("component").alias(f"{x}_now"))
    now = out.join(to("c"), "c", "left").join(to("mc"), "mc", "left")
    now = now.select(*keys, "id", F.coalesce("c_now", "c").alias("c"), F.coalesce("mc_now", "mc").alias("mc"), "all")
    # What was in the largest component has met all others, so only those outside it take part, whether they belong to it by now or
    # not, and only where they are of several components.
    several = now.groupBy(*keys).agg((F.min("c") < F.max("c")).alias("several")).where("several").select(*keys)
    out = written(now.join(several, keys))
    if not out.isEmpty():
        more = meet(out.where("c <> mc"), out, F.expr(APART), "inner").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moved = components(moved.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    alone = moved.join(labels.select("id"), "id", "left_anti")
    within = labels.join(moved.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    return within.select("id", F.coalesce("now", "component").alias("component")).unionByName(alone)


def bucket_links(
    members: DataFrame, keys: list[str], verify: Callable[[DataFrame], DataFrame], rounds: int = 1, reps: int = 3, also: DataFrame | None = None,
    sketch: Callable[[DataFrame], DataFrame] | None = None, carry: tuple[str, ...] = (), within: Column | None = None, exact: bool = False,
) -> DataFrame:
    """(id, component) of the links that `verify` confirms among members(keys..., id) of one bucket; ids without a link are absent.

    verify takes distinct pairs (a, b) and returns those that are links. `also` are further pairs (a, b) to verify. All
    pairs of a bucket are never emitted: first a bucket's members meet `reps` of them, chosen by hashes (two are different members, by the
    largest and the smallest hash; more may coincide); in each further round, `reps` members of its largest component, and only members of
    other components take part; a bucket that is one component, or so small that all have met, is done. What is left after the rounds is finished exactly: members outside the largest component
    meet all members of other components. A pair within a component would add nothing to it, so no link between
    components is lost, and a big bucket of near copies costs a few stars. In this last step a bucket is dealt over as many
    tasks as its size asks for: one side is spread over salts, the other sent to all of them.
    `sketch` gives (id, carry...) for the ids(id) that are left then, and `within` tells what may be a link by these names and the keys with
    _a and _b and by a and b, as a condition of the join that makes the pairs, so that little but links leaves it; verify has them then.
    Where `within` itself tells links (`exact`), the last step asks first whether a member outside the largest component has any link into it (a
    semi-join: it stops at the first, and one row a member leaves it), and only what is outside after that meets the others; components are linked, not members.
    """
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in carry]
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    labels = None
    for step in range(rounds + 1):
        if labels is None:
            now = members.withColumn("c", F.lit(0).cast("long"))
        else:
            now = members.join(labels, "id", "left").select(*keys, "id", F.coalesce("component", "id").alias("c"))
        # Every second is the other end of the one before, so that two representatives are never one member.
        hashes = [F.xxhash64("id", F.lit(step * reps + r - r % 2)) for r in range(reps)]
        sizes = now.groupBy(*keys, "c").agg(F.count("*").alias("n"), *[(F.min if r % 2 else F.max)(h).alias(f"top{r}") for r, h in enumerate(hashes)])
        main = (
            sizes.groupBy(*keys).agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "c", *[f"top{r}" for r in range(reps)])).alias("m"))
            .where(F.lit(labels is None) | ((F.col("parts") > 1) & (F.col("all") > min(reps, 2) + 1)))
            .select(*keys, "all", F.col("m.c").alias("mc"), *[F.col(f"m.top{r}") for r in range(reps)])
        )
        live = now.join(main, keys)
        if step < rounds:
            chosen = reduce(Column.__or__, [h == F.col(f"top{r}") for r, h in enumerate(hashes)])
            stars = live.where((F.col("c") == F.col("mc")) & chosen).select(*keys, F.col("id").alias("b"))
            others = live if labels is None else live.where("c <> mc")
            pairs = others.select(*keys, F.col("id").alias("a")).join(stars, keys).where("a <> b").select(*pair)
            if labels is None and also is not None:
                pairs = pairs.unionByName(also.select(*pair))
        else:
            live = written(live.select(*keys, "id", "c", "mc", "all"))
            if live.isEmpty():
                break
            sketches = None if sketch is None else written(sketch(live.select("id").distinct()))
            drawn = lambda df: df if sketches is None else df.join(sketches, "id")
            salts = F.floor(F.col("all") / SIDE).cast("int") + 1
            spread = lambda df: df.select(*[F.col(k).alias(f"{k}_a") for k in keys], F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt_a"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("mc").alias("ma"), *of("a"))
            dealt = lambda df: df.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt_b"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("mc"), *of("b"))
            same = reduce(Column.__and__, [F.col(f"{k}_a") == F.col(f"{k}_b") for k in (*keys, "salt")])
            if exact:
                return _finish(live, keys, labels, lambda a, b, apart, how: spread(drawn(a)).join(dealt(drawn(b)), same & F.when(apart, within).otherwise(False), how))
            left, right = spread(drawn(live.where("c <> mc"))), dealt(drawn(live))
            # A condition of the join itself: a filter after it is not always drawn in, and then all pairs would leave the join.
            pairs = left.join(right, same & (F.expr(APART) if within is None else F.when(F.expr(APART), within).otherwise(False))).select(*pair)
        found = written(verify(pairs.distinct()))
        # Components so far are stars, so only what is new has to be worked in.
        edges = found if labels is None else found.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        if labels is None or not found.isEmpty():
            labels = components(edges)
    return labels
