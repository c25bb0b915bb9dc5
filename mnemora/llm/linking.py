"""Links inside buckets, and their connected components, with DataFrame operations only.

A bucket of m vertices has m*m/2 pairs. So every member is tested first against the pivot of each of its buckets, round by round; what is linked is joined into components, and ``settle`` goes on only in buckets whose members still lie in several
components. The last round takes all pairs across components that no round has tested. A pair inside a component
can't change it, so every pair of every bucket is settled, by a test or by being connected. That last round emits a pair in
the least bucket it shares only, and may be given a sharper estimate of similarity to leave out pairs that are clearly apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, small


def components(links: DataFrame) -> DataFrame:
    """``(k, component)`` for every vertex of ``links (a, b)``: the smallest vertex it reaches.

    Rounds of contraction. Each vertex points to the neighbour of least hash if that is less than its own, and on to
    where that one points; then links are of the vertices pointed to, so a star is gone after two rounds and a chain, whatever
    its order, has a third of its links left. Where vertices point to is kept for each round and followed back at the end,
    so a round costs what its remaining links cost. xxhash64 of a long is one to one: no two vertices tie.
    """
    place = F.xxhash64
    links = cut(links.where("a <> b").select("a", "b"))
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("k")).agg(F.min_by("b", place("b")).alias("p")).where(place("p") < place("k"))
        further = nearest.select(F.col("k").alias("p"), F.col("p").alias("q"))
        points = cut(nearest.join(further, "p", "left").select("k", F.coalesce("q", "p").alias("p")))
        rounds.append(points)
        size = points.count()
        ends = lambda c: small(points.select(F.col("k").alias(c), F.col("p").alias(f"to_{c}")), size)
        moved = links.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        left = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(links)
        links = left
    labels = links.select(F.col("a").alias("k"), F.col("b").alias("root"))
    for points in reversed(rounds):
        own = points.join(labels.select(F.col("k").alias("p"), "root"), "p", "left").select("k", F.coalesce("root", "p").alias("root"))
        labels = cut(own.unionByName(labels.join(points.select("k"), "k", "left_anti")))
    least = labels.groupBy("root").agg(F.least(F.min("k"), F.col("root")).alias("component"))  # a root itself never points on
    named = cut(labels.join(least, "root").select("k", "component").unionByName(least.select(F.col("root").alias("k"), "component")))
    discard(labels, *rounds)
    return named


def joined(labels: DataFrame, size: int, links: DataFrame) -> DataFrame:
    """``(k, component)`` when ``links (a, b)`` come to ``size`` rows of ``labels``: only what they join is labelled anew."""
    of = lambda c: small(labels.select(F.col("k").alias(c), F.col("component").alias(f"of_{c}")), size)
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    anew = components(between.distinct())
    moved = anew.select(F.col("k").alias("component"), F.col("component").alias("to"))
    kept = labels.join(small(moved, anew.count()), "component", "left").select("k", F.coalesce("to", "component").alias("component"))
    return cut(kept.unionByName(anew.join(labels.select("k"), "k", "left_anti")))


def settle(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column],
    sharpen: Callable[[DataFrame], DataFrame] | None = None,
    alike: Callable[[Column, Column], Column] | None = None,
    gain: float = 0.02,
) -> DataFrame:
    """``(k, component)`` of linked vertices, from ``(band, k, mark)``, the members of shared buckets.

    ``verify`` keeps the linked of pairs ``(a, b)``, a < b; pairs whose marks aren't ``near`` can't be linked and are
    never emitted. ``sharpen`` gives ``(k, marks)`` for vertices ``(k)``, and ``alike`` tests two marks in the last round.
    Rounds of pivots go on while they link more than ``gain`` of the members still open, so that a large group is one
    component, or nearly, before pairs are taken; this decides when links are found, not which.
    """
    spark = members.sparkSession
    labels = spark.range(0).selectExpr("id as k", "id as component")
    tested = spark.range(0).selectExpr("id as a", "id as b")
    size = turn = 0
    pivots = True
    while True:
        placed = members.join(small(labels, size), "k", "left").select("band", "k", "mark", F.coalesce("component", "k").alias("component"))
        pivot = F.min_by(F.struct("k", "mark", "component"), F.xxhash64("k", F.lit(turn))).alias("pivot")
        mixed = placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), pivot).where("c0 < c1").select("band", "pivot")
        open_rows = cut(placed.join(mixed, "band"))
        if open_rows.isEmpty():
            return labels
        if pivots:
            found = open_rows.where((F.col("component") != F.col("pivot.component")) & near(F.col("mark"), F.col("pivot.mark")))
            # of the pivots that are one component already a member meets one
            met = found.groupBy("k", "pivot.component").agg(F.min_by("pivot.k", F.xxhash64("pivot.k", F.lit(turn))).alias("p"))
            pairs = met.select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b"))
        else:
            sharp = _sharpened(open_rows.drop("pivot"), members, sharpen)
            discard(open_rows)
            pairs = _all_pairs(sharp, near, alike)
        fresh = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti") if turn else pairs.distinct())
        linked = 0
        if not fresh.isEmpty():
            tested = tested.unionByName(fresh)
            more = cut(verify(fresh))
            linked = more.count()
        if linked:
            labels = joined(labels, size, more) if size else components(more)
            size = labels.count()
        if not pivots:
            discard(sharp)
            return labels
        pivots = linked > gain * open_rows.agg(F.approx_count_distinct("k")).first()[0]
        discard(open_rows)
        turn += 1


def _sharpened(rows: DataFrame, members: DataFrame, sharpen) -> DataFrame:
    """``rows (band, k, mark, component)`` with the marks that ``sharpen`` gives and the keys of each vertex."""
    keys = members.groupBy("k").agg(F.collect_set("band").alias("keys"))
    vertices = rows.select("k").distinct()
    marks = sharpen(vertices) if sharpen else vertices.withColumn("marks", F.lit(0))
    return cut(rows.join(marks.join(keys, "k"), "k"))


def _all_pairs(sharp: DataFrame, near, alike) -> DataFrame:
    """Pairs ``(a, b)`` of ``sharp (band, k, mark, component, marks, keys)`` across components, each in the least of all its shared buckets."""
    a, b = sharp.alias("a"), sharp.alias("b")
    fits = (F.col("a.component") < F.col("b.component")) & near(F.col("a.mark"), F.col("b.mark"))
    if alike:
        fits &= alike(F.col("a.marks"), F.col("b.marks"))
    least = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.band")
    return a.join(b, (F.col("a.band") == F.col("b.band")) & fits & least).select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"))
