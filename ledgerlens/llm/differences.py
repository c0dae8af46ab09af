"""Pairs of sets that may be similar, found by what sets differ in from the middle of their group.

In a group of near copies nearly everything is shared by all, so neither shared keys nor rare
elements tell its members apart; their differences from a common middle set do. With D(A) the
elements in which A and the middle M differ, |A ^ B| = |D(A)| + |D(B)| - 2 |D(A) & D(B)|, and
A and B are similar when |A ^ B| is at most a fixed share of |A| + |B|. Three cases follow:

* both so close to M that the sizes alone decide: linked, without a comparison;
* else D(A) and D(B) must share a number of elements that the sizes give, so that the first
  few elements of one, in the order from rare to frequent, must hold one of the other;
* all others are not similar, and no row is made for them.

M decides the work only, never the result; any set would do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.components import connected_components
from ledgerlens.session import Scratch

# Smaller groups have the empty set as their middle.
MIDDLE_FROM = 16
# The middle of a group meets its members in so many tasks.
SALTS = 16
# Groups whose bounds are sent to every task, up to this number (about 60 bytes each).
BROADCAST_GROUPS = 100_000


def _groups(scratch: Scratch, members: DataFrame, keys: list[str]) -> DataFrame:
    """``node``, ``component`` and ``group`` of the nodes; shared keys connect components to groups."""
    first = members.groupBy(*keys).agg(F.min("component").alias("a"))
    edges = scratch.keep(members.join(first, keys).select("a", F.col("component").alias("b")).where("a <> b").distinct(), "key_edges")
    groups = connected_components(edges, scratch).toDF("component", "group")
    return members.select("node", "component").distinct().join(groups, "component", "left").select(
        "node", "component", F.coalesce("group", "component").alias("group"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def _differences(scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """``excess`` and ``differing``, the elements in which a set and the middle of its group differ.

    Two sets are similar when the sum of their excesses is at most 2 (100 + percent) times
    the number of differing elements that they share.
    """
    large = scratch.keep(sets.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= MIDDLE_FROM), "large")
    held = sets.join(_small(large), "group").select("group", "n", F.explode("elements").alias("element"))
    middle = held.groupBy("group", "element").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(
        "2 * c > n").groupBy("group").agg(F.collect_list("element").alias("middle"))
    salted = scratch.keep(middle, "middle").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = sets.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    differing = F.when(F.col("middle").isNull(), F.col("elements")).otherwise(
        F.concat(F.array_except("elements", "middle"), F.array_except("middle", "elements")))
    excess = (100 + percent) * F.size("differing") - (100 - percent) * F.size("elements")
    return scratch.keep(dealt.join(salted, ["group", "salt"], "left").withColumn("differing", differing).select(
        "node", "print", "component", "group", "differing", excess.cast("long").alias("excess")), "differing")


def possible_pairs(scratch: Scratch, sets: DataFrame, members: DataFrame, keys: list[str],
                   percent: int) -> tuple[DataFrame, DataFrame]:
    """Certain links and the pairs that are still to be compared, both as ``a`` and ``b``.

    ``sets`` has ``node`` and ``elements`` (distinct, one row for each set of a node);
    ``members`` the ``keys`` of each ``node`` and its ``component`` so far. Every similar pair of
    nodes that shares a key directly or through others, and is not yet in one component, is
    linked by the first table or stands in the second.
    """
    groups = _groups(scratch, members, keys)
    named = scratch.keep(sets.where(F.size("elements") > 0).join(groups, "node").select(
        "node", "component", "group", F.xxhash64("elements").alias("print"), "elements").dropDuplicates(
        ["node", "print"]), "sets")
    differing = _differences(scratch, named, percent)

    # The set nearest to the middle is linked with all whose excess its own makes up for.
    nearest = scratch.keep(differing.groupBy("group").agg(
        F.min(F.struct("excess", "node")).alias("nearest")), "nearest")
    placed = differing.join(_small(nearest), "group").withColumn("far", F.col("excess") + F.col("nearest.excess") > 0)
    certain = scratch.keep(placed.where("not far and node <> nearest.node").select(
        F.least("node", "nearest.node").alias("a"), F.greatest("node", "nearest.node").alias("b")).distinct(), "certain")

    # What is left are pairs with a far set; they share at least so many elements.
    bounds = scratch.keep(placed.where("far").groupBy("group").agg(F.min("excess").alias("least_far")), "bounds")
    per_shared = 2 * (100 + percent)
    least_shared = F.ceil((F.col("excess") + F.col("least_far")) / F.lit(per_shared))
    rows = scratch.keep(placed.join(_small(bounds), "group").select(
        "node", "print", "component", "group", "far", "excess", F.size("differing").alias("n"),
        F.greatest(least_shared, F.lit(1)).alias("least_shared"), F.explode("differing").alias("element")), "elements")
    frequent = rows.where("far").groupBy("group", "element").agg(F.count("*").alias("n_far"))
    # Elements that no far set has are shared with none; they come first and take no row.
    met = rows.join(frequent, ["group", "element"])
    of_set = Window.partitionBy("node", "print")
    ranked = scratch.keep(met.withColumns({
        "place": F.row_number().over(of_set.orderBy("n_far", "element")), "present": F.count("*").over(of_set)
    }).withColumn("early", F.col("n") - F.col("present") + F.col("place") <= F.col("n") - F.col("least_shared") + 1
                  ).select("node", "component", "group", "element", "far", "early", "excess",
                           (F.col("present") - F.col("place")).alias("after")), "ranked")
    one = ranked.where("far").select(
        "group", "element", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("early").alias("early_x"),
        F.col("excess").alias("excess_x"), F.col("after").alias("after_x"))
    two = ranked.where("early").select(
        "group", "element", F.col("node").alias("y"), F.col("component").alias("cy"), "far", "excess", "after")
    # The first shared element in this order leaves no more for the rest than either set has after it.
    enough = (F.least("after", "after_x") + 1) * per_shared >= F.col("excess") + F.col("excess_x")
    pairs = one.join(two, ["group", "element"]).where("cx <> cy and (not far or (early_x and x < y))").where(
        enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return certain, pairs
