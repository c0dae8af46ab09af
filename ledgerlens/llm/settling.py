"""Components of things that share keys, with as few comparisons as an exact result allows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.components import connected_components
from ledgerlens.session import Scratch

# So many times more hubs are compared in each round.
MORE_HUBS = 32


def placed_members(scratch: Scratch, members: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``node``, ``place``, ``n`` and ``hub`` for the keys that several nodes share.

    ``members`` has distinct (``keys``, ``node``) rows with ``fame``, how many keys the node has.
    ``place`` orders the nodes of a key by it; the node in the middle of a group of near copies comes first.
    ``n`` counts them and ``hub`` is the first.
    """
    by_fame = Window.partitionBy(*keys).orderBy(F.desc("fame"), "node")
    placed = members.withColumns({
        "place": F.row_number().over(by_fame), "n": F.count("*").over(Window.partitionBy(*keys)),
        "hub": F.first("node").over(by_fame)})
    return scratch.keep(placed.where("n > 1").drop("fame"), "open")


def with_components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``component`` of every row by its ``node``; a node without links is its own."""
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def settle(scratch: Scratch, members: DataFrame, keys: list[str], links: DataFrame,
           verify: Callable[[DataFrame], DataFrame],
           hopeful: Callable[[DataFrame], DataFrame] | None = None,
           narrow: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, best_first: bool = True) -> DataFrame:
    """``node``, ``component`` of all linked nodes.

    ``members`` comes from ``placed_members``; ``links`` (``a``, ``b``) are known before;
    ``verify`` keeps those of the pairs (``a``, ``b``) that are links. Each node is compared with
    the node that is the first of most of its keys, then with the first of its other keys; then the next 32
    of each key are compared with those behind them, the next 1024 and so on, each only
    with nodes that no link found so far connects with it, until every key is settled: its
    nodes are all connected or all compared. Between rounds ``hopeful`` may leave out members
    that cannot be linked to any other. Without ``best_first`` all first nodes are met at once, which
    takes fewer jobs and is right for small sets. With ``narrow`` there is one round of first nodes only;
    then it gives certain links and the few pairs of the open members that are left to compare.
    """
    labels = connected_components(links, scratch)
    compared: list[DataFrame] = []
    begin, width = 1, 1
    if best_first and not members.isEmpty():
        # What these connect need not be compared with the first nodes of its other keys.
        best = scratch.keep(_best_pairs(members, labels), "best_pairs")
        compared.append(best)
        found = verify(best)
        if not found.isEmpty():
            links = links.union(found)
            labels = connected_components(links, scratch)
    pairs = _first_pairs(members, labels)
    members = members.drop("hub")
    while not members.isEmpty():
        if begin > 1:
            named = with_components(members, labels)
            hubs = named.where((F.col("place") >= begin) & (F.col("place") < begin + width)).select(
                *keys, F.col("node").alias("hub"), F.col("place").alias("hub_place"),
                F.col("component").alias("hub_component"))
            pairs = named.join(hubs, keys).where("place > hub_place and component <> hub_component").select(
                F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        # A pair that shares several keys is compared once; refuted pairs are not met again.
        for before in compared:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "pairs")
        compared.append(pairs)
        found = verify(pairs)
        if not found.isEmpty():
            links = links.union(found)
            labels = connected_components(links, scratch)
        begin, width = begin + width, width * MORE_HUBS
        members = _unsettled(scratch, members, keys, labels, begin)
        if hopeful is not None and not members.isEmpty():
            members = _unsettled(scratch, scratch.keep(hopeful(members), "hopeful"), keys, labels, begin)
        if narrow is not None and not members.isEmpty():
            certain, left = narrow(scratch.keep(with_components(members, labels), "narrowed"))
            for before in compared:
                left = left.join(before, ["a", "b"], "left_anti")
            left = scratch.keep(left, "left")
            return connected_components(links.union(certain).union(verify(left)), scratch)
    return labels


def _first_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node and the first of each of its keys, once, unless they are connected."""
    return _between(members.where("place > 1").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), labels)


def _best_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node and the one that is the first of most of its keys, unless they are connected."""
    met = members.where("place > 1").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("best"))
    return _between(best.select(
        F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct(), labels)


def _between(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of nodes that are not connected."""
    for end in ("a", "b"):
        met = met.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
    return met.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def _unsettled(scratch: Scratch, members: DataFrame, keys: list[str], labels: DataFrame, begin: int) -> DataFrame:
    """Members of the keys with different components and a place from ``begin`` on behind the first."""
    # Keys of no more nodes are settled, whatever the components.
    members = members.where(F.col("n") > begin)
    unsettled = with_components(members, labels).groupBy(*keys).agg(
        F.max("place").alias("last"), F.min("component").alias("least"), F.max("component").alias("most")
    ).where((F.col("last") > begin) & (F.col("least") < F.col("most"))).select(*keys)
    return scratch.keep(members.join(unsettled, keys, "left_semi"), "open")
