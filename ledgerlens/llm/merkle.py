"""Merkle manifest of a data set: a proof for each document, from lag and lead windows.

Each document is a leaf, the SHA-256 of its fields. The leaves of a group, in the order of the
documents, are hashed in runs of three, level by level, until one is left, the subroot of the
group; the subroots, in the order of the groups, are hashed likewise up to the root.

A node is kept in the row of its first leaf. In each level its siblings are the nodes a fixed
number of rows before and after, masked by its slot and by the length of its run, and
first children hash their parents. Rows meet in blocks of 3^5 leaves of a group, so a
busy group is spread over all tasks; each block gives one row, and the blocks are hashed on in the same
way. Going down again, every row appends the siblings of its block to its own.

Defined results: NULL fields are hashed as ``-``; a NULL group is a group, the first one; NULL
order keys come first, equal ones by leaf. Repeated rows are leaves of their own. Without
documents the manifest is empty. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.operators.ranking import running_sums
from ledgerlens.session import Scratch, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
BLOCK_LEVELS = 5
BLOCK = ARITY ** BLOCK_LEVELS


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the texts one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The leaf of a row: each value by its length in bytes and its text, NULL as ``-``."""
    texts = [v.cast("string") for v in values]
    return digest(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, run: digest(run["before"], node, run["after"]))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def _nodes_above(step: int) -> Column:
    """The nodes of the group in the level where a node spans ``step`` leaves."""
    return F.expr(f"(n + {step - 1}L) div {step}L")


def _hash_block(nodes: DataFrame) -> DataFrame:
    """``top``, the node of the block, in its first row, and ``path``, the siblings on the way to it."""
    inside = Window.partitionBy("grp", "block").orderBy("idx")
    rows = nodes.withColumn("top", F.col("node"))
    for level in range(BLOCK_LEVELS):
        step = ARITY ** level
        place = F.expr(f"idx div {step}L")
        slot = F.pmod(place, F.lit(ARITY))
        run = F.least(F.lit(ARITY), _nodes_above(step) - (place - slot))
        rows = rows.withColumns(
            {f"lag_{k}": F.lag("top", k * step).over(inside) for k in range(1, ARITY)}
            | {f"lead_{k}": F.lead("top", k * step).over(inside) for k in range(1, ARITY)})
        none = F.lit("")
        before = F.concat(*[F.when(slot >= k, F.col(f"lag_{k}")).otherwise(none) for k in range(ARITY - 1, 0, -1)])
        after = F.concat(*[F.when(slot + k < run, F.col(f"lead_{k}")).otherwise(none) for k in range(1, ARITY)])
        hashed = F.col("n") > step
        first = F.pmod("idx", F.lit(step)) == 0
        rows = rows.withColumn(
            f"run_{level}", F.when(first & hashed, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(hashed, digest(F.col("top"), F.col(f"run_{level}.after"))).otherwise(F.col("top"))
        rows = rows.withColumn("top", F.when(F.pmod("idx", F.lit(step * ARITY)) == 0, parent)).drop(
            *[f"{kind}_{k}" for kind in ("lag", "lead") for k in range(1, ARITY)])
    # The first row of each node holds its siblings; all rows below it take them over.
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = [F.last(f"run_{level}", ignorenulls=True).over(so_far) for level in range(BLOCK_LEVELS)]
    rows = rows.withColumns({f"run_{level}": run for level, run in enumerate(runs)})
    path = F.array_compact(F.array(*[f"run_{level}" for level in range(BLOCK_LEVELS)]))
    return rows.withColumn("path", path).drop(*[f"run_{level}" for level in range(BLOCK_LEVELS)])


def _ascend(scratch: Scratch, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The hashed blocks, stage by stage, and the last nodes, one for each group.

    ``nodes`` has ``grp``, ``idx`` (from 0 without gaps), ``n`` (nodes of the group) and ``node``.
    """
    stages = []
    while True:
        stage = scratch.keep(_hash_block(nodes.withColumn("block", F.expr(f"idx div {BLOCK}L"))), "blocks")
        stages.append(stage)
        nodes = stage.where(F.col("top").isNotNull()).select(
            "grp", F.col("block").alias("idx"), _nodes_above(BLOCK).alias("n"), F.col("top").alias("node"))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return stages, nodes


def _descend(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the first stage with ``path`` up to that of ``tops``, and its other columns."""
    for stage in reversed(stages):
        upper = tops.withColumnsRenamed({"idx": "block", "path": "upper"})
        upper = upper.drop(*[c for c in upper.columns if c not in ("grp", "block") and c in stage.columns])
        tops = stage.join(upper, ["grp", "block"]).withColumn("path", F.concat("path", "upper")).drop(
            "block", "upper", "top")
    return tops


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source",
                    order: str = "doc_id", carried: Mapping[str, Column] | None = None) -> DataFrame:
    """``order``'s column, ``leaf``, ``subroot``, ``root`` and ``proof`` of every document.

    ``proof`` is the list of runs from the leaf to the root: the siblings before and after it,
    as hexadecimal text. ``carried`` names further columns, computed from ``docs``; they must not be
    called like those.
    """
    carried = carried or {}
    # Text keeps its order behind one letter, and NULL comes before it.
    grp = F.coalesce(F.concat(F.lit("s"), _quoted(group).cast("string")), F.lit("-"))
    leaves = docs.select(
        grp.alias("grp"), _quoted(order).alias("key"), leaf_of([_quoted(f) for f in fields]).alias("node"),
        F.struct(F.lit(0), *[c.alias(f"c{i}") for i, c in enumerate(carried.values())]).alias("carried"),
        F.lit(1).cast("long").alias("one"))
    with Scratch(docs.sparkSession) as scratch:
        placed = running_sums(scratch, leaves, ["grp"], ["key", "node"], ["one"])
        stages, subroots = _ascend(scratch, placed.select(
            "grp", F.col("before_one").alias("idx"), F.col("all_one").alias("n"), "node", "key", "carried"))
        sources = running_sums(
            scratch, subroots.select(F.col("grp").alias("source"), "node", F.lit(1).cast("long").alias("one")),
            [], ["source"], ["one"])
        upper, roots = _ascend(scratch, sources.select(
            F.lit("").alias("grp"), F.col("before_one").alias("idx"), F.col("all_one").alias("n"), "node", "source"))
        no_path = F.array().cast("array<struct<before:string,after:string>>")
        tops = roots.select("grp", "idx", no_path.alias("path"), F.col("node").alias("root"))
        tops = _descend(upper, tops).select(
            F.col("source").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", "root",
            F.col("node").alias("subroot"))
        proven = _descend(stages, tops)
        return materialize(proven.select(
            F.col("key").alias(order), F.col("node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"),
            *[F.col(f"carried.c{i}").alias(name) for i, name in enumerate(carried)]), "manifest")


def verify(docs: DataFrame, manifest: DataFrame, fields: Sequence[str] = FIELDS, order: str = "doc_id") -> DataFrame:
    """``order``'s column and ``verified``: whether a document of the manifest still gives its root.

    Documents that are not in the manifest have NULL; the ids of both sides must be unique.
    """
    now = docs.select(_quoted(order).alias("key"), leaf_of([_quoted(f) for f in fields]).alias("now"))
    proofs = manifest.select(_quoted(order).alias("known"), "proof", "root")
    joined = now.join(proofs, F.col("key").eqNullSafe(F.col("known")), "left")
    return joined.select(
        F.col("key").alias(order), (folded_root(F.col("now"), F.col("proof")) == F.col("root")).alias("verified"))
