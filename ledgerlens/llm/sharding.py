"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Documents are ordered by their key columns. Ranges of that order are summed up, the sums of
the ranges are added one after another, and rows are summed on inside their range; so every
row knows the bytes before it. The whole is cut at equal targets: a row goes to the shard in
whose part of the total the middle of the row lies. So a shard differs from its target by at
most the size of a row at its borders.

Defined results: a NULL text has no bytes; each row counts one byte more (a line end), so
empty texts move shards on, too. NULL keys come first. Rows of equal keys are ordered by
size and then anyhow; equal rows may lie on both sides of a cut. A row larger than a shard's
target leaves other shards empty. Without rows the result is empty. All columns stay; input
columns called ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.ranking import running_sums
from ledgerlens.session import Scratch, materialize

SHARDS = 8


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text and one for its end."""
    return (F.coalesce(F.octet_length(_quoted(text_col)), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, order: Sequence[str] = ("doc_id",),
                   size: Column | None = None) -> DataFrame:
    """The columns of ``docs``, ``shard`` from 0 and ``slot``, the place in the shard from 0.

    ``size`` (at least 0, not NULL) is by default that of ``text``. Only the given columns are
    moved: select the keys and a size to plan shards without moving the texts.
    """
    keys = {f"key_{i}": _quoted(name) for i, name in enumerate(order)}
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*[_quoted(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
        *[column.alias(name) for name, column in keys.items()],
        (text_bytes() if size is None else size).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    shard = F.least(F.expr(f"(2 * before_size + size) * {shards} div greatest(2 * all_size, 1)"), F.lit(shards - 1))
    with Scratch(docs.sparkSession) as scratch:
        placed = running_sums(scratch, rows, [], [*keys, "size"], ["size", "one"]).select(
            "row", shard.cast("int").alias("shard"), "before_one")
        firsts = placed.groupBy("shard").agg(F.min("before_one").alias("first"))
        # One row for each shard.
        slots = placed.join(F.broadcast(firsts), "shard").select(
            *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "shard",
            (F.col("before_one") - F.col("first")).cast("long").alias("slot"))
        return materialize(slots, "shards")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet files in a folder for each shard, in the order of the slots."""
    part = F.floor(F.col("slot") / rows_per_file)
    ordered = sharded.repartition("shard", part).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
