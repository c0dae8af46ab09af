"""Mixing sources to target weights by Poisson replication.

Each source has a rate, the mean number of times that its documents shall occur. Every
document draws its own number of copies from a Poisson distribution of that mean, by
inverting the distribution at a uniform number hashed from seed and id; it is exploded by
that number, and all copies are dealt out by a hash and sorted by it.

Defined results: NULL is a source like any other; a NULL id hashes as the empty text.
Rows of one id draw the same number. NULL or empty texts are copied like others. Without
rows the result is empty. All columns stay, whatever their names; only an input column
called ``mix_copy`` is replaced.
Sources missing from an explicit table of weights get no copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.names import column, columns
from ledgerlens.session import materialize

# Larger means are drawn as sums of parts, each at most this.
PART_MEAN = 8.0
# Beyond this many successes the tail of a part is below 2**-53, the step of the draw.
PART_TERMS = 48
# Rates go to every task while there are at most so many sources (400 bytes each).
BROADCAST_SOURCES = 10_000
SALTS = 64
DRAW_STEPS = float(2 ** 52)


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def hashed_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hashed_draw(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1), in steps of 2**-52, the same in every engine that has md5."""
    digits = F.substring(hashed_key(seed, *parts), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(DRAW_STEPS)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None,
                 exponent: float = 0.5, total: float | None = None,
                 source_col: str = "source") -> DataFrame:
    """``mix_source``, ``mix_rate``: the mean copies per document of each source.

    ``weights`` are the target shares by source (scaled to sum 1); without them a source's
    share is its row count to the power ``exponent``. ``total`` rows are aimed at, by
    default as many as there are.
    """
    counts = materialize(docs.groupBy(column(source_col).alias("mix_source")).agg(
        F.count("*").alias("n")), "mix-counts")
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("mix_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    weighted = counts.withColumn("weight", weight)
    sums = weighted.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not sums["n"] or not sums["weight"]:
        rate = F.lit(0.0)
    else:
        target = float(sums["n"] if total is None else total)
        rate = F.col("weight") * F.lit(target) / F.lit(sums["weight"]) / F.col("n")
    return weighted.select("mix_source", rate.cast("double").alias("mix_rate"))


def _distribution(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... PART_TERMS successes."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"),
                        F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PART_TERMS)), start, step, lambda acc: acc["all"])


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None,
                exponent: float = 0.5, total: float | None = None, seed: int = 7,
                id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` and ``mix_copy`` (from 1), in an order shuffled over all rows."""
    kept = [c for c in docs.columns if c != "mix_copy"]
    # Whole rows go along as one column, so no name of theirs meets one used here.
    packed = docs.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns(kept))]).alias("row"),
                         _text(column(id_col)).alias("key"), column(source_col).alias("source"))
    rates = source_rates(docs, weights, exponent, total, source_col)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART_MEAN).cast("int"))
    table = materialize(
        rates.where(F.col("mix_rate") > 0).withColumn("mix_parts", parts).select(
            "mix_source", "mix_parts",
            _distribution(F.col("mix_rate") / F.col("mix_parts")).alias("mix_levels"),
        ), "mix-rates")
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if table.count() <= BROADCAST_SOURCES:
        joined = packed.join(F.broadcast(table), same)
    else:
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.join(salted, same & (salt == F.col("mix_salt")))
    key = F.col("key")
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts")),
                        lambda j: hashed_draw(seed, key, j.cast("string")))
    copies = F.aggregate(
        F.transform(draws, lambda u: F.size(F.filter("mix_levels", lambda level: level <= u))),
        F.lit(0), lambda acc, n: acc + n,
    )
    counted = joined.select("row", "key", copies.alias("mix_copies")).where("mix_copies > 0")
    copied = counted.select(
        "row", "key", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    place = hashed_key(seed, F.lit("place"), key, F.col("mix_copy").cast("string"))
    dealt = copied.withColumn("mix_place", place).repartition("mix_place")
    return dealt.sortWithinPartitions("mix_place").select(
        *[F.col(f"row.c{i}").alias(name) for i, name in enumerate(kept)], "mix_copy")
