"""Order statistics and row positions without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.session import Scratch

# Key ranges counted in one job: at most for one rank, for all of them, at least for one.
BINS = 10_000
ALL_BINS = 100_000
MIN_BINS = 64
ROWS_PER_BUCKET = 50_000
# Starts of so many buckets are summed up in one task.
BLOCK_BUCKETS = 10_000
BROADCAST_BUCKETS = 1_000_000


class KeyRanks:
    """The integer keys at given ranks of several groups, found together without sorting.

    One job takes the span of the keys of each group; then each job counts keys in equal
    ranges, for all ranks at once, and goes on inside the ranges that hold one, until they are one
    key wide: about two such jobs for keys below 10^8. Rows without a key are in no rank.
    """

    def __init__(self, df: DataFrame, key: str, by: Sequence[str] = ()):
        self._rows, self._key, self._by = df.where(F.col(key).isNotNull()), key, list(by)
        spans = self._rows.groupBy(*by).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n"))
        self._spans = {
            tuple(r[c] for c in by): (r.lo, r.hi, r.n) for r in spans.collect() if r.n}

    @property
    def counts(self) -> dict[tuple, int]:
        """Rows of each group that has any."""
        return {group: n for group, (_, _, n) in self._spans.items()}

    def at(self, wanted: Iterable[tuple[tuple, int]]) -> dict[tuple[tuple, int], int | None]:
        """The ``k``-th smallest key (1-based) of a group for every (group, k); None if there are fewer rows."""
        wanted = set(wanted)
        found: dict[tuple[tuple, int], int | None] = dict.fromkeys(wanted)
        open_ = {(group, k): (*self._spans[group][:2], k) for group, k in wanted if 1 <= k <= self.counts.get(group, 0)}
        while open_:
            found |= {at: lo for at, (lo, hi, _) in open_.items() if lo == hi}
            open_ = {at: span for at, span in open_.items() if span[0] < span[1]}
            if open_:
                open_ = self._narrowed(open_)
        return found

    def _narrowed(self, open_: dict) -> dict:
        """Each open (lo, hi, rank inside) cut down to the bin that holds the rank, by one job."""
        ranges = sorted({(group, lo, hi) for (group, _), (lo, hi, _) in open_.items()}, key=str)
        bins = max(MIN_BINS, min(BINS, ALL_BINS // len(ranges)))
        widths = [(hi - lo) // bins + 1 for _, lo, hi in ranges]
        number = place = None
        for i, ((group, lo, hi), width) in enumerate(zip(ranges, widths)):
            inside = F.col(self._key).between(lo, hi)
            for column, value in zip(self._by, group):
                inside &= F.col(column).eqNullSafe(F.lit(value))
            bin_of = F.expr(f"(cast(`{self._key}` as bigint) - {lo}L) div {width}L")
            number = F.when(inside, i) if number is None else number.when(inside, i)
            place = F.when(inside, bin_of) if place is None else place.when(inside, bin_of)
        counted = self._rows.select(number.alias("number"), place.alias("place")).where("number is not null")
        histograms: dict[int, list] = {i: [] for i in range(len(ranges))}
        for r in sorted(counted.groupBy("number", "place").agg(F.count("*").alias("n")).collect()):
            histograms[r.number].append((r.place, r.n))
        narrowed = {}
        for at, (lo, hi, rank) in open_.items():
            i = ranges.index((at[0], lo, hi))
            reached = accumulate(n for _, n in histograms[i])
            bin_, n, total = next((bin_, n, total) for (bin_, n), total in zip(histograms[i], reached) if total >= rank)
            begin = lo + bin_ * widths[i]
            narrowed[at] = begin, min(hi, begin + widths[i] - 1), rank - (total - n)
        return narrowed


def kth_smallest(df: DataFrame, key: str, k: int) -> int | None:
    """The ``k``-th smallest integer key (1-based), None if there are fewer rows."""
    return KeyRanks(df, key).at([((), k)])[(), k]


def shuffled_positions(
    df: DataFrame, key: str, seed: int, rows: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``position`` 0, 1, 2 ... in a random order fixed by ``seed`` and the keys.

    ``rows`` is the number of rows. They are ordered by a hash of the key inside
    even hash buckets, and each bucket starts where the one before ended.
    ``by`` numbers each group on its own.
    """
    buckets = max(1, ceil(rows / ROWS_PER_BUCKET))
    hashed = df.withColumn("hash", F.xxhash64(F.lit(seed), F.col(key))).withColumn(
        "bucket", F.pmod("hash", F.lit(buckets)).cast("int")
    )
    ordered = Window.partitionBy(*by, "bucket").orderBy("hash", key)
    counted = hashed.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    begins = starts(counted, by, "bucket", buckets)
    # A row for each bucket and group of ``by``; few enough are sent to every task.
    begins = F.broadcast(begins) if buckets <= BROADCAST_BUCKETS else begins
    numbered = hashed.withColumn("place", F.row_number().over(ordered) - 1)
    return (
        numbered.join(begins, [*by, "bucket"])
        .withColumn("position", (F.col("start") + F.col("place")).cast("bigint"))
        .drop("hash", "bucket", "place", "start")
    )


def starts(counted: DataFrame, by: tuple[str, ...], bucket: str, buckets: int) -> DataFrame:
    """``start``: the sum of ``n`` over the buckets before, level by level in bounded windows."""
    if buckets <= BLOCK_BUCKETS:
        before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("n").over(before), F.lit(0))
        return counted.withColumn("start", start).drop("n")
    blocked = counted.withColumn("block", (F.col(bucket) / BLOCK_BUCKETS).cast("int"))
    blocks = blocked.groupBy(*by, "block").agg(F.sum("n").alias("n"))
    upper = starts(blocks, by, "block", ceil(buckets / BLOCK_BUCKETS)).withColumnRenamed("start", "upper")
    inside = Window.partitionBy(*by, "block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return blocked.withColumn("lower", lower).join(upper, [*by, "block"]).withColumn(
        "start", F.col("upper") + F.col("lower")).drop("n", "block", "upper", "lower")


def in_ranges(
    scratch: Scratch, rows: DataFrame, keys: Sequence[str], seed: int = 0, distinct: bool = False
) -> DataFrame:
    """``rows`` written in ranges of the keys, with ``part``, the number of the range.

    Every row of a lower ``part`` is before or equal to those of a higher one. Rows of equal
    keys may lie in several ranges; ``tie``, a random number, orders them. Rows of ``distinct`` keys need none.
    """
    mixed = rows if distinct else rows.withColumn("tie", F.rand(seed))
    ties = [] if distinct else ["tie"]
    ranged = mixed.repartitionByRange(*keys, *ties).withColumn("part", F.spark_partition_id())
    return scratch.keep(ranged, "ranges")


def running_sums(
    scratch: Scratch, rows: DataFrame, by: Sequence[str], order: Sequence[str], weights: Sequence[str],
    distinct: bool = False,
) -> DataFrame:
    """Add ``before_<w>``, the sum of each weight over the rows before in the group, and ``all_<w>``.

    Groups (``by``, not NULL) are ordered by ``order``, NULLs first, rows of equal order in any
    order. Rows are written in ranges of group and order; the sums of the ranges are summed
    up, one row for each range and group, and rows are only numbered inside their range. So no
    task holds a whole group. ``distinct`` says that no two rows of a group have equal order.
    """
    ranged = in_ranges(scratch, rows, [*by, *order], distinct=distinct)
    ties = [] if distinct else ["tie"]
    sums = ranged.groupBy(*by, "part").agg(*[F.sum(w).alias(w) for w in weights])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(
        *by, "part",
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"before_{w}") for w in weights],
        *[F.sum(w).over(group).alias(f"all_{w}") for w in weights],
    )
    inside = Window.partitionBy(*by, "part").orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{w}": F.col(f"before_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}
    return ranged.join(begins, [*by, "part"]).withColumns(before).drop("part", *ties)


def at_most(key: str, cut: int | None, everything: bool) -> Column:
    """Rows up to the cut key; without a cut either all rows or none."""
    if cut is None:
        return F.lit(everything)
    return F.col(key) <= cut
