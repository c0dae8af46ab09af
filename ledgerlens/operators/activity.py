"""Features of a customer that need the transactions alone.

Every function takes the transactions and gives one row per ``id``.
Groups are pre-aggregated before each shuffle, and counting by value goes
through (id, value) groups, so one very busy id never lands whole in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.entropy import entropy10
from ledgerlens.functions.timeparts import (
    count_if,
    epoch_micros,
    in_high_season,
    in_office_hours,
    micros_to_seconds,
    on_business_day,
)

MONTHS = tuple(range(1, 13))
# Microseconds of the blocks in which times are compared: a second, an hour.
GAP_BLOCKS = (1_000_000, 3_600_000_000)


def trxn_totals(trxn: DataFrame) -> DataFrame:
    """Transactions and distinct sessions."""
    return trxn.groupBy("id").agg(
        F.count("id").alias("total_trxn"),
        F.count_distinct("sesion").alias("total_sesiones"),
    )


def calendar_counts(trxn: DataFrame) -> DataFrame:
    """Office/night, weekday/weekend and high/low season counts.

    The second of each pair is everything that is not the first, so a NULL time
    counts as night, weekend and low season.
    """
    ts = F.col("fecha_trxn")
    pairs = {
        ("total_office_trxn", "total_night_trxn"): in_office_hours(ts),
        ("total_weekday_trxn", "total_weekend_trxn"): on_business_day(ts),
        ("high_season_trxn", "low_season_trxn"): in_high_season(ts),
    }
    sums = []
    for (inside, outside), condition in pairs.items():
        sums.append(count_if(condition).alias(inside))
        sums.append(F.sum(F.when(condition, 0).otherwise(1)).alias(outside))
    return trxn.groupBy("id").agg(*sums)


def month_counts(ts: Column) -> dict[str, Column]:
    """Aggregates: transactions of each calendar month."""
    return {f"month_{m}": count_if(F.month(ts) == m) for m in MONTHS}


def hour_day_counts(ts: Column) -> dict[str, Column]:
    """Aggregates: the four office/night x weekday/weekend cells.

    A NULL time is in no cell.
    """
    office, business = in_office_hours(ts), on_business_day(ts)
    return {
        "office_weekday": count_if(office & business),
        "night_weekday": count_if(~office & business),
        "office_weekend": count_if(office & ~business),
        "night_weekend": count_if(~office & ~business),
    }


def _entropy_by_id(trxn: DataFrame, counts: dict[str, Column], name: str) -> DataFrame:
    cells = trxn.groupBy("id").agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in counts.items()]
    )
    return cells.select("id", entropy10([F.col(k) for k in counts], F.col("n")).alias(name))


def month_entropy(trxn: DataFrame) -> DataFrame:
    """Entropy of the twelve month shares."""
    return _entropy_by_id(trxn, month_counts(F.col("fecha_trxn")), "month_entropy")


def hour_day_entropy(trxn: DataFrame) -> DataFrame:
    """Entropy of the four office/night x weekday/weekend shares."""
    return _entropy_by_id(trxn, hour_day_counts(F.col("fecha_trxn")), "trxn_horadia_entropy")


def most_frequent(n: Column, value: Column) -> Column:
    """Aggregate over (value, n) rows: the value of the highest n, the smallest on a tie.

    Count and 32-bit value form one number whose maximum is wanted; unlike a
    struct, a number can be kept in a hash aggregation without sorting.
    """
    size, largest = 1 << 32, (1 << 31) - 1
    key = n.cast("decimal(20,0)") * F.lit(size) + (F.lit(largest) - value.cast("bigint"))
    best = F.max(F.when(value.isNotNull(), key))
    return (F.lit(largest) - F.pmod(best, F.lit(size))).cast("int")


def code_modes(trxn: DataFrame) -> DataFrame:
    """Most frequent transaction and response code; NULL codes do not count."""
    counted = trxn.groupingSets(
        [["id", "cdgtrn"], ["id", "cdgrpta"]], "id", "cdgtrn", "cdgrpta"
    ).agg(F.count("*").alias("n"))
    # A column outside its grouping set is NULL there and so drops out.
    return counted.groupBy("id").agg(
        most_frequent(F.col("n"), F.col("cdgtrn")).alias("moda_cdgtrn"),
        most_frequent(F.col("n"), F.col("cdgrpta")).alias("moda_cdgrpta"),
    )


def time_gaps(trxn: DataFrame) -> DataFrame:
    """Each distinct time of an id with the microseconds to the next one.

    Times are compared inside a second of an id, which has a million at most; the first and last
    times of the seconds inside an hour, and those of the hours inside the id. So no task gets more than
    these bounds of one id, however many rows it has and wherever they crowd.
    """
    times = trxn.select("id", epoch_micros(F.col("fecha_trxn")).alias("first")).distinct()
    followed = _followed(times.withColumn("last", F.col("first")), GAP_BLOCKS)
    return followed.select(
        "id",
        F.timestamp_micros("last").cast("timestamp_ntz").alias("fecha_trxn"),
        (F.col("next") - F.col("last")).alias("gap_micros"),
    )


def _followed(spans: DataFrame, blocks: tuple[int, ...]) -> DataFrame:
    """The ``last`` of every span of an id with the ``first`` of the one after it as ``next``.

    Spans are compared inside blocks of time; what a block holds is one span among the blocks. The
    last span of a block gets its next from there, so nothing has to be joined.
    """
    if not blocks:
        following = F.lead("first").over(Window.partitionBy("id").orderBy("first"))
        return spans.select("id", "last", following.alias("next"))
    placed = spans.withColumn("block", F.floor(F.col("first") / F.lit(blocks[0])))
    following = F.lead("first").over(Window.partitionBy("id", "block").orderBy("first"))
    inside = placed.select("id", "last", following.alias("next")).where("next is not null")
    wider = placed.groupBy("id", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return inside.unionByName(_followed(wider.drop("block"), blocks[1:]))


def mean_gap(trxn: DataFrame) -> DataFrame:
    """Mean seconds between consecutive distinct times, from the single gaps."""
    gaps = time_gaps(trxn).groupBy("id").agg(
        F.sum("gap_micros").alias("total"), F.count("gap_micros").alias("n")
    )
    return gaps.select(
        "id", micros_to_seconds(F.col("total"), F.col("n")).alias("avg_trxn_interval")
    )


def gap_from_span(first: Column, last: Column, n_times: Column) -> Column:
    """Mean gap in seconds: consecutive gaps add up to the whole span."""
    return micros_to_seconds(last - first, n_times - 1)


def mean_gap_fast(trxn: DataFrame) -> DataFrame:
    """Same as :func:`mean_gap` without sorting: span over distinct times less one."""
    spans = (
        trxn.select("id", epoch_micros(F.col("fecha_trxn")).alias("micros"))
        .distinct()
        .groupBy("id")
        .agg(
            F.min("micros").alias("first"),
            F.max("micros").alias("last"),
            F.count("micros").alias("n"),
        )
    )
    gap = gap_from_span(F.col("first"), F.col("last"), F.col("n"))
    return spans.select("id", gap.alias("avg_trxn_interval"))
