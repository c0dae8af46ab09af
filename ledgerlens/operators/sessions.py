"""Features made from sessions, that is from (id, sesion) groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.entropy import entropy10
from ledgerlens.functions.timeparts import (
    LONG_SESSION_MICROS,
    WEEKDAY_NAMES,
    count_if,
    day_of_week,
    epoch_micros,
    mean_time,
    micros_to_seconds,
    share,
    time_sums,
)

THRESHOLDS = tuple(f"umbral_trxn_{day}" for day in WEEKDAY_NAMES)


def first_row(*columns: str) -> Column:
    """Aggregate: ``columns`` of the earliest row, NULL times last.

    Ties go to the smallest values of the columns in the given order.
    """
    ts = F.col("fecha_trxn")
    rest = [F.col(c) for c in columns]
    return F.min(F.struct(ts.isNull().alias("undated"), ts, *rest))


def session_representative(trxn: DataFrame) -> DataFrame:
    """One whole row per session: the earliest one."""
    rest = ("canal", "disposit", "cdgtrn", "cdgrpta", "vlrtran")
    picked = trxn.groupBy("id", "sesion").agg(first_row(*rest).alias("first"))
    return picked.select(
        "id", "first.fecha_trxn", *[f"first.{c}" for c in rest], "sesion"
    )


def session_spots(trxn: DataFrame) -> DataFrame:
    """Times of each (id, sesion, canal, disposit): whole numbers, so rows are hashed, not sorted."""
    micros = epoch_micros(F.col("fecha_trxn"))
    sums = time_sums(micros)
    return trxn.groupBy("id", "sesion", "canal", "disposit").agg(
        F.min(micros).alias("first_micros"), F.max(micros).alias("last_micros"),
        *[c.alias(k) for k, c in sums.items()])


def opening_spot() -> Column:
    """Aggregate over the spots of a session: canal and disposit of its ``first_row``."""
    at = F.col("first_micros")
    return F.min(F.struct(at.isNull().alias("undated"), at, F.col("canal"), F.col("disposit")))


def _top_use(trxn: DataFrame, column: str, name: str) -> DataFrame:
    micros = epoch_micros(F.col("fecha_trxn"))
    spots = trxn.groupBy("id", "sesion", "canal", "disposit").agg(F.min(micros).alias("first_micros"))
    first = spots.groupBy("id", "sesion").agg(opening_spot().alias("first"))
    uses = (
        first.select("id", F.col(f"first.{column}").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("id", "value")
        .agg(F.count("*").alias("n"))
    )
    return uses.groupBy("id").agg(F.max("n").alias(name))


def device_top_use(trxn: DataFrame) -> DataFrame:
    """Sessions opened on the most used device; ids without any device are absent."""
    return _top_use(trxn, "disposit", "times_used_disp")


def channel_top_use(trxn: DataFrame) -> DataFrame:
    """Sessions opened on the most used channel; ids without any channel are absent."""
    return _top_use(trxn, "canal", "times_used_canal")


def session_length(ts: Column) -> Column:
    """Aggregate: microseconds from the first to the last time of the group."""
    return epoch_micros(F.max(ts)) - epoch_micros(F.min(ts))


def is_long(length: Column) -> Column:
    """Strictly more than an hour; a NULL length is not long."""
    return F.coalesce(length > LONG_SESSION_MICROS, F.lit(False))


def session_stats(trxn: DataFrame) -> DataFrame:
    """Sessions of more than an hour, and the mean seconds of the others."""
    sessions = trxn.groupBy("id", "sesion").agg(
        session_length(F.col("fecha_trxn")).alias("length")
    )
    length = F.col("length")
    normal = F.when(~is_long(length), length)
    totals = sessions.groupBy("id").agg(
        count_if(is_long(length)).alias("total_atypical_sesion"),
        F.sum(normal).alias("total"),
        F.count(normal).alias("n"),
    )
    return totals.select(
        "id",
        "total_atypical_sesion",
        micros_to_seconds(F.col("total"), F.col("n")).alias("avg_normal_sesion"),
    )


def session_days(trxn: DataFrame) -> DataFrame:
    """Per session: weekday of its mean time and its number of dated transactions."""
    ts = F.col("fecha_trxn")
    return trxn.groupBy("id", "sesion").agg(
        day_of_week(mean_time(ts)).alias("dow"), F.count(ts).alias("n_times")
    )


def upper_threshold(total: Column, n: Column, deviation: Column) -> Column:
    """Mean plus three sample deviations; NULL with fewer than two sessions."""
    return share(total, n) + 3 * deviation


def _by_weekday(trxn: DataFrame) -> DataFrame:
    return session_days(trxn).groupBy("id", "dow").agg(
        F.count("*").alias("n"),
        F.sum("n_times").alias("total"),
        F.stddev_samp("n_times").alias("deviation"),
    )


def week_entropy(trxn: DataFrame) -> DataFrame:
    """Entropy of the weekday shares, a session counting on the day of its mean time."""
    days = _by_weekday(trxn).groupBy("id").agg(
        F.sum("total").alias("n"),
        *[
            F.sum(F.when(F.col("dow") == i, F.col("total")).otherwise(0)).alias(day)
            for i, day in enumerate(WEEKDAY_NAMES)
        ],
    )
    parts = [F.col(day) for day in WEEKDAY_NAMES]
    return days.select("id", entropy10(parts, F.col("n")).alias("trxn_week_entropy"))


def week_thresholds(trxn: DataFrame) -> DataFrame:
    """Per weekday, mean plus three deviations of the transactions per session.

    The first name, ``lun``, holds day 0, which is Sunday: names and numbers
    are kept as users of these columns know them, one day off.
    """
    limit = upper_threshold(F.col("total"), F.col("n"), F.col("deviation"))
    return _by_weekday(trxn).groupBy("id").agg(
        *[
            F.max(F.when(F.col("dow") == i, limit)).alias(name)
            for i, name in enumerate(THRESHOLDS)
        ]
    )
