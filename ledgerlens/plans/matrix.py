"""The feature matrix: one row per id, all features, the label last.

Two plans with equal results: :func:`assemble` joins the single extractors,
:func:`fused_matrix` reads the transactions three times with only the columns
each pass needs. No pass shuffles whole transactions by id: rows are combined
before each shuffle, so one id may hold any part of the table. Where few rows of a group meet
in a task, combining saves little; :func:`by_id` therefore writes the transactions in buckets of
ids first, all passes over a bucket need no shuffle, and only ids with more rows than a bucket
should have go the way above.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.entropy import entropy10
from ledgerlens.functions.timeparts import (
    HIGH_SEASON_MONTHS,
    count_if,
    day_of_week,
    epoch_micros,
    mean_of_sums,
    micros_to_seconds,
)
from ledgerlens.operators import activity, codes, sessions
from ledgerlens.operators.codes import CodeTable, code_table
from ledgerlens.operators.labels import unique_labels
from ledgerlens.operators.scaling import Scaler
from ledgerlens.session import materialize, materialize_buckets, require_utc
from ledgerlens.sources.tables import Inputs

_BASE = ["total_trxn", "total_sesiones", "year_analisis", "segmento",
         "times_used_disp", "times_used_canal", "moda_cdgtrn", "moda_cdgrpta"]
_SESSION = ["total_atypical_sesion", "avg_normal_sesion"]
_CALENDAR = ["total_office_trxn", "total_night_trxn", "total_weekday_trxn",
             "total_weekend_trxn", "high_season_trxn", "low_season_trxn"]
# Columns of the transactions that features are made from.
_READ = ["id", "fecha_trxn", "canal", "disposit", "cdgtrn", "cdgrpta", "sesion"]
# Rows of a bucket of ids; an id with more of them is kept apart.
ROWS_PER_BUCKET = 250_000
# The least share of the rows that makes an id busy.
LEAST_SHARE = 2e-4
_SINGLE = ["month_entropy", "trxn_horadia_entropy", "avg_trxn_interval",
           "culpabanco_entropy", "trxn_week_entropy"]


def feature_columns(table: CodeTable) -> list[str]:
    """Feature columns in the order of the matrix."""
    return [*_BASE, *codes.CLASS_RATIOS, *_SESSION, *_CALENDAR, *table.generated,
            *_SINGLE, *sessions.THRESHOLDS]


def _finish(features: DataFrame, labels: DataFrame, table: CodeTable) -> DataFrame:
    """Full join with the labels, zeros for missing features, fixed column order."""
    joined = features.where(F.col("id").isNotNull()).join(unique_labels(labels), "id", "full")
    filled = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_columns(table)
    ]
    label = ["var_rpta"] if "var_rpta" in labels.columns else []
    return joined.select("id", *filled, *label)


def assemble(inputs: Inputs, table: CodeTable | None = None) -> DataFrame:
    """The matrix before scaling, from the single extractors."""
    trxn = inputs.transactions
    require_utc(trxn.sparkSession)
    table = table or code_table(inputs.dimension)
    parts = [
        activity.trxn_totals(trxn),
        sessions.device_top_use(trxn),
        sessions.channel_top_use(trxn),
        activity.code_modes(trxn),
        codes.class_ratios(trxn, table),
        sessions.session_stats(trxn),
        activity.calendar_counts(trxn),
        codes.group_flags(trxn, table),
        activity.month_entropy(trxn),
        activity.hour_day_entropy(trxn),
        activity.mean_gap_fast(trxn),
        codes.fault_entropy(trxn, table),
        sessions.week_entropy(trxn),
        sessions.week_thresholds(trxn),
    ]
    # Every id of a part has transactions, so all left joins start from the totals.
    features = reduce(lambda left, right: left.join(right, "id", "left"), parts)
    return _finish(features, inputs.labels, table)


def _counts_by_id(trxn: DataFrame, table: CodeTable) -> DataFrame:
    """Plain sums per id: months, hour/day cells and the weights of the dimension."""
    ts = F.col("fecha_trxn")
    counts = {
        "total_trxn": F.count("id"),
        "n": F.count("*"),
        **activity.month_counts(ts),
        **activity.hour_day_counts(ts),
    }
    if table.broadcastable:
        rows = trxn.join(F.broadcast(table.weights), list(codes.KEYS), "left")
        counts |= {w: F.sum(w) for w in table.weight_columns}
        sums = rows.groupBy("id").agg(*[c.alias(k) for k, c in counts.items()])
    else:
        plain = trxn.groupBy("id").agg(*[c.alias(k) for k, c in counts.items()])
        sums = plain.join(codes.match_codes(trxn, table), "id", "left")

    n = F.col("n")
    office = F.col("office_weekday") + F.col("office_weekend")
    weekday = F.col("office_weekday") + F.col("night_weekday")
    high = reduce(lambda a, b: a + b, [F.col(f"month_{m}") for m in HIGH_SEASON_MONTHS])
    months = [F.col(k) for k in activity.month_counts(ts)]
    cells = [F.col(k) for k in activity.hour_day_counts(ts)]
    return sums.select(
        "id",
        "total_trxn",
        office.alias("total_office_trxn"),
        (n - office).alias("total_night_trxn"),
        weekday.alias("total_weekday_trxn"),
        (n - weekday).alias("total_weekend_trxn"),
        high.alias("high_season_trxn"),
        (n - high).alias("low_season_trxn"),
        entropy10(months, n).alias("month_entropy"),
        entropy10(cells, n).alias("trxn_horadia_entropy"),
        *codes.class_ratio_columns(),
        codes.fault_entropy_column(),
        *codes.generated_columns(table),
    )


def _values_by_id(trxn: DataFrame) -> DataFrame:
    """Code modes and mean gap, from one count per (id, time), (id, code) group.

    Rows are repeated by an array, not by grouping sets, which hide how the ids are stored.
    """
    values = [epoch_micros(F.col("fecha_trxn")), F.col("cdgtrn").cast("bigint"), F.col("cdgrpta").cast("bigint")]
    repeated = trxn.select("id", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in enumerate(values)])))
    counted = repeated.groupBy("id", "kind", "value").agg(F.count("*").alias("n"))
    micros, cdgtrn, cdgrpta = (F.when(F.col("kind") == kind, F.col("value")) for kind in range(len(values)))
    gap = activity.gap_from_span(F.min(micros), F.max(micros), F.count(micros))
    return counted.groupBy("id").agg(
        activity.most_frequent(F.col("n"), cdgtrn).alias("moda_cdgtrn"),
        activity.most_frequent(F.col("n"), cdgrpta).alias("moda_cdgrpta"),
        gap.alias("avg_trxn_interval"),
    )


def _sessions_by_id(trxn: DataFrame) -> DataFrame:
    """Session features, from one row per session and three groupings of those.

    Sessions are first counted by channel and device, in whole numbers only: the row that
    stands for a session is then picked among those few, and no transaction is sorted.
    """
    mean = mean_of_sums(F.sum("high_bits"), F.sum("low_bits"), F.sum("n_times"))
    per_session = sessions.session_spots(trxn).groupBy("id", "sesion").agg(
        sessions.opening_spot().alias("first"),
        (F.max("last_micros") - F.min("first_micros")).alias("length"),
        day_of_week(mean).alias("dow"),
        F.sum("n_times").alias("n_times"),
    )
    normal = F.when(~sessions.is_long(F.col("length")), F.col("length"))
    # What a session counts for: its weekday, its channel, its device.
    kinds = {"dow": F.col("dow").cast("string"), "canal": F.col("first.canal"), "disposit": F.col("first.disposit")}
    grouped = (
        per_session.select("id", "sesion", "length", "n_times", F.inline(F.array(*[
            F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items()])))
        .groupBy("id", "kind", "value")
        .agg(
            F.count("*").alias("n"),
            F.count("sesion").alias("named"),
            count_if(sessions.is_long(F.col("length"))).alias("long"),
            F.sum(normal).alias("normal_micros"),
            F.count(normal).alias("normal"),
            F.sum("n_times").alias("times"),
            F.stddev_samp("n_times").alias("deviation"),
        )
    )
    by_day = F.col("kind") == "dow"
    limit = sessions.upper_threshold(F.col("times"), F.col("n"), F.col("deviation"))

    def total(column: str):
        return F.sum(F.when(by_day, F.col(column)))

    def on(day: int):
        return by_day & (F.col("value") == str(day))

    def most(kind: str):
        return F.max(F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.col("n")))

    day_sums = [F.sum(F.when(on(i), F.col("times")).otherwise(0)) for i in range(7)]
    return grouped.groupBy("id").agg(
        total("named").alias("total_sesiones"),
        most("disposit").alias("times_used_disp"),
        most("canal").alias("times_used_canal"),
        total("long").alias("total_atypical_sesion"),
        micros_to_seconds(total("normal_micros"), total("normal")).alias("avg_normal_sesion"),
        entropy10(day_sums, total("times")).alias("trxn_week_entropy"),
        *[
            F.max(F.when(on(i), limit)).alias(name)
            for i, name in enumerate(sessions.THRESHOLDS)
        ],
    )


def _features_by_id(trxn: DataFrame, table: CodeTable) -> DataFrame:
    """All features but those of the labels, from three pruned passes."""
    return (
        _counts_by_id(trxn, table)
        .join(_values_by_id(trxn), "id", "left")
        .join(_sessions_by_id(trxn), "id", "left")
    )


def busy_ids(trxn: DataFrame, rows: int, most: int) -> list[int]:
    """Ids with more than ``most`` of the ``rows`` transactions, and ``LEAST_SHARE`` of them at least.

    Every id of such a share is among the frequent ones, and those alone are counted.
    """
    if rows <= most:
        return []
    share = max(most / rows, LEAST_SHARE)
    frequent = trxn.select("id").freqItems(["id"], share).first()[0]
    counted = trxn.where(F.col("id").isin(frequent)).groupBy("id").agg(F.count("*").alias("n"))
    return sorted(r.id for r in counted.where(F.col("n") > share * rows).collect())


def by_id(trxn: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The transactions written in buckets of ids, and those of busy ids, if any, in no order.

    Rows without an id are in no matrix and are left out.
    """
    kept = trxn.select(*_READ).where(F.col("id").isNotNull())
    rows = kept.count()
    busy = busy_ids(kept, rows, ROWS_PER_BUCKET)
    is_busy = F.col("id").isin(busy)
    others = kept.where(~is_busy) if busy else kept
    buckets = max(1, ceil(rows / ROWS_PER_BUCKET))
    return materialize_buckets(others, "by_id", buckets, "id"), kept.where(is_busy) if busy else None


def fused_matrix(inputs: Inputs, table: CodeTable | None = None, grouped: bool = False) -> DataFrame:
    """The matrix before scaling, from three pruned passes over the transactions.

    ``grouped`` writes the transactions by id first, which suits stored ones of any size.
    """
    trxn = inputs.transactions
    require_utc(trxn.sparkSession)
    table = table or code_table(inputs.dimension)
    busy = None
    if grouped:
        trxn, busy = by_id(trxn)
    features = _features_by_id(trxn, table)
    if busy is not None:
        features = features.unionByName(_features_by_id(busy, table))
    return _finish(features, inputs.labels, table)


def build_features(inputs: Inputs, scaler: Scaler | None = None) -> tuple[DataFrame, Scaler]:
    """The scaled matrix, and the scaler used.

    The statistics are fitted on the given set unless a scaler is passed, for
    example the one of the training set when scoring.
    """
    matrix = materialize(fused_matrix(inputs, grouped=True), "matrix")
    features = [c for c in matrix.columns if c not in ("id", "var_rpta")]
    scaler = scaler or Scaler.fit(matrix, features)
    return scaler.transform(matrix), scaler
