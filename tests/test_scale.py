"""Skewed input, properties of the matrix, and the shape of the plans."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from compare import rows_of
from frames import CODES, LABELS, TRXN, codes
from ledgerlens.operators import activity, codes as code_ops, sessions
from ledgerlens.operators.codes import code_table
from ledgerlens.plans.matrix import assemble, fused_matrix
from ledgerlens.sources.tables import Inputs, cluster_by_id

START = datetime(2019, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """A third of the rows belongs to one id, and half of those to one session."""
    rng = random.Random(11)
    made = []
    for i in range(6000):
        hot = i % 3 == 0
        session = 0 if hot and rng.random() < 0.5 else rng.choice([None, *range(1, 400)])
        made.append((
            0 if hot else rng.randrange(1, 200),
            None if rng.random() < 0.02 else START + timedelta(minutes=rng.randrange(500_000)),
            rng.choice(["web", "app", None]), rng.choice(["D0", "D1", "D2"]),
            rng.randrange(6), rng.choice([0, 0, 0, 1, None]), rng.random(), session,
        ))
    return made


@pytest.fixture(scope="module")
def inputs(spark, rows):
    dimension = [
        (c, d, t, r, rng_class, outcome, fault, f"Grupo {t % 2}", f"P{t % 3}")
        for c in ("web", "app") for d in ("D0", "D1") for t in range(5) for r in range(2)
        for rng_class, outcome, fault in [("Financiera" if t else "Otra", "Exitosa" if r else "No Exitosa", "SI" if t == 2 else None)]
    ]
    dimension += dimension[:7]
    return Inputs(
        spark.createDataFrame(rows, TRXN),
        spark.createDataFrame([(i, 201901, i % 2, i % 5) for i in range(0, 260)], LABELS),
        spark.createDataFrame(dimension, CODES),
    )


@pytest.fixture(scope="module")
def matrix(inputs):
    return fused_matrix(inputs).toPandas().set_index("id").sort_index()


def test_against_plain_python(rows, matrix):
    by_id = defaultdict(list)
    for row in rows:
        by_id[row[0]].append(row)
    for key, group in by_id.items():
        got = matrix.loc[key]
        times = sorted({r[1] for r in group if r[1]})
        assert got.total_trxn == len(group)
        assert got.total_sesiones == len({r[7] for r in group if r[7] is not None})
        for column, at in (("moda_cdgtrn", 4), ("moda_cdgrpta", 5)):
            counts = Counter(r[at] for r in group if r[at] is not None)
            assert got[column] == min(counts, key=lambda v: (-counts[v], v))
        gap = (times[-1] - times[0]).total_seconds() / (len(times) - 1)
        assert got.avg_trxn_interval == pytest.approx(gap)
        opened = defaultdict(list)
        for r in group:
            opened[r[7]].append(r)
        first = [min(s, key=lambda r: (r[1] is None, r[1] or START, r[2] or "", r[3])) for s in opened.values()]
        assert got.times_used_disp == max(Counter(r[3] for r in first).values())
        spans = [[r[1] for r in s if r[1]] for s in opened.values()]
        lengths = [(max(s) - min(s)).total_seconds() for s in spans if s]
        assert got.total_atypical_sesion == sum(x > 3600 for x in lengths)
        normal = [x for x in lengths if x <= 3600]
        assert got.avg_normal_sesion == pytest.approx(sum(normal) / len(normal) if normal else 0)


def test_fused_equals_separate(inputs, matrix):
    other = assemble(inputs).toPandas().set_index("id").sort_index()
    assert list(other.columns) == list(matrix.columns)
    assert ((other.fillna(-1) - matrix.fillna(-1)).abs() < 1e-9).all().all()


def test_joined_by_shuffle_equals_broadcast(inputs, matrix):
    table = code_table(inputs.dimension, broadcast_bytes=0)
    assert not table.broadcastable
    other = fused_matrix(inputs, table).toPandas().set_index("id").sort_index()
    assert ((other.fillna(-1) - matrix.fillna(-1)).abs() < 1e-9).all().all()


def test_order_and_partitions_do_not_matter(spark, inputs, matrix):
    shuffled = Inputs(inputs.transactions.repartition(13).orderBy("vlrtran"), inputs.labels, inputs.dimension)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = fused_matrix(shuffled).toPandas().set_index("id").sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ((other.fillna(-1) - matrix.fillna(-1)).abs() < 1e-9).all().all()


def test_lead_gaps_equal_the_span(inputs):
    slow = rows_of(activity.mean_gap(inputs.transactions).toPandas())
    assert slow == rows_of(activity.mean_gap_fast(inputs.transactions).toPandas())


def test_matrix_properties(matrix):
    m = matrix
    pairs = [("total_office_trxn", "total_night_trxn"), ("total_weekday_trxn", "total_weekend_trxn"),
             ("high_season_trxn", "low_season_trxn")]
    for a, b in pairs:
        assert (m[a] + m[b] == m.total_trxn).all()
    for column, cells in (("month_entropy", 12), ("trxn_horadia_entropy", 4),
                          ("culpabanco_entropy", 2), ("trxn_week_entropy", 7)):
        # Undated rows are one more cell that adds nothing.
        assert m[column].between(0, math.log10(cells + 1)).all()
    assert (m.total_atypical_sesion <= m.total_sesiones + 1).all()


def plan_of(spark, build) -> str:
    """Plan text without run-time changes, joins by id not broadcast for being tiny."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.fixture(scope="module")
def stored(spark, inputs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plan"))
    for name in ("transactions", "labels", "dimension"):
        getattr(inputs, name).write.parquet(f"{folder}/{name}")
    read = [spark.read.parquet(f"{folder}/{n}") for n in ("transactions", "labels", "dimension")]
    return Inputs(*read)


def test_fused_plan(spark, stored):
    text = plan_of(spark, lambda: fused_matrix(stored))
    scans = [line for line in text.splitlines() if "FileScan" in line and "transactions]" in line]
    assert len(scans) == 3
    assert not any("vlrtran" in line.split("ReadSchema")[-1] for line in scans)
    assert text.count("BroadcastHashJoin") == 1 and "CartesianProduct" not in text
    lines = text.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    # Three groupings of sessions, two of values, one of counts, the labels, the dimension.
    assert len(exchanges) == 8
    for i in exchanges:
        below = next(line for line in lines[i + 1:] if "Aggregate" in line or "FileScan" in line)
        assert "partial_" in below, lines[i]


@pytest.mark.parametrize("operator", [
    activity.trxn_totals, activity.calendar_counts, activity.month_entropy, activity.hour_day_entropy,
    activity.code_modes, activity.mean_gap_fast, sessions.session_representative,
    sessions.device_top_use, sessions.session_stats, sessions.week_entropy, sessions.week_thresholds,
])
def test_rows_are_combined_before_each_shuffle(spark, stored, operator):
    lines = plan_of(spark, lambda: operator(stored.transactions)).splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges
    for i in exchanges:
        below = next(line for line in lines[i + 1:] if "Aggregate" in line or "FileScan" in line)
        assert "Aggregate" in below
    assert "Window" not in "".join(lines) and "SinglePartition" not in "".join(lines)


def test_no_column_is_read_in_vain(spark, stored):
    text = plan_of(spark, lambda: activity.calendar_counts(stored.transactions))
    assert "ReadSchema: struct<id:bigint,fecha_trxn:timestamp_ntz>" in text


def test_whole_stage_code(spark, stored):
    text = plan_of(spark, lambda: activity.calendar_counts(stored.transactions))
    assert "*(1)" in text and "*(2)" in text


def test_dimension_size_is_checked(spark):
    small = codes(spark, [{"cdgtrn": i} for i in range(10)])
    assert code_table(small).broadcastable
    assert not code_table(small, broadcast_bytes=500).broadcastable
    text = plan_of(spark, lambda: code_ops.class_ratios(
        spark.createDataFrame([], TRXN), code_table(small, broadcast_bytes=0)))
    assert "hashpartitioning(canal" in text and "salt" in text


def test_a_busy_id_takes_several_files(spark, inputs, tmp_path):
    clustered = cluster_by_id(inputs.transactions, 12)
    path = str(tmp_path / "clustered")
    clustered.write.parquet(path)
    files = spark.read.parquet(path).selectExpr("id", "input_file_name() file").distinct()
    hot = files.where("id = 0").count()
    assert hot >= 3
    assert files.count() < 200 + 3 * 12
    assert rows_of(spark.read.parquet(path).toPandas()) == rows_of(inputs.transactions.toPandas())


def test_gaps_of_one_busy_hour_are_spread(spark):
    """One id with all its rows in one hour: equal to the plain window, and no task has a large part."""
    rows = spark.range(200_000).selectExpr(
        "if(id % 50 = 0, cast(id % 7 as int), null) id",
        "timestamp_ntz'2019-01-01 10:00:00' + make_dt_interval(0, 0, 0, (id * 7919 % 3600000) / 1000D) fecha_trxn")
    rows = rows.selectExpr("coalesce(id, 99) id", "fecha_trxn")
    got = rows_of(activity.time_gaps(rows).toPandas())
    plain = rows.distinct().selectExpr(
        "id", "fecha_trxn",
        "timestampdiff(MICROSECOND, fecha_trxn, lead(fecha_trxn) over (partition by id order by fecha_trxn)) gap_micros")
    assert got == rows_of(plain.toPandas())
    seconds = rows.distinct().groupBy("id", "fecha_trxn").count()
    tasks = seconds.selectExpr("pmod(hash(id, unix_seconds(cast(fecha_trxn as timestamp))), 8) task").groupBy("task").count()
    shares = [r["count"] for r in tasks.collect()]
    assert len(shares) == 8 and max(shares) < 2 * sum(shares) / 8


def test_session_pass_hashes_instead_of_sorting(inputs, spark):
    """The pass over the transactions of the sessions has no sort aggregation."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sessions.session_spots(inputs.transactions)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "HashAggregate" in plan and "SortAggregate" not in plan
