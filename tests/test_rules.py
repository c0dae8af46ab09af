"""Hand-made rows with literal expected values."""

import math

import pytest

from frames import codes, labels, one, times, trxn
from ledgerlens.operators import activity, codes as code_ops, sessions
from ledgerlens.operators.labels import label_base, unique_labels
from ledgerlens.plans.matrix import assemble, fused_matrix
from ledgerlens.sources.tables import Inputs

DAY = "2019-03-04 "  # a Monday


@pytest.mark.parametrize("texts, long, mean", [
    (("10:00:00", "11:00:00"), 0, 3600.0),
    (("10:00:00", "11:00:00.000001"), 1, None),
    (("10:00:00",), 0, 0.0),
    ((None, None), 0, None),
])
def test_session_length(spark, texts, long, mean):
    rows = times(spark, *[t and DAY + t for t in texts])
    got = one(sessions.session_stats(rows))
    assert (got["total_atypical_sesion"], got["avg_normal_sesion"]) == (long, mean)


def test_sessions_without_time_do_not_count_in_the_mean(spark):
    rows = trxn(spark, [
        {"t": None, "sesion": 1},
        {"t": DAY + "10:00:00", "sesion": 2}, {"t": DAY + "10:00:30", "sesion": 2},
    ])
    assert one(sessions.session_stats(rows))["avg_normal_sesion"] == 30.0


def test_office_hours_are_inclusive(spark):
    rows = times(spark, *[DAY + h for h in ("08:59:00", "09:00:00", "18:59:00", "19:00:00")])
    got = one(activity.calendar_counts(rows))
    assert (got["total_office_trxn"], got["total_night_trxn"]) == (2, 2)


def test_weekend(spark):
    got = one(activity.calendar_counts(times(spark, "2019-03-03 10:00", "2019-03-09 10:00")))
    assert (got["total_weekday_trxn"], got["total_weekend_trxn"]) == (0, 2)


@pytest.mark.parametrize("month, high", [(1, 1), (2, 0), (5, 0), (6, 1), (7, 1), (8, 0), (11, 0), (12, 1)])
def test_season(spark, month, high):
    got = one(activity.calendar_counts(times(spark, f"2019-{month:02d}-05 10:00")))
    assert (got["high_season_trxn"], got["low_season_trxn"]) == (high, 1 - high)


def test_null_time_is_night_weekend_low_season_but_in_no_cell(spark):
    rows = times(spark, None)
    got = one(activity.calendar_counts(rows))
    assert (got["total_night_trxn"], got["total_weekend_trxn"], got["low_season_trxn"]) == (1, 1, 1)
    assert one(activity.hour_day_entropy(rows))["trxn_horadia_entropy"] == 0.0
    half = times(spark, None, DAY + "10:00")
    expected = -0.5 * math.log10(0.5)
    assert one(activity.hour_day_entropy(half))["trxn_horadia_entropy"] == pytest.approx(expected)
    assert one(activity.month_entropy(half))["month_entropy"] == pytest.approx(expected)


@pytest.mark.parametrize("values, mode", [
    ((3, 1, 3, 1, None), 1), ((None, None), None), ((-2, -2, 5), -2), ((None, None, 4), 4),
    ((-2**31, 2**31 - 1), -2**31), ((2**31 - 1, 2**31 - 1, 0), 2**31 - 1),
])
def test_mode(spark, values, mode):
    rows = trxn(spark, [{"cdgtrn": v, "cdgrpta": 9} for v in values])
    got = one(activity.code_modes(rows))
    assert (got["moda_cdgtrn"], got["moda_cdgrpta"]) == (mode, 9)


@pytest.mark.parametrize("gap", [activity.mean_gap, activity.mean_gap_fast])
def test_repeated_times_count_once(spark, gap):
    rows = times(spark, DAY + "10:00:00", DAY + "10:00:00", DAY + "10:00:10")
    assert one(gap(rows))["avg_trxn_interval"] == 10.0
    assert one(gap(times(spark, DAY + "10:00", DAY + "10:00")))["avg_trxn_interval"] is None
    assert one(gap(times(spark, None, None)))["avg_trxn_interval"] is None
    mixed = times(spark, None, DAY + "10:00:00", "2019-03-05 10:00:00")
    assert one(gap(mixed))["avg_trxn_interval"] == 86400.0


def test_gaps_cross_the_hour(spark):
    rows = times(spark, DAY + "10:59:59", DAY + "11:00:01", DAY + "15:00:00")
    got = {r.fecha_trxn.hour: r.gap_micros for r in activity.time_gaps(rows).collect()}
    assert got == {10: 2_000_000, 11: 14_399_000_000, 15: None}


def test_month_entropy(spark):
    assert one(activity.month_entropy(times(spark, "2019-01-01", "2019-02-01")))[
        "month_entropy"] == pytest.approx(0.301030, abs=1e-6)
    got = one(activity.month_entropy(times(spark, "2019-01-01", "2018-01-03")))["month_entropy"]
    assert got == 0 and math.copysign(1, got) == 1


def test_one_session_on_a_weekday_has_no_threshold(spark):
    got = one(sessions.week_thresholds(times(spark, DAY + "10:00")))
    assert got["umbral_trxn_mar"] is None
    # Monday is day 1, which carries the name of Tuesday.
    two = trxn(spark, [{"t": DAY + "10:00", "sesion": 1}] + [{"t": DAY + "11:00", "sesion": 2}] * 3)
    assert one(sessions.week_thresholds(two))["umbral_trxn_mar"] == pytest.approx(2 + 3 * math.sqrt(2))


def test_week_uses_the_mean_time_of_a_session(spark):
    rows = times(spark, "2019-03-04 22:00", "2019-03-05 01:00", "2019-03-05 04:00", None)
    got = one(sessions.session_days(rows))
    assert (got["dow"], got["n_times"]) == (2, 3)
    assert one(sessions.week_entropy(rows))["trxn_week_entropy"] == 0.0


def test_mean_time_is_exact(spark):
    # Half a microsecond before midnight rounds into the next day.
    near = times(spark, "2019-03-04 23:59:59.999999", "2019-03-05 00:00:00")
    assert one(sessions.session_days(near))["dow"] == 2
    before = times(spark, "1969-12-31 23:00", "1969-12-31 23:30")
    assert one(sessions.session_days(before))["dow"] == 3


def test_week_without_times(spark):
    assert one(sessions.week_entropy(times(spark, None)))["trxn_week_entropy"] is None


def test_first_row_of_a_session(spark):
    rows = trxn(spark, [
        {"t": None, "canal": "a"}, {"t": DAY + "10:00", "canal": "z", "disposit": "D2"},
        {"t": DAY + "10:00", "canal": "m", "disposit": "D9"}, {"t": DAY + "11:00", "canal": "b"},
    ])
    got = one(sessions.session_representative(rows))
    assert (got["canal"], got["disposit"], got["sesion"]) == ("m", "D9", 1)


def test_top_use_counts_sessions_and_skips_null(spark):
    rows = trxn(spark, [
        {"t": DAY + "10:00", "sesion": 1, "disposit": "A"}, {"t": DAY + "10:01", "sesion": 1, "disposit": "B"},
        {"t": DAY + "10:00", "sesion": 2, "disposit": "A"}, {"t": DAY + "10:00", "sesion": 3, "disposit": None},
        {"id": 2, "sesion": 1, "disposit": None},
    ])
    assert {r.id: r.times_used_disp for r in sessions.device_top_use(rows).collect()} == {1: 2}
    assert {r.id: r.times_used_canal for r in sessions.channel_top_use(rows).collect()} == {1: 3, 2: 1}


def test_totals_ignore_null_sessions(spark):
    rows = trxn(spark, [{"sesion": None}, {"sesion": 4}, {"sesion": 4}])
    assert one(activity.trxn_totals(rows)) == {"id": 1, "total_trxn": 3, "total_sesiones": 1}


@pytest.mark.parametrize("limit", [code_ops.BROADCAST_BYTES, 0])
def test_whole_number_division(spark, limit):
    dimension = codes(spark, [
        {"cdgtrn": 1, "grupo": "A / B"}, {"cdgtrn": 2, "grupo": "#C D", "culpa_banco": "SI"},
        {"cdgtrn": 3, "grupo": None, "producto": None},
    ])
    table = code_ops.code_table(dimension, limit)
    assert table.broadcastable is (limit > 0)
    assert table.generated == ["ratio_dg_a_b", "ratio_dg_c_d", "ratio_pa_credito"]
    rows = trxn(spark, [{"id": 1, "cdgtrn": 1}] * 3 + [{"id": 2, "cdgtrn": 1}] * 3
                + [{"id": 2, "cdgtrn": 2}, {"id": 3, "cdgtrn": 99}, {"id": 4, "cdgtrn": None}])
    flags = {r.id: (r.ratio_dg_a_b, r.ratio_dg_c_d) for r in code_ops.group_flags(rows, table).collect()}
    assert flags == {1: (1, 0), 2: (0, 0)}
    shares = {r.id: r.ratio_dg_a_b for r in code_ops.group_flags(rows, table, True).collect()}
    assert shares == {1: 1.0, 2: 0.75}
    entropy = {r.id: r.culpabanco_entropy for r in code_ops.fault_entropy(rows, table).collect()}
    assert entropy[1] == 0.0
    assert entropy[2] == pytest.approx(-(0.25 * math.log10(0.25) + 0.75 * math.log10(0.75)))


@pytest.mark.parametrize("limit", [code_ops.BROADCAST_BYTES, 0])
def test_duplicate_dimension_keys_multiply_rows(spark, limit):
    dimension = codes(spark, [{"clasif_trxn": "Financiera"}, {"clasif_trxn": "Otra"}])
    assert one(code_ops.duplicate_keys(dimension))["n"] == 2
    table = code_ops.code_table(dimension, limit)
    assert one(code_ops.class_ratios(trxn(spark, [{}]), table))["ratio_financiera"] == 0.5


def test_colliding_column_names_are_an_error(spark):
    dimension = codes(spark, [{"grupo": "A B"}, {"cdgtrn": 2, "grupo": "a-b"}])
    with pytest.raises(ValueError, match="ratio_dg_a_b"):
        code_ops.code_table(dimension)


def test_code_cleaning(spark):
    raw = spark.createDataFrame([("None", "100.0"), ("2.5", "-0.5"), (None, "7"), ("2.4999999", "-1.2")],
                                "cdgtrn string, cdgrpta string")
    got = [tuple(r) for r in code_ops.clean_codes(raw).collect()]
    assert got == [(-1, 100), (3, -1), (None, 7), (2, -1)]


def test_year_and_optional_label(spark):
    base = labels(spark, (1, 201907, 1, 3))
    assert one(label_base(base))["year_analisis"] == 2019
    assert "var_rpta" not in label_base(base.drop("var_rpta")).columns


def test_label_id_twice_is_an_error(spark):
    twice = labels(spark, (1, 201907, 1, 3), (1, 201908, 0, 3))
    with pytest.raises(Exception, match="more than one row for id 1"):
        unique_labels(twice).collect()


@pytest.mark.parametrize("plan", [assemble, fused_matrix])
def test_outer_assembly(spark, plan):
    rows = trxn(spark, [{"id": 1, "t": DAY + "10:00"}, {"id": 2, "t": DAY + "10:00", "cdgtrn": 99}])
    known = labels(spark, (2, 201907, 1, 3), (3, 201907, 0, 4))
    matrix = plan(Inputs(rows, known, codes(spark, [{}])))
    got = {r.id: r.asDict() for r in matrix.collect()}
    assert set(got) == {1, 2, 3}
    assert matrix.columns[0] == "id" and matrix.columns[-1] == "var_rpta"
    assert (got[1]["segmento"], got[1]["year_analisis"], got[1]["var_rpta"]) == (0, 0, None)
    assert (got[2]["ratio_exitosa"], got[2]["total_trxn"], got[2]["var_rpta"]) == (0, 1, 1)
    assert (got[3]["total_trxn"], got[3]["segmento"]) == (0, 4)
    assert (got[1]["ratio_exitosa"], got[1]["ratio_dg_retiros"]) == (1, 1)
    unlabelled = plan(Inputs(rows, known.drop("var_rpta"), codes(spark, [{}])))
    assert unlabelled.columns == matrix.columns[:-1]
