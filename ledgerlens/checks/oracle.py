"""The same queries as plain DuckDB SQL, written from their definitions."""

from __future__ import annotations

_EVENT_TABLES = r"""
ev as (
  select user_id id, ts, event_type canal, value,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) k,
    cast(epoch_us(ts) // 21600000000 - 78888 as int) sesion
  from events),
trxn as (
  select id, ts + to_days(cast((sesion % 12) * 30 as int)) fecha_trxn, canal,
    concat('D', cast(k % 3 as varchar)) disposit, cast(k % 8 as int) cdgtrn,
    cast(k % 5 as int) cdgrpta, value vlrtran, sesion
  from ev),
maestro as (
  select distinct canal, concat('D', cast(k % 3 as varchar)) disposit,
    cast(k % 8 as int) cdgtrn, cast(k % 5 as int) cdgrpta,
    case when k % 2 = 0 then 'Financiera' else 'Administrativa' end clasif_trxn,
    case when k % 5 = 0 then 'No Exitosa' when k % 5 = 4 then 'Parcial' else 'Exitosa' end clasif_cod_rpta,
    case when k % 7 = 0 then 'SI' when k % 7 = 1 then null else 'NO' end culpa_banco,
    case when k % 3 = 0 then 'Pagos / Recaudos' when k % 3 = 1 then 'Consultas #1' else 'Retiros' end descripcion_grupo,
    case when k = 1 then 'Credito' else 'Cuenta / Ahorros' end producto_asociado
  from ev where k % 11 <> 0)"""

_ORDER_TABLES = r"""
trxn as (
  select o_custkey id,
    l_shipdate + to_hours(cast(l_partkey % 24 as int)) + to_minutes(cast(l_linenumber * 7 as int)) fecha_trxn,
    l_returnflag canal, l_linestatus disposit, cast(l_partkey % 8 as int) cdgtrn,
    cast(l_suppkey % 5 as int) cdgrpta, l_extendedprice vlrtran, cast(l_orderkey as int) sesion
  from lineitem join orders on l_orderkey = o_orderkey),
maestro as (
  select distinct canal, disposit, cdgtrn, cdgrpta,
    case when cdgtrn % 2 = 0 then 'Financiera' else 'Administrativa' end clasif_trxn,
    case when cdgrpta = 0 then 'No Exitosa' when cdgrpta = 4 then 'Parcial' else 'Exitosa' end clasif_cod_rpta,
    case when cdgtrn = 0 then 'SI' when cdgtrn = 1 then null else 'NO' end culpa_banco,
    case when cdgtrn < 3 then 'Pagos / Recaudos' when cdgtrn < 6 then 'Consultas #1' else 'Retiros' end descripcion_grupo,
    case when cdgtrn = 7 and cdgrpta = 3 then 'Credito' else 'Cuenta / Ahorros' end producto_asociado
  from trxn where not (cdgtrn = 5 and cdgrpta = 2))"""

_SHARED = r"""
rpta as (
  select c_custkey id, cast(201901 + c_custkey % 12 as int) f_analisis,
    cast(case when c_acctbal < 3000 then 1 else 0 end as int) var_rpta,
    cast(c_nationkey % 5 as int) segmento
  from customer where c_custkey % 10 <> 9),
matched as (
  select t.id, m.clasif_trxn, m.clasif_cod_rpta, m.culpa_banco, m.descripcion_grupo, m.producto_asociado
  from trxn t join maestro m
    on t.canal = m.canal and t.disposit = m.disposit and t.cdgtrn = m.cdgtrn and t.cdgrpta = m.cdgrpta),
first_rows as (
  select id, fecha_trxn, canal, disposit, cdgtrn, cdgrpta, vlrtran, sesion
  from (select *, row_number() over (partition by id, sesion order by fecha_trxn nulls last,
          canal, disposit, cdgtrn, cdgrpta, vlrtran) rn from trxn)
  where rn = 1),
session_days as (
  select id, sesion, count(fecha_trxn) n_times,
    cast(extract(dow from make_timestamp(
      cast((2 * sum(epoch_us(fecha_trxn)) + count(fecha_trxn)) // (2 * count(fecha_trxn)) as bigint))) as int) dow
  from trxn group by id, sesion)"""

DAYS = ("lun", "mar", "mie", "jue", "vie", "sab", "dom")
GENERATED = {
    "ratio_dg_consultas_1": ("descripcion_grupo", "Consultas #1"),
    "ratio_dg_pagos_recaudos": ("descripcion_grupo", "Pagos / Recaudos"),
    "ratio_dg_retiros": ("descripcion_grupo", "Retiros"),
    "ratio_pa_credito": ("producto_asociado", "Credito"),
    "ratio_pa_cuenta_ahorros": ("producto_asociado", "Cuenta / Ahorros"),
}


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def _entropy(table: str, conditions: list[str], name: str, weight: str = "1", whole: str = "count(*)") -> str:
    sums = ", ".join(
        f"sum(case when {c} then {weight} else 0 end)::double / {whole} p{i}"
        for i, c in enumerate(conditions)
    )
    terms = " + ".join(
        f"(case when p{i} = 0 then 0 else p{i} * log10(nullif(p{i}, 0)) end)"
        for i in range(len(conditions))
    )
    return f"select id, 0 - ({terms}) {name} from (select id, {sums} from {table} group by id)"


def _sums(pairs: dict[str, str]) -> str:
    return ", ".join(
        f"cast(sum(case when {condition} then {yes} else {1 - yes} end) as bigint) {name}"
        for name, (condition, yes) in pairs.items()
    )


_OFFICE = "extract(hour from fecha_trxn) between 9 and 18"
_WEEKDAY = "extract(dow from fecha_trxn) between 1 and 5"
_HIGH = "extract(month from fecha_trxn) in (1, 6, 7, 12)"
_CELLS = [f"({a}{_OFFICE}) and ({b}{_WEEKDAY})" for a in ("", "not ") for b in ("", "not ")]


def _top_use(column: str, name: str) -> str:
    return f"""select id, max(n) {name} from (
      select id, {column}, count(*) n from first_rows where {column} is not null group by id, {column})
      group by id"""


def _mode(column: str) -> str:
    return f"""select id, {column} from (
        select id, {column}, row_number() over (partition by id order by count(*) desc, {column}) rn
        from trxn where {column} is not null group by id, {column}) where rn = 1"""


def _generated(fraction: bool) -> str:
    divide = "{0}::double / count(*)" if fraction else "cast({0} // count(*) as bigint)"
    columns = [
        divide.format(f"sum(case when {c} = '{v}' then 1 else 0 end)") + f" {name}"
        for name, (c, v) in GENERATED.items()
    ]
    return f"select id, {', '.join(columns)} from matched group by id"


_GAPS = """select id, fecha_trxn, cast(epoch_us(lead(fecha_trxn) over (partition by id order by fecha_trxn))
      - epoch_us(fecha_trxn) as bigint) gap_micros from (select distinct id, fecha_trxn from trxn)"""
_MEAN_GAP = f"""select id, sum(gap_micros)::double / (nullif(count(gap_micros), 0) * 1e6::double) avg_trxn_interval
      from ({_GAPS}) group by id"""

_THRESHOLDS = ", ".join(
    f"""sum(n_times) filter (dow = {i})::double / nullif(count(*) filter (dow = {i}), 0)
      + 3 * stddev_samp(n_times) filter (dow = {i}) umbral_trxn_{day}"""
    for i, day in enumerate(DAYS)
)

FEATURES = {
    "trxn_totals": """select id, count(id) total_trxn, count(distinct sesion) total_sesiones
      from trxn group by id""",
    "device_top_use": _top_use("disposit", "times_used_disp"),
    "channel_top_use": _top_use("canal", "times_used_canal"),
    "code_modes": f"""select a.id, t.cdgtrn moda_cdgtrn, r.cdgrpta moda_cdgrpta
      from (select distinct id from trxn) a
      left join ({_mode('cdgtrn')}) t on a.id = t.id left join ({_mode('cdgrpta')}) r on a.id = r.id""",
    "class_ratios": """select id,
      sum(case when clasif_trxn = 'Financiera' then 1 else 0 end)::double / count(*) ratio_financiera,
      sum(case when clasif_cod_rpta = 'Exitosa' then 1 else 0 end)::double / count(*) ratio_exitosa,
      sum(case when clasif_cod_rpta = 'No Exitosa' then 1 else 0 end)::double / count(*) ratio_no_exitosa
      from matched group by id""",
    "session_stats": """select id,
        cast(sum(case when len > 3600000000 then 1 else 0 end) as bigint) total_atypical_sesion,
        sum(len) filter (len <= 3600000000)::double
          / (nullif(count(len) filter (len <= 3600000000), 0) * 1e6::double) avg_normal_sesion
      from (select id, sesion, epoch_us(max(fecha_trxn)) - epoch_us(min(fecha_trxn)) len
            from trxn group by id, sesion) group by id""",
    "calendar_counts": "select id, " + _sums({
        "total_office_trxn": (_OFFICE, 1), "total_night_trxn": (_OFFICE, 0),
        "total_weekday_trxn": (_WEEKDAY, 1), "total_weekend_trxn": (_WEEKDAY, 0),
        "high_season_trxn": (_HIGH, 1), "low_season_trxn": (_HIGH, 0),
    }) + " from trxn group by id",
    "group_flags": _generated(False),
    "month_entropy": _entropy(
        "trxn", [f"extract(month from fecha_trxn) = {m}" for m in range(1, 13)], "month_entropy"),
    "hour_day_entropy": _entropy("trxn", _CELLS, "trxn_horadia_entropy"),
    "mean_gap": _MEAN_GAP,
    "fault_entropy": _entropy(
        "matched", ["culpa_banco = 'SI'", "culpa_banco is distinct from 'SI'"], "culpabanco_entropy"),
    "week_entropy": _entropy(
        "session_days", [f"dow = {i}" for i in range(7)], "trxn_week_entropy", "n_times",
        "nullif(sum(n_times), 0)"),
    "week_thresholds": f"select id, {_THRESHOLDS} from session_days group by id",
}

_NAMES = {
    "trxn_totals": ["total_trxn", "total_sesiones"],
    "labels": ["year_analisis", "segmento"],
    "device_top_use": ["times_used_disp"],
    "channel_top_use": ["times_used_canal"],
    "code_modes": ["moda_cdgtrn", "moda_cdgrpta"],
    "class_ratios": ["ratio_financiera", "ratio_exitosa", "ratio_no_exitosa"],
    "session_stats": ["total_atypical_sesion", "avg_normal_sesion"],
    "calendar_counts": ["total_office_trxn", "total_night_trxn", "total_weekday_trxn",
                        "total_weekend_trxn", "high_season_trxn", "low_season_trxn"],
    "group_flags": list(GENERATED),
    "month_entropy": ["month_entropy"],
    "hour_day_entropy": ["trxn_horadia_entropy"],
    "mean_gap": ["avg_trxn_interval"],
    "fault_entropy": ["culpabanco_entropy"],
    "week_entropy": ["trxn_week_entropy"],
    "week_thresholds": [f"umbral_trxn_{day}" for day in DAYS],
}
COLUMNS = [c for names in _NAMES.values() for c in names]
# Logarithms and deviations differ in the last digits between engines.
_INEXACT = {"month_entropy", "trxn_horadia_entropy", "culpabanco_entropy",
            "trxn_week_entropy", *_NAMES["week_thresholds"]}


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"{_r(c)} {c}" if c in _INEXACT else c for c in columns)

_LABELS = """select id, f_analisis, segmento, var_rpta,
  cast(left(cast(f_analisis as varchar), 4) as int) year_analisis from rpta"""

_MATRIX_CTE = (
    ",\n".join(f"{name}_f as ({sql})" for name, sql in FEATURES.items())
    + f",\nlabels_f as ({_LABELS}),\nmatrix as materialized (select coalesce(trxn_totals_f.id, labels_f.id) id, "
    + ", ".join(
        f"coalesce(cast({name}_f.{c} as double), 0) {c}" for name, cs in _NAMES.items() for c in cs
    )
    + ", labels_f.var_rpta\nfrom trxn_totals_f "
    + " ".join(
        f"left join {name}_f on {name}_f.id = trxn_totals_f.id" for name in FEATURES if name != "trxn_totals"
    )
    + "\nfull join labels_f on labels_f.id = trxn_totals_f.id)"
)


def _balanced(max_ones: int | None) -> str:
    ones = max_ones or "(select min(n) from (select count(*) n from matrix where var_rpta is not null group by var_rpta))"
    return f"""sample as materialized (select * exclude (place) from (
        select *, row_number() over (partition by var_rpta order by id) place
        from matrix where var_rpta is not null) where place <= {ones})"""


def _correlations(columns: list[str]) -> str:
    rows = " union all ".join(
        f"""select '{c}' feature,
          case when min({c}) < max({c}) then covar_pop({c}, var_rpta) / (stddev_pop({c}) * stddev_pop(var_rpta)) end corr,
          count(*) n from sample""" for c in columns
    )
    return f"corrs as materialized ({rows})"


_SCORES = """scores as (select feature, corr * corr / (1 - corr * corr) * (n - 2) f_score
  from corrs where corr is not null)"""
_TOP = "select feature from scores order by f_score desc, feature limit 10"
_MEAN = "mean as materialized (select avg(abs(corr)) strength from corrs)"
_ABOVE = "select feature from corrs cross join mean where abs(corr) > strength"


def _query(sql: str, *ctes: str, tables: str = _EVENT_TABLES) -> str:
    return "with " + ",\n".join([tables, _SHARED, *ctes]) + "\n" + sql


def _matrix_columns(label: bool) -> str:
    return _rounded(["id", *COLUMNS]) + (", cast(var_rpta as double) var_rpta" if label else "")


def _scaled() -> str:
    stats = ", ".join(f"avg({c}) m_{c}, case when min({c}) < max({c}) then stddev_pop({c}) else 0 end d_{c}" for c in COLUMNS)
    scaled = ", ".join(
        _r(f"case when d_{c} = 0 then 0 else ({c} - m_{c}) / d_{c} end") + f" {c}" for c in COLUMNS
    )
    return _query(f"select id, {scaled}, cast(var_rpta as double) var_rpta from matrix, stats", _MATRIX_CTE,
                  f"stats as (select {stats} from matrix)")


def _pairs() -> str:
    columns = ", ".join(COLUMNS)
    return _query(
        f"""select a.feature feature_a, b.feature feature_b,
          {_r('covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))')} corr
        from long a join long b on a.id = b.id group by all
        having min(a.x) < max(a.x) and min(b.x) < max(b.x)""",
        _MATRIX_CTE, _balanced(None),
        f"long as (unpivot (select id, {columns} from sample) on {columns} into name feature value x)",
    )


# Labels that follow the order lines, all ids of that matrix, and the part after the first 0.7.
_LEARNABLE = """
line_counts as (select o_custkey id, count(*) n from lineitem join orders on l_orderkey = o_orderkey group by o_custkey),
line_rpta as (
  select c_custkey id, case when (coalesce(n, 0) >= 40) <> (c_custkey % 10 = 3) then 1 else 0 end var_rpta
  from customer left join line_counts on line_counts.id = c_custkey where c_custkey % 10 <> 9),
everyone as (
  select id, cast(max(var_rpta) as double) as label from (
    select id, var_rpta from line_rpta union all select id, null from line_counts) group by id),
held_out as (
  select label, count(*) n from (
    select label, row_number() over (order by id) place, count(*) over () as total from everyone)
  where place > trunc(total::double * 0.7::double) and label is not null group by label)"""


def _learnable(sql: str) -> str:
    return f"with {_LEARNABLE}\n{sql}"


def _model_checks() -> dict[str, str]:
    """What must hold of every fitted model; the flags are computed from the models."""
    scores = _learnable("select id, label, true as inside, true as class_fits from everyone")
    first = "select true as sums_to_one, 'total_trxn' as first"
    return {
        "gbt_scores_check": scores,
        "mlp_scores_check": scores,
        "cap_sweep_check": _learnable("""
          select cap, cast(sum(case when label = 1 then least(n, cap) else 0 end) as bigint) expected_ones,
            cast(sum(least(n, cap)) as bigint) n, true as learned
          from held_out cross join (select cast(unnest([50, 250, 900, 1300, 1600]) as int) cap) group by cap"""),
        "validation_auc_check": _learnable(
            "select cast(2 * min(n) as bigint) n, true as exact, true as learned from held_out"),
        "gbt_importance_check": first,
        "gbt_split_counts_check": first,
        "forest_importance_check": "select true as sums_to_one, true as counts_lead, cast(20 as bigint) n",
        "permutation_importance_check": f"select cast({len(COLUMNS)} as bigint) n, true as signal, true as noise_is_small",
        "grid_search_check": """
          select max_depth, step_size, rounds, true as learned
          from (select unnest(['2', '3']) max_depth) cross join (select unnest(['0.05', '0.25']) step_size)
            cross join (select unnest(['20', '50']) rounds)""",
        "boosting_history_check": "select true as last_is_best, true as learned, true as from_the_first",
        "stored_scores_check": _learnable("select id, true as same from everyone"),
        "submission_check": _learnable("select id, true as inside from everyone"),
    }


def oracle_sql() -> dict[str, str]:
    plain = {
        name: _query(f"select {_rounded(['id', *_NAMES[name]])} from ({sql})")
        for name, sql in FEATURES.items()
    }
    sample = (_MATRIX_CTE, _balanced(500), _correlations(COLUMNS), _MEAN, _SCORES)
    matrix = f"select {_matrix_columns(True)} from matrix"
    return plain | _model_checks() | {
        "label_base": _query(_LABELS).replace("where c_custkey % 10 <> 9", ""),
        "session_representative": _query("select * from first_rows"),
        "time_gaps": _query(f"select * replace (cast(gap_micros as double) as gap_micros) from ({_GAPS})"),
        "mean_gap_fast": plain["mean_gap"],
        "group_shares": _query(_generated(True)),
        "dimension_values": _query("""
          select prefix, value, prefix || regexp_replace(
            replace(replace(replace(lower(value), '/', ''), '#', ''), '  ', ' '), '[-.\\s]', '_', 'g') column_name
          from (select distinct 'ratio_dg_' prefix, descripcion_grupo as value from maestro
                union select distinct 'ratio_pa_', producto_asociado from maestro)
          where value is not null""".replace("\\\\", "\\")).replace("where k % 11 <> 0", ""),
        "dimension_clean": _query("""
          select canal, disposit, cast(case when cdgtrn = 7 then -1 else cdgtrn + 1 end as int) cdgtrn,
            cast(-cdgrpta as int) cdgrpta, descripcion_grupo from maestro""").replace("where k % 11 <> 0", ""),
        "feature_matrix": _query(matrix, _MATRIX_CTE),
        "feature_matrix_fused": _query(matrix, _MATRIX_CTE),
        "feature_matrix_predict": _query(f"select {_matrix_columns(False)} from matrix", _MATRIX_CTE),
        "feature_matrix_orders": _query(matrix, _MATRIX_CTE, tables=_ORDER_TABLES),
        "scaled_matrix": _scaled(),
        "label_correlation": _query(
            f"select feature, {_r('abs(corr)')} abs_corr from corrs",
            _MATRIX_CTE, _balanced(None), _correlations([*COLUMNS, "var_rpta"])),
        "correlation_matrix": _pairs(),
        "group_entries": _query(f"""select id, feature, {_r('value')} as value from (
          unpivot ({_generated(True)}) on columns(* exclude (id)) into name feature value value) where value <> 0"""),
        "entry_correlations": _query(
            f"""select feature, {_r('abs(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)))')} abs_corr from (
              select id, feature, cast(var_rpta as double) y, coalesce(share, 0.0) x
              from sample cross join (select unnest([{', '.join(f"'{c}'" for c in GENERATED)}]) feature)
                left join shares using (id, feature))
            group by feature having min(x) < max(x)""",
            _MATRIX_CTE, _balanced(None),
            f"shares as (unpivot ({_generated(True)}) on columns(* exclude (id)) into name feature value share)"),
        "f_scores": _query(f"select feature, {_r('f_score')} f_score from scores", *sample),
        "top_f_scores": _query(
            f"select feature, {_r('f_score')} f_score from scores order by scores.f_score desc, feature limit 10",
            *sample),
        "corr_above_mean": _query(
            f"select feature, {_r('abs(corr)')} abs_corr from corrs cross join mean where abs(corr) > strength",
            *sample),
        "selected_features": _query(f"select feature from ({_TOP}) union {_ABOVE}", *sample),
        "dataset_choice": _query("""
          select features, n as transactions, ids, labels, cast(segments as double) segments,
            case when training then cast(ones as double) end as ones
          from (values ('features_train', 1, true), ('features_train_lite', 5, true), ('features_predict', 1, false))
              as choices(features, step, training)
            cross join lateral (select count(*) n, count(distinct id) ids from trxn where id % step = 0)
            cross join lateral (select count(*) labels, sum(segmento) segments, sum(var_rpta) ones from rpta where id % step = 0)"""),
        "class_balance": _query("select id, var_rpta from sample", _MATRIX_CTE, _balanced(None)),
        "class_balance_capped": _query("select id, var_rpta from sample", _MATRIX_CTE, _balanced(200)),
        "positional_split": _query("""select id, case when row_number() over (order by id)
          <= trunc((select count(*) from matrix)::double * 0.7::double) then 'train' else 'test' end part
          from matrix""", _MATRIX_CTE),
        "csv_roundtrip": _query("""select * replace (cast(id as int) as id,
          case when id % 7 = 0 then '' when id % 7 <> 1 then canal || ' "q" \\\\, ' || chr(10) || disposit end as canal)
          from trxn""".replace("\\\\", "\\")),
    }
