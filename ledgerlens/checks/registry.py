"""The named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators import activity, codes, sampling, selection, sessions, sparse
from ledgerlens.operators.codes import code_table
from ledgerlens.operators.labels import label_base
from ledgerlens.operators.scaling import Scaler
from ledgerlens.plans import matrix as plans, random_trees, staged, study, training
from ledgerlens.plans.bundle import Bundle
from ledgerlens.session import Scratch, scratch_path
from ledgerlens.sources import schemas, tables
from ledgerlens.sources.mapping import (
    inputs_from_events, inputs_from_orders, labels_from_customers, whole_event_dimension,
)
from ledgerlens.sources.tables import DatasetSpec, Inputs

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
# Small enough that the file of any given table is read in several splits.
SPLIT_BYTES = 64 << 10
CHOICES = (DatasetSpec(), DatasetSpec(lite=True), DatasetSpec(training=False))


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Round what floating-point summation order or logarithms may change."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


def _inputs(spark: SparkSession, folder: str, training_set: bool = True) -> Inputs:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return inputs_from_events(spark, folder, training_set)


def _order_inputs(spark: SparkSession, folder: str) -> Inputs:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return inputs_from_orders(spark, folder)


def _from_trxn(operator: Callable[[DataFrame], DataFrame], *inexact: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(operator(_inputs(spark, folder).transactions), list(inexact))

    return query


def _from_codes(operator: Callable[..., DataFrame], *inexact: str, **options) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        inputs = _inputs(spark, folder)
        table = code_table(inputs.dimension)
        return rounded(operator(inputs.transactions, table, **options), list(inexact))

    return query


INEXACT = ["month_entropy", "trxn_horadia_entropy", "culpabanco_entropy",
           "trxn_week_entropy", *sessions.THRESHOLDS]


def _label_base(spark, folder):
    return label_base(labels_from_customers(spark, folder, whole=True))


def _dimension_values(spark, folder):
    return codes.dimension_values(whole_event_dimension(spark, folder))


def _dimension_clean(spark, folder):
    """The dimension with its codes turned to text and cleaned again, per transaction code."""
    raw = whole_event_dimension(spark, folder).withColumns({
        "cdgtrn": F.when(F.col("cdgtrn") == 7, F.lit("None"))
        .otherwise(F.format_string("%d.5", F.col("cdgtrn"))),
        "cdgrpta": F.format_string("-%d.25", F.col("cdgrpta")),
    })
    return codes.clean_codes(raw).select(*codes.KEYS, "descripcion_grupo")


def _comparable(matrix: DataFrame) -> DataFrame:
    """Rounded, and the label as double: whole numbers with NULLs differ between clients."""
    label = ["var_rpta"] if "var_rpta" in matrix.columns else []
    return rounded(matrix, INEXACT).withColumns({c: F.col(c).cast("double") for c in label})


def _matrix(spark, folder):
    return _comparable(plans.assemble(_inputs(spark, folder)))


def _matrix_fused(spark, folder):
    return _comparable(plans.fused_matrix(_inputs(spark, folder)))


def _matrix_predict(spark, folder):
    return _comparable(plans.fused_matrix(_inputs(spark, folder, False)))


def _matrix_orders(spark, folder):
    return _comparable(plans.fused_matrix(_order_inputs(spark, folder), grouped=True))


def _time_gaps(spark, folder):
    gaps = activity.time_gaps(_inputs(spark, folder).transactions)
    return gaps.withColumn("gap_micros", F.col("gap_micros").cast("double"))


_cache_folders: dict[str, str] = {}
_models: dict[str, tuple] = {}


def _run(spark: SparkSession, *parts: str) -> str:
    return ":".join([spark.sparkContext.applicationId, *parts])


def _cached(spark: SparkSession, folder: str, training_set: bool = True, learnable: bool = False) -> DataFrame:
    """The scaled matrix through the feature cache, one cache per application and input."""
    run = _run(spark, folder, str(learnable))
    if run not in _cache_folders:
        _cache_folders[run] = scratch_path(spark, "features")

    def build() -> DataFrame:
        if learnable:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plans.build_features(inputs_from_orders(spark, folder, training_set, True))[0]
        return plans.build_features(_inputs(spark, folder, training_set))[0]

    return tables.cached_features(spark, _cache_folders[run], DatasetSpec(training=training_set), build)


def _features(matrix: DataFrame) -> list[str]:
    return tables.split_columns(matrix)[0]


def _scaled(spark, folder):
    matrix, _ = plans.build_features(_inputs(spark, folder))
    return rounded(matrix, _features(matrix)).withColumn("var_rpta", F.col("var_rpta").cast("double"))


def _sample(spark, folder, max_ones: int | None = None) -> tuple[DataFrame, list[str]]:
    matrix = _cached(spark, folder)
    return sampling.balance_classes(matrix, max_ones), _features(matrix)


def _label_correlation(spark, folder):
    return rounded(selection.correlation_report(*_sample(spark, folder)), ["abs_corr"])


def _correlation_matrix(spark, folder):
    return rounded(selection.correlation_matrix(*_sample(spark, folder)), ["corr"])


def _sparse_entries(spark, folder, fraction=False):
    inputs = _inputs(spark, folder)
    return sparse.group_entries(inputs.transactions, inputs.dimension, fraction)


def _group_entries(spark, folder):
    return rounded(_sparse_entries(spark, folder, fraction=True), ["value"])


def _entry_correlations(spark, folder):
    """The generated columns against the label, without making columns of them."""
    sample, _ = _sample(spark, folder)
    entries = _sparse_entries(spark, folder, fraction=True)
    scored = sparse.entry_correlations(entries, sample.select("id", "var_rpta")).where("corr is not null")
    return rounded(scored.select("feature", F.abs("corr").alias("abs_corr")), ["abs_corr"])


def _on_selection_sample(operator, *inexact) -> Query:
    def query(spark, folder):
        sample = _sample(spark, folder, selection.SELECTION_ONES)
        return rounded(operator(*sample), list(inexact))

    return query


def _class_balance(spark, folder):
    return _sample(spark, folder)[0].select("id", "var_rpta")


def _class_balance_capped(spark, folder):
    return _sample(spark, folder, study.STUDY_ONES)[0].select("id", "var_rpta")


def _positional_split(spark, folder):
    train, test = sampling.positional_split(_cached(spark, folder))
    parts = [df.select("id", F.lit(name).alias("part")) for df, name in ((train, "train"), (test, "test"))]
    return parts[0].unionByName(parts[1])


def _csv_roundtrip(spark, folder):
    """Transactions written as one CSV file with a header and read back in splits with their schema.

    Channels get quotes, backslashes, commas and line breaks, or are the empty text or NULL,
    which must come back.
    """
    path = scratch_path(spark, "transactions")
    odd = F.concat("canal", F.lit(' "q" \\, '), F.lit("\n"), "disposit")
    trxn = _inputs(spark, folder).transactions.withColumn(
        "canal", F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 != 1, odd))
    columns = schemas.TRANSACTIONS.fieldNames()
    tables.write_csv(trxn.select(*columns).coalesce(1), path)
    splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    try:
        stored = tables.read_csv(spark, path, schemas.TRANSACTIONS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    return stored.withColumn("vlrtran", F.col("vlrtran").cast("double"))


def _once(spark, folder, name, fit):
    """A fitted model, kept for the queries of this application that share it."""
    run = _run(spark, folder, name)
    if run not in _models:
        _models[run] = fit()
    return _models[run]


def _trained(spark, folder):
    """Boosted model with the library's parameters, the whole matrix, test part and columns."""
    matrix = _cached(spark, folder, learnable=True)
    model, chosen = _once(spark, folder, "boosted", lambda: _boosted_fit(spark, folder))
    return model, matrix, sampling.positional_split(matrix)[1], chosen


def _gbt_scores(spark, folder):
    model, matrix, _, chosen = _trained(spark, folder)
    return training.score(model, matrix, chosen)


def _cap_sweep(spark, folder):
    model, _, test, chosen = _trained(spark, folder)
    return training.cap_sweep(model, test, chosen)


def _held_out_scores(spark, folder):
    model, _, test, chosen = _trained(spark, folder)
    return training.score(model, sampling.balance_classes(test), chosen)


def _validation_auc(spark, folder):
    scores = _held_out_scores(spark, folder)
    auc = training.area_under_roc(scores)
    return scores.agg(F.count("*").alias("n")).withColumn("auc", F.lit(auc))


def _study_sample(spark, folder):
    matrix = _cached(spark, folder, learnable=True)
    return sampling.balance_classes(matrix, study.STUDY_ONES), _features(matrix)


def _plain_booster(spark, folder):
    """The study's own model: a booster with plain parameters on all features."""
    sample, features = _study_sample(spark, folder)

    def fit():
        return training.PLAIN_BOOST.classifier(sample.count()).fit(training.to_vectors(sample, features))

    return _once(spark, folder, "plain", fit), sample, features


def _gbt_importance(spark, folder):
    return study.boosted_importance(*_plain_booster(spark, folder))


def _gbt_split_counts(spark, folder):
    model, _, features = _plain_booster(spark, folder)
    return staged.split_counts(model, features)


def _boosted_fit(spark, folder):
    """A model fitted with the library's parameters and the columns it uses."""
    matrix = _cached(spark, folder, learnable=True)
    chosen = selection.select_features(matrix, _features(matrix))
    train, test = sampling.positional_split(matrix)
    return training.train_boosted(train, test, chosen), chosen


def _history_of(spark, folder, model, chosen):
    test = sampling.positional_split(_cached(spark, folder, learnable=True))[1]
    areas = staged.areas_by_round(model, training.to_vectors(sampling.balance_classes(test), chosen))
    return spark.createDataFrame(list(enumerate(areas, 1)), "round int, auc double")


def _boosting_history(spark, folder):
    """A model fitted anew: the area of the validation set after each of its rounds."""
    return _history_of(spark, folder, *_boosted_fit(spark, folder))


def _labelled(spark, folder):
    """Every labelled row of the matrix."""
    matrix = _cached(spark, folder, learnable=True)
    return sampling.labelled(matrix), _features(matrix)


def _forest_importance(spark, folder):
    rows, features = _labelled(spark, folder)
    grown = _once(spark, folder, "forest", lambda: random_trees.random_tree_importance(rows, features))
    return study.top_importances(grown)


def _network(spark, folder):
    sample, features = _study_sample(spark, folder)
    return _once(spark, folder, "network", lambda: training.train_network(sample, features)), sample, features


def _mlp_scores(spark, folder):
    model, _, features = _network(spark, folder)
    return training.score(model, _cached(spark, folder, learnable=True), features)


def _permutation_importance(spark, folder):
    rows, features = _labelled(spark, folder)
    model = _once(spark, folder, "whole network", lambda: training.train_network(rows, features))
    return study.permutation_importance(model, rows, features)


def _grid_search(spark, folder):
    matrix = _cached(spark, folder, learnable=True)
    # A fit of the whole axis, 1000 rounds, takes 160 s here and there are twelve; see README.
    grid = {"max_depth": [2, 3], "step_size": [0.05, 0.25], "rounds": [20, 50]}
    return training.grid_search(matrix, _features(matrix), grid)


def _submission(spark, folder):
    """Scores of the unlabelled set, written as CSV and read back."""
    model, _, _, chosen = _trained(spark, folder)
    path = scratch_path(spark, "submission")
    unlabelled = _cached(spark, folder, False, learnable=True)
    tables.write_scores(training.score(model, unlabelled, chosen), path)
    return spark.read.schema("id bigint, probabilidad double").option("header", True).csv(path)


def _stored_scores(spark, folder):
    """Scores of the unlabelled set by the trained model after it was stored and loaded."""
    model, matrix, _, chosen = _trained(spark, folder)
    path = scratch_path(spark, "bundle")
    Bundle(model, chosen, Scaler({c: 0.0 for c in chosen}, {c: 1.0 for c in chosen})).save(spark, path)
    return Bundle.load(spark, path).score(_cached(spark, folder, False, learnable=True))


def _stored_scores_check(spark, folder):
    direct = _submission(spark, folder).withColumnRenamed("probabilidad", "direct")
    same = (F.abs(F.col("probabilidad") - F.col("direct")) < 1e-12).alias("same")
    return _stored_scores(spark, folder).join(direct, "id").select("id", same)


def _dataset_choice(spark, folder):
    """What each choice of tables reads from a store that holds them all."""
    store = scratch_path(spark, "store")
    for spec in CHOICES:
        inputs = _inputs(spark, folder, spec.training)
        few = F.col("id") % (5 if spec.lite else 1) == 0
        inputs.transactions.where(few).write.parquet(f"{store}/{spec.transactions}")
        inputs.labels.where(few).write.parquet(f"{store}/{spec.labels}")
    _inputs(spark, folder).dimension.write.parquet(f"{store}/{tables.DIMENSION}")

    def counted(spec):
        inputs = tables.load_inputs(spark, store, spec)
        label = F.sum("var_rpta").cast("long") if "var_rpta" in inputs.labels.columns else F.lit(None).cast("long")
        labels = inputs.labels.agg(F.count("*").alias("labels"), F.sum("segmento").cast("long").alias("segments"),
                                   label.alias("ones"))
        rows = inputs.transactions.agg(F.count("*").alias("transactions"), F.count_distinct("id").alias("ids"))
        # One row on each side.
        named = rows.withColumn("features", F.lit(spec.features)).join(F.broadcast(labels))
        return named.withColumns({"ones": F.col("ones").cast("double"), "segments": F.col("segments").cast("double")})

    first, *rest = [counted(spec) for spec in CHOICES]
    for table in rest:
        first = first.unionByName(table)
    return first


def _inside(column="probabilidad"):
    return F.col(column).between(0, 1).alias("inside")


def _score_check(query):
    """Ids, labels and what must hold for each score of a query."""
    def check(spark, folder):
        half_even = F.bround("probabilidad").cast("int") == F.col("clase")
        return query(spark, folder).select("id", "label", _inside(), half_even.alias("class_fits"))

    return check


def _cap_sweep_check(spark, folder):
    swept = _cap_sweep(spark, folder)
    return swept.select("cap", "expected_ones", "n", (F.col("error") < 0.3).alias("learned"))


def _zeros_below(scores, scratch=None):
    """Ones and zeros of each score and those below it; without a ``scratch`` its ranges stay in the shared folder."""
    grouped = scores.where("label is not null").select(F.lit(0).alias("all"), "label", "probabilidad")
    return staged.ranked_scores(scratch or Scratch(scores.sparkSession).__enter__(), grouped, ["all"], "probabilidad")


def _ranked_area(scores):
    """The share of rightly ordered pairs, ties half."""
    with Scratch(scores.sparkSession) as scratch:
        return staged.ranked_areas(_zeros_below(scores, scratch), ["all"]).first().auc


def _auc_check(spark, folder):
    """The area against the share of rightly ordered pairs, from ranks with ties in the middle."""
    scores = _held_out_scores(spark, folder)
    auc = training.area_under_roc(scores)
    ranked = _ranked_area(scores)
    return scores.agg(F.count("*").alias("n")).select(
        "n", F.lit(abs(auc - ranked) < 1e-9).alias("exact"), F.lit(auc > 0.8).alias("learned"))


def _importance_check(query):
    def check(spark, folder):
        found = query(spark, folder)
        total = F.sum("importance")
        return found.agg((F.abs(total - 1) < 1e-6).alias("sums_to_one"), F.max_by("feature", "importance").alias("first"))

    return check


def _forest_check(spark, folder):
    """Random thresholds share the signal among the columns that count transactions; one of them leads."""
    found = _forest_importance(spark, folder)
    leader = F.max_by("feature", "importance")
    return found.agg((F.sum("importance") <= 1 + 1e-6).alias("sums_to_one"),
                     leader.rlike("^total_.*trxn$").alias("counts_lead"), F.count("*").alias("n"))


def _history_check(spark, folder):
    """Training keeps the rounds up to the highest area, the first of that height."""
    model, _, _, chosen = _trained(spark, folder)
    history = _history_of(spark, folder, model, chosen)
    best = F.struct(F.col("auc"), (-F.col("round")).alias("early"))
    return history.agg(
        (-F.max(best)["early"] == F.max("round")).alias("last_is_best"), (F.max("auc") > 0.8).alias("learned"),
        (F.min("round") == 1).alias("from_the_first"))


def _permutation_check(spark, folder):
    found = _permutation_importance(spark, folder)
    noise = F.max(F.when(F.col("feature") == "segmento", F.abs("importance")))
    return found.agg(F.count("*").alias("n"), (F.max("importance") > 0.02).alias("signal"),
                     (noise < 0.1).alias("noise_is_small"))


def _grid_check(spark, folder):
    found = _grid_search(spark, folder)
    return found.select(F.col("params")["max_depth"].alias("max_depth"), F.col("params")["step_size"].alias("step_size"),
                        F.col("params")["rounds"].alias("rounds"),
                        F.col("log_loss").between(0.01, 0.7).alias("learned"))


def _submission_check(spark, folder):
    return _submission(spark, folder).select("id", _inside())


QUERIES: dict[str, Query] = {
    "trxn_totals": _from_trxn(activity.trxn_totals),
    "label_base": _label_base,
    "session_representative": _from_trxn(sessions.session_representative),
    "device_top_use": _from_trxn(sessions.device_top_use),
    "channel_top_use": _from_trxn(sessions.channel_top_use),
    "session_stats": _from_trxn(sessions.session_stats),
    "code_modes": _from_trxn(activity.code_modes),
    "class_ratios": _from_codes(codes.class_ratios),
    "calendar_counts": _from_trxn(activity.calendar_counts),
    "month_entropy": _from_trxn(activity.month_entropy, "month_entropy"),
    "hour_day_entropy": _from_trxn(activity.hour_day_entropy, "trxn_horadia_entropy"),
    "fault_entropy": _from_codes(codes.fault_entropy, "culpabanco_entropy"),
    "time_gaps": _time_gaps,
    "mean_gap": _from_trxn(activity.mean_gap),
    "mean_gap_fast": _from_trxn(activity.mean_gap_fast),
    "group_flags": _from_codes(codes.group_flags),
    "group_shares": _from_codes(codes.group_flags, fraction=True),
    "week_entropy": _from_trxn(sessions.week_entropy, "trxn_week_entropy"),
    "week_thresholds": _from_trxn(sessions.week_thresholds, *sessions.THRESHOLDS),
    "dimension_values": _dimension_values,
    "dimension_clean": _dimension_clean,
    "feature_matrix": _matrix,
    "feature_matrix_predict": _matrix_predict,
    "feature_matrix_fused": _matrix_fused,
    "feature_matrix_orders": _matrix_orders,
    "scaled_matrix": _scaled,
    "label_correlation": _label_correlation,
    "correlation_matrix": _correlation_matrix,
    "group_entries": _group_entries,
    "entry_correlations": _entry_correlations,
    "f_scores": _on_selection_sample(selection.f_scores, "f_score"),
    "top_f_scores": _on_selection_sample(selection.top_f_scores, "f_score"),
    "corr_above_mean": _on_selection_sample(selection.corr_above_mean, "abs_corr"),
    "selected_features": _on_selection_sample(selection.selected_features),
    "class_balance": _class_balance,
    "class_balance_capped": _class_balance_capped,
    "positional_split": _positional_split,
    "csv_roundtrip": _csv_roundtrip,
    "gbt_scores": _gbt_scores,
    "cap_sweep": _cap_sweep,
    "validation_auc": _validation_auc,
    "gbt_importance": _gbt_importance,
    "forest_importance": _forest_importance,
    "mlp_scores": _mlp_scores,
    "permutation_importance": _permutation_importance,
    "grid_search": _grid_search,
    "submission": _submission,
    "gbt_scores_check": _score_check(_gbt_scores),
    "mlp_scores_check": _score_check(_mlp_scores),
    "boosting_history": _boosting_history,
    "gbt_split_counts": _gbt_split_counts,
    "stored_scores": _stored_scores,
    "dataset_choice": _dataset_choice,
    "boosting_history_check": _history_check,
    "gbt_split_counts_check": _importance_check(_gbt_split_counts),
    "stored_scores_check": _stored_scores_check,
    "cap_sweep_check": _cap_sweep_check,
    "validation_auc_check": _auc_check,
    "gbt_importance_check": _importance_check(_gbt_importance),
    "forest_importance_check": _forest_check,
    "permutation_importance_check": _permutation_check,
    "grid_search_check": _grid_check,
    "submission_check": _submission_check,
}
