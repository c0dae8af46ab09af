"""Order statistics, balance, split, folds and scaling against plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from ledgerlens.operators import ranking, sampling
from ledgerlens.operators.scaling import Scaler
from ledgerlens.operators.selection import label_correlations


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, var_rpta int")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    keys=st.lists(st.integers(-2**40, 2**40), min_size=1, max_size=40),
    k=st.integers(0, 42),
)
def test_kth_smallest(spark, keys, k):
    df = spark.createDataFrame([(i,) for i in keys], "id bigint")
    want = sorted(keys)[k - 1] if 1 <= k <= len(keys) else None
    assert ranking.kth_smallest(df, "id", k) == want


def test_kth_smallest_in_a_dense_and_a_sparse_range(spark):
    df = spark.range(0, 200_000).selectExpr("if(id < 150000, id, id * 1000000) id")
    for k in (1, 70_000, 150_000, 150_001, 200_000):
        want = k - 1 if k <= 150_000 else (k - 1) * 1_000_000
        assert ranking.kth_smallest(df, "id", k) == want


def test_ranks_of_several_groups_together(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(100), rng.randrange(10**12), -rng.randrange(10**6)]))
            for _ in range(3000)]
    groups = {g: sorted(k for h, k in rows if h == g) for g in (1, 2, None)}
    ranks = ranking.KeyRanks(spark.createDataFrame(rows, "g int, id bigint"), "id", ["g"])
    assert ranks.counts == {(g,): len(keys) for g, keys in groups.items()}
    wanted = [((g,), k) for g in groups for k in (0, 1, 2, 17, 400, len(groups[g]), len(groups[g]) + 1)] + [((9,), 1)]
    want = {((g,), k): groups[g][k - 1] if 1 <= k <= len(groups.get(g, ())) else None for (g,), k in wanted}
    assert ranks.at(wanted) == want


def test_few_jobs_before_a_fit(spark):
    """Splitting and balancing both parts take four jobs while a first count is exact."""
    df = spark.range(4000).selectExpr("id", "int(id % 3 = 0) var_rpta").cache()
    df.count()
    context = spark.sparkContext
    context.setJobGroup("balance", "balance")
    train, test = sampling.positional_split(df)
    flagged = train.selectExpr("*", "false held_out").union(test.selectExpr("*", "true held_out"))
    balanced = sampling.balance_classes(flagged, by=["held_out"])
    jobs = len(context.statusTracker().getJobIdsForGroup("balance"))
    context.setLocalProperty("spark.jobGroup.id", None)
    counts = {(r.held_out, r.var_rpta): r["count"] for r in balanced.groupBy("held_out", "var_rpta").count().collect()}
    ones = [len([i for i in part if i % 3 == 0]) for part in (range(2800), range(2800, 4000))]
    assert counts == {(held, c): ones[held] for held in (0, 1) for c in (0, 1)}
    assert jobs <= 4 * 2  # adaptive execution runs a shuffle and what follows as two


def test_positions_are_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 50)
    df = spark.range(1000)
    first = ranking.shuffled_positions(df, "id", 1, 1000)
    places = {r.id: r.position for r in first.collect()}
    assert sorted(places.values()) == list(range(1000))
    again = ranking.shuffled_positions(df.repartition(3), "id", 1, 1000)
    assert {r.id: r.position for r in again.collect()} == places
    other = {r.id: r.position for r in ranking.shuffled_positions(df, "id", 2, 1000).collect()}
    assert other != places


def labelled(spark, n=60, seed=3):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), n)
    rows = [(i, rng.choice([0, 0, 1, None])) for i in ids]
    return rows, frame(spark, rows)


@pytest.mark.parametrize("max_ones, factor", [(None, 1.0), (None, 0.5), (3, 1.0), (4, 2.0), (1000, 1.0)])
def test_balance(spark, max_ones, factor):
    rows, df = labelled(spark)
    by_class = {c: sorted(i for i, v in rows if v == c) for c in (0, 1)}
    n = max_ones or int(min(len(by_class[0]), len(by_class[1])) * factor)
    want = by_class[0][: int(n * factor)] + by_class[1][:n]
    got = [r.id for r in sampling.balance_classes(df, max_ones, factor).collect()]
    assert sorted(got) == sorted(want)


def test_balance_with_fewer_rows_than_asked(spark):
    df = frame(spark, [(i, 1) for i in range(2)] + [(i, 0) for i in range(10, 19)])
    got = sampling.class_counts(sampling.balance_classes(df, max_ones=5))
    assert got == {0: 5, 1: 2}


@pytest.mark.parametrize("n", [1, 2, 10, 60])
def test_positional_split(spark, n):
    rows, df = labelled(spark, n)
    train, test = sampling.positional_split(df)
    order = sorted(i for i, _ in rows)
    assert sorted(r.id for r in train.collect()) == order[: int(n * 0.7)]
    assert sorted(r.id for r in test.collect()) == order[int(n * 0.7):]


def test_folds_are_stratified(spark):
    df = frame(spark, [(i, i % 2) for i in range(60)])
    counts = sampling.stratified_folds(df, 3).groupBy("fold", "var_rpta").count().collect()
    assert sorted((r.fold, r.var_rpta, r["count"]) for r in counts) == [
        (f, c, 10) for f in range(3) for c in (0, 1)
    ]


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 6.0, 5.0)], "id int, a double, b double")
    scaler = Scaler.fit(df, ["a", "b"])
    rows = scaler.transform(df).orderBy("id").collect()
    assert [r.b for r in rows] == [0.0] * 3
    assert sum(r.a for r in rows) == pytest.approx(0)
    assert sum(r.a**2 for r in rows) / 3 == pytest.approx(1)
    other = spark.createDataFrame([(4, 3.0, 9.0)], df.schema)
    assert scaler.transform(other).first().a == pytest.approx(0)


@pytest.mark.parametrize("value", [0.1, 2019.0, 0.105409255])
def test_a_constant_over_uneven_partitions(spark, value):
    parts = [spark.range(n * 100, n * 100 + n).coalesce(1) for n in (1, 3, 7, 11, 49, 97)]
    df = parts[0]
    for part in parts[1:]:
        df = df.union(part)
    df = df.selectExpr("id", f"double({value}) a", "double(id) b", "int(id % 2) var_rpta")
    scaler = Scaler.fit(df, ["a", "b"])
    assert scaler.deviations["a"] == 0
    assert scaler.transform(df).where("a <> 0").count() == 0
    corr = {r.feature: r.corr for r in label_correlations(df, ["a", "b"]).collect()}
    assert corr["a"] is None and corr["b"] is not None
