"""Each round of a boosted model is looked at once, in rows without random numbers."""

from ledgerlens.operators import ranking
from ledgerlens.plans import training
from ledgerlens.session import Scratch


def test_no_round_is_looked_at_twice(spark, monkeypatch):
    looked_at = []

    class Fitted:
        def __init__(self, rounds):
            self.rounds = rounds

        def classifier(self, n):
            return self

        def fit(self, rows):
            return self

    def areas(model, rows, rounds=None):
        looked_at.extend(rounds)
        return [0.5 + 0.001 * min(r, 200) for r in rounds]

    monkeypatch.setattr(training, "areas_by_round", areas)
    monkeypatch.setattr(training, "replace", lambda params, rounds: Fitted(rounds))
    rows = spark.createDataFrame([(i, float(i), i % 2) for i in range(8)], "id bigint, x double, var_rpta int")
    model = training.train_boosted(rows, rows, ["x"])
    assert model.rounds == 200
    assert looked_at == list(range(1, 321))


def test_running_sums_of_distinct_rows_carry_no_tie(spark, monkeypatch):
    written = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: written.append(df.columns) or keep(self, df, name))
    rows = spark.createDataFrame([(g, float(i % 50), i % 3) for g in "ab" for i in range(50)], "g string, s double, w bigint")
    with Scratch(spark) as scratch:
        got = ranking.running_sums(scratch, rows, ["g"], ["s"], ["w"], distinct=True).collect()
    assert written == [["g", "s", "w", "part"]]
    assert all(r.before_w == sum(i % 3 for i in range(int(r.s))) and r.all_w == sum(i % 3 for i in range(50)) for r in got)


def test_a_validation_set_without_rows_keeps_one_round(spark, monkeypatch):
    monkeypatch.setattr(training, "FIRST_ROUNDS", 2)
    rows = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "id bigint, x double, var_rpta int")
    model = training.train_boosted(rows, rows.where("id < 0"), ["x"], training.BoostParams(rounds=3, patience=1))
    assert model.getNumTrees == 1
