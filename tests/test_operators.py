"""Operators on literal tables and by their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import metrics as M
from tidemark.operators import checks, drift, gates, grids, inference, models, policy, resampling, selectors, splits, summaries
from tidemark.sources import paged
from tidemark.sources.bars import standardize


def series(spark, values, name="x"):
    rows = [("PRI", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, t string, {name} double").select("symbol", F.col("t").cast("timestamp").alias("ts"), name)


def test_persistence_decays_and_restarts(spark):
    got = I.event_persistence(series(spark, [0.0, 1, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0], "event"), "event", 4).orderBy("ts").collect()
    p = [r["persistence"] for r in got]
    assert p[0] == 0 and p[1] == 1.0 and p[2] == 0.75 and p[7] == 0 and p[8] == -1.0


def test_rsi_is_null_without_losses(spark):
    up = series(spark, [float(100 + i) for i in range(40)], "pri_close")
    assert I.relative_strength(up).where("rsi is not null").count() == 0


def test_prefix_invariance(spark):
    rng = np.random.default_rng(1)
    panel = series(spark, list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90)))), "pri_close")
    got = checks.prefix_invariance(lambda p: I.relative_strength(p, 7), panel, "2024-01-01 01:00:00", ["rsi"]).first()
    assert got["max_error"] < 1e-12 and got["null_mismatches"] == 0


def test_standardize_drops_a_bar_whose_last_row_is_bad(spark):
    rows = [(1, "2024-01-01", "1", "2", "0.5", "1", "3"), (2, "2024-01-01", "1", "2", "0.5", "oops", "3"), (3, "2024-01-02", "1", "2", "0.5", "1.5", "3"), (4, "bad", "1", "2", "0.5", "1", "3")]
    df = spark.createDataFrame(rows, "seq int, ` Date ` string, OPEN string, high string, Low string, close string, volume string")
    got = standardize(df, F.col("seq")).collect()
    assert len(got) == 1 and got[0]["close"] == 1.5
    with pytest.raises(ValueError):
        standardize(df.drop("volume"))


def test_empty_bars_stay_empty(spark):
    empty = series(spark, [], "pri_close")
    assert I.target(I.relative_strength(empty)).count() == 0
    assert splits.thirds(empty).count() == 0


def test_folds_have_the_recorded_sizes():
    folds = splits.expanding_folds(12141, 5, 1)
    assert [f["train_end"] + 1 for f in folds] == [2025, 4048, 6071, 8094, 10117]
    assert {f["test_end"] - f["test_start"] + 1 for f in folds} == {2023}
    assert all(f["test_start"] - f["train_end"] - 1 == 1 for f in folds)
    with pytest.raises(ValueError):
        splits.expanding_folds(10, 5, 3)


def test_grids_have_the_registered_sizes(spark):
    c = grids.candidates(spark)
    assert c.count() == 6048 and c.where("family = 'rsi'").count() == 3456
    assert c.agg(F.max("candidate_id")).first()[0] == "v2-candidate-06048"
    assert grids.signal_specs(spark).count() == 84 and grids.structures(spark).count() == 90
    assert splits.nested_plan(spark, 9852).count() == 80


def test_policy_on_three_rows(spark):
    rows = [("2024-01-01", 0.60, 0.54, 0.01), ("2024-01-02", 0.40, 0.46, -0.01), ("2024-01-03", 0.51, 0.50, 0.02)]
    df = spark.createDataFrame(rows, "t string, candidate_probability double, benchmark_probability double, future_return double").withColumns({"ts": F.col("t").cast("timestamp"), "g": F.lit(1)})
    got = policy.matched_returns(df, ["g"], 0.05).orderBy("ts").collect()
    assert sum(r["candidate_active"] for r in got) == 2 and sum(r["benchmark_active"] for r in got) == 0
    assert [r["candidate_turnover"] for r in got] == [1.0, 2.0, 1.0]
    assert abs(got[1]["candidate_net_return"] - (0.01 - 0.002)) < 1e-12


def test_holm_and_bh(spark):
    t = spark.createDataFrame([("a", 0.04), ("b", 0.02), ("c", None)], "name string, p_value double").na.drop()
    got = {r["name"]: r["p_holm"] for r in inference.holm(t).collect()}
    assert got == {"a": 0.04, "b": 0.04}
    assert {r["name"]: r["p_bh"] for r in inference.benjamini_hochberg(t).collect()} == {"a": 0.04, "b": 0.04}


def test_bootstrap_and_random_events_are_deterministic(spark):
    df = series(spark, list(np.random.default_rng(3).normal(0.01, 0.02, 120)), "r").withColumn("pos", F.when(F.minute("ts") % 5 == 0, 1.0).otherwise(0.0))
    a, b = (resampling.bootstrap_mean(df, ["symbol"], "r", 200, 10).first() for _ in range(2))
    assert a == b and a["lower"] < a["mean"] < a["upper"]
    p = resampling.random_event_pvalue(df, ["symbol"], "pos", "r", 0.0, 100).first()
    assert p["events"] == 24 and 0 < p["p_value"] <= 1
    assert inference.normal_survival(0.0) == 0.5


def test_cusum_closed_form_equals_recursion(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0.02, 0.01, 200), rng.normal(-0.08, 0.02, 200)])
    df = series(spark, list(x), "incremental_log_loss").withColumn("incremental_net_edge", F.col("incremental_log_loss") / 20)
    got = drift.cusum(df, ["symbol"], 60).orderBy("ts").collect()
    s = 0.0
    for r in got:
        s = 0.0 if r["calibrating"] else min(0.0, s + r["quality"] + 0.10)
        assert abs(s - r["cusum"]) < 1e-9
    assert got[-1]["structural_change_alarm"]


def test_selectors_pick_the_expected_rows(spark):
    rows = [("stable", i, g, 0.24, 0.25, 0.02, 0.02, 2) for i, g in enumerate([0.01, 0.011, 0.009])] + [("wild", i, g, 0.30, 0.25, 0.02, 0.02, 1) for i, g in enumerate([0.2, 0.1, 0.3])]
    df = spark.createDataFrame(rows, "pipeline_id string, inner_fold int, incremental_log_loss double, candidate_brier double, benchmark_brier double, candidate_ece double, benchmark_ece double, complexity_rank int")
    assert selectors.structural(df, []).first()["pipeline_id"] == "stable"
    pol = spark.createDataFrame([(0.0, i, 1.0, 300, 0.0001) for i in range(3)] + [(0.05, i, 0.4, 80, 0.0004) for i in range(3)], "threshold double, inner_fold int, coverage double, nonzero_decisions long, mean_net_edge double")
    assert selectors.abstention(pol, []).first()["threshold"] == 0.05
    thin = pol.withColumn("nonzero_decisions", F.lit(1).cast("long"))
    assert selectors.abstention(thin, []).first()["threshold"] == 0.0


def test_preliminary_gate(spark):
    rows = [("bollinger", 1, f, g, 0.25, 0.25, 0.02, 0.02, 0.2, 30, 0.0) for f, g in enumerate([0.01, 0.01, 0.01, -0.001, -0.001])]
    df = spark.createDataFrame(rows, "signal_family string, horizon int, outer_fold int, incremental_log_loss double, candidate_brier double, benchmark_brier double, candidate_ece double, benchmark_ece double, policy_coverage double, policy_nonzero_decisions long, policy_mean_net_edge double")
    got = gates.admission(df).first()
    assert got["preliminary_gate"] and got["development_admission_pass"]
    none = gates.admission(df.withColumn("incremental_log_loss", F.lit(-0.1))).first()
    assert none["concentration"] == 1.0 and "POSITIVE_MEAN_INCREMENTAL_LOG_LOSS" in none["failure_reasons"]


def test_status_cases(spark):
    df = spark.createDataFrame([(False, True, 1.0, 1.0, 1.0), (True, True, -1.0, -2.0, -1.0), (True, False, 1.0, 0.5, 2.0), (True, False, 1.0, -0.5, 2.0)], "e boolean, a boolean, g double, lo double, hi double")
    got = [r[0] for r in df.select(gates.status(*[F.col(c) for c in "e a g lo hi".split()])).collect()]
    assert got == ["NOT_ESTABLISHED", "SUSPENDED", "ACTIVE", "REDUCED"]


def test_logistic_meets_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < models.sigmoid(x @ [1.0, -2.0, 0.5] + 0.3)).astype(float)
    b = models.fit_logistic(x, y, 1.0)
    d = np.column_stack([np.ones(400), x])
    g = d.T @ (models.sigmoid(d @ b) - y) + np.concatenate([[0], b[1:]])
    assert np.abs(g).max() < 1e-6


def test_spline_basis_and_boosting():
    x = np.linspace(-1, 2, 50)
    for knots in (4, 6):
        b = models.spline_basis(x, 0.0, 1.0, knots)
        assert b.shape == (50, knots + 1) and np.isfinite(b).all() and (b.sum(axis=1) <= 1 + 1e-9).all()
    rng = np.random.default_rng(4)
    z = rng.normal(size=(1500, 2))
    y = ((z[:, 0] > 0) ^ (z[:, 1] > 0)).astype(float)
    p = models.Boosting(depth=4, rounds=60, rate=0.2).fit(z, y).predict(z)
    assert ((p > 0.5) == (y == 1)).mean() > 0.9


def test_calibration_maps():
    rng = np.random.default_rng(6)
    p = rng.random(600)
    y = (rng.random(600) < p**2).astype(float)
    for method in ("sigmoid", "isotonic"):
        q = models.calibrate(method, p, y)(p)
        assert ((q - y) ** 2).mean() < ((p - y) ** 2).mean() and (np.diff(q[np.argsort(p)]) >= -1e-9).all()


def test_auc_and_ece(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 0), (1, 0.5, 1), (1, 0.1, 0), (2, 0.3, 0)], "g int, p double, y int")
    got = {r["g"]: r["auc"] for r in M.auc(df, ["g"], "p", "y").collect()}
    assert got[1] == 0.875 and got[2] is None
    assert abs({r["g"]: r["ece"] for r in M.calibration_error(df, ["g"], "p", "y").collect()}[2] - 0.3) < 1e-12


def test_trim_keeps_all_at_zero(spark):
    df = series(spark, [float(i) for i in range(101)], "a").withColumn("b", F.col("a") * 2)
    got = {r["fraction"]: r["rows"] for r in summaries.joint_trim(df, ["symbol"], "a", "b", [0.0, 0.1]).collect()}
    assert got == {0.0: 101, 0.1: 81}


def test_paged_source(spark):
    def fetch(since, limit):
        return [(ms, 1.0, 2.0, 0.5, 1.5, 3.0) for ms in range((since + 999) // 1000 * 1000, 50_000, 1000)][:limit]

    assert len(list(paged.pages(fetch, 0, 20_000, 7))) == 20
    spark.dataSource.register(paged.PagedBars)
    df = spark.read.format("paged_bars").options(fetch=paged.packed(fetch), start="0", end="20000", slices="3", symbol="X", limit="4").load()
    assert df.count() == 20 and df.select("ts").distinct().count() == 20


def test_guards(spark):
    df = series(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        checks.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        checks.require_rows(df, 3)
    with pytest.raises(ValueError):
        checks.require_before(df, "2024-01-01 00:01:00")


def test_fewer_rounds_are_the_first_trees():
    rng = np.random.default_rng(9)
    z = rng.normal(size=(700, 3))
    y = (z[:, 0] * z[:, 1] + rng.normal(size=700) > 0).astype(float)
    model = models.Boosting(depth=4, rounds=40).fit(z, y)
    for rounds in (10, 25, 40):
        assert (model.predict(z, rounds) == models.Boosting(depth=4, rounds=rounds).fit(z, y).predict(z)).all()
