"""Cases that once went wrong: equal scores, repeated bars, folds' gaps, common samples, saved tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import gates, inference, models, policy, structures, summaries
from tidemark.plans import locked_evidence
from tidemark.sources import bars, saved


def plain_isotonic(p, y):
    """The least-squares rising fit at the distinct scores: max over lower ends of min over upper ends of means."""
    xs = sorted(set(p))
    mean = lambda a, b: np.mean([v for q, v in zip(p, y) if a <= q <= b])
    return [max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs]


def test_isotonic_pools_equal_scores():
    xs, ys = models.isotonic(np.array([0.2, 0.2, 0.8, 0.8]), np.array([0.0, 1, 0, 1]))
    assert xs.tolist() == [0.2, 0.8] and ys.tolist() == [0.5, 0.5]
    rng = np.random.default_rng(0)
    for _ in range(20):
        p, y = rng.integers(0, 8, 30) / 8, rng.integers(0, 2, 30).astype(float)
        assert np.allclose(models.isotonic(p, y)[1], plain_isotonic(p.tolist(), y.tolist()))


def test_the_last_row_of_a_file_counts(spark, tmp_path):
    file = tmp_path / "bars.csv"
    file.write_text("Date,Open,High,Low,Close,Volume\n2024-01-01,1,1,1,9,1\n2024-01-01,1,1,1,10,1\n2024-01-02,1,1,1,8,1\n")
    rows = bars.read_ohlcv_csv(spark, str(file))
    assert [r["close"] for r in bars.standardize(rows).orderBy("ts").collect()] == [10.0, 8.0]
    with pytest.raises(Exception, match="order"):
        bars.standardize(rows.drop(bars.PLACE)).collect()


def test_calibration_rows_lie_beyond_a_gap(spark, monkeypatch):
    """The model is fitted on rows that end `horizon` rows ahead of the calibration rows."""
    rng = np.random.default_rng(1)
    rows = [("S", i, 3, "train" if i < 400 else "test", float(rng.normal()), float(rng.normal()), int(rng.random() < 0.5), 0.0) for i in range(460)]
    df = spark.createDataFrame(rows, "symbol string, ts int, horizon int, part string, b double, s double, target_up int, future_return double")
    tasks = spark.createDataFrame([("linear", "c1.0", "p", None, False, m) for m in ("none", "sigmoid", "isotonic")], "model string, setting string, pipeline_id string, rows int, regime_conditioned boolean, method string")
    got = {m: [tuple(r) for r in structures.fit_tasks(df, tasks, ["symbol", "horizon"], ["b"], ["s"], [], "horizon").where(F.col("method") == m).orderBy("ts").select("benchmark_probability", "candidate_probability").collect()] for m in ("none", "sigmoid", "isotonic")}
    x = np.array([[r[4], r[5]] for r in rows])
    y = np.array([r[6] for r in rows], float)
    for k, name in ((1, 0), (2, 1)):
        model = models.Linear(1.0).fit(x[:317, :k], y[:317])  # 400 rows, 80 to calibrate, 3 between
        fix = models.calibrate("sigmoid", model.predict(x[320:400, :k]), y[320:400])
        assert np.allclose([r[name] for r in got["sigmoid"]], fix(model.predict(x[400:, :k])))
        steps = models.calibrate("isotonic", model.predict(x[320:400, :k]), y[320:400])
        assert np.allclose([r[name] for r in got["isotonic"]], steps(model.predict(x[400:, :k])))
        assert np.allclose([r[name] for r in got["none"]], models.Linear(1.0).fit(x[:400, :k], y[:400]).predict(x[400:, :k]))


def test_ece_and_accuracy_as_aggregates(spark):
    rng = np.random.default_rng(3)
    p, y = rng.random(200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    got = df.agg(metrics.ece(F.col("p"), F.col("y")).alias("e"), metrics.accuracy(F.col("p"), F.col("y")).alias("a")).first()
    bins = np.minimum((p * 10).astype(int), 9)
    want = sum((bins == b).sum() * abs(y[bins == b].mean() - p[bins == b].mean()) for b in set(bins.tolist())) / 200
    assert np.isclose(got["e"], want) and np.isclose(got["a"], ((p >= 0.5) == y).mean())


def test_saved_tables_need_a_shared_folder(spark):
    kept = saved.save(spark.range(3), "three")
    assert kept.count() == 3
    saved.discard(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept.saved_at)


def test_survival_is_the_normal_tail(spark):
    z = [0.0, 0.5, -0.5, 1.84748, 3.0, -6.0, 8.5, 40.0, float("inf"), float("-inf")]
    got = [r[1] for r in spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").select("i", inference.survival(F.col("z"))).orderBy("i").collect()]
    assert np.allclose(got, [inference.normal_survival(v) for v in z], atol=1e-12)


def test_the_recorded_test_of_the_locked_period(spark):
    """A mean of 0.002108928 with a standard error of 0.0011415 has p 0.0323; with one untested hypothesis 0.0647."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=2318)
    x = (x - x.mean()) / x.std() * 0.0011415 * np.sqrt(2318) + 0.002108928
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "signal string, ts int, g double")
    r = inference.predictive_test(df, ["signal"], "g", 0, ("other",)).first()
    assert abs(r["statistic"] - 1.84748) < 1e-3 and abs(r["p_value"] - 0.032339) < 1e-4 and abs(r["p_holm"] - 0.064677) < 2e-4
    flat = inference.predictive_test(df.withColumn("g", F.lit(0.0)), ["signal"], "g", 0).first()
    assert flat["statistic"] == float("-inf") and flat["p_value"] == 1.0


def test_evidence_and_robustness_of_clear_cases(spark):
    """A candidate that knows the outcome passes all but what is set against it; a worse one fails."""
    rng, rows = np.random.default_rng(5), []
    for i in range(900):
        side = 1 if i // 4 % 2 else -1
        up = int((i % 4 != 3) == (side == 1))  # right three times in four
        good = 0.5 + side * (0.25 + 0.01 * (i // 8 % 3 - 1))
        for signal, p in (("good", good), ("bad", 1 - good)):
            rows.append((signal, 1, f"2024-{1 + i // 75:02d}-{1 + i % 28:02d} {i // 28 % 24:02d}:{i % 60:02d}:00", float(p), 0.5 + 0.02 * float(rng.normal()), (2 * up - 1) * 0.01 + float(rng.normal()) * 0.001, up, f"P{1 + i // 300}", "stress" if i % 4 == 0 else "range"))
    df = spark.createDataFrame(rows, "signal string, fold int, ts string, candidate_probability double, benchmark_probability double, future_return double, target_up int, subperiod string, regime string").withColumn("ts", F.col("ts").cast("timestamp"))
    pred = saved.save(summaries.scored(df), "pred")
    matched = saved.save(policy.matched_returns(pred, ["signal", "fold"], 0.05), "matched")
    evidence = saved.save(locked_evidence.locked_evidence(matched, ["signal"], 0, (), 500), "evidence")
    got = {r["signal"]: r for r in evidence.collect()}
    assert got["good"]["predictive_gate"] and got["good"]["determination"] == gates.DETERMINATIONS[2]
    assert not got["bad"]["predictive_gate"] and got["bad"]["evidence_grade"] == gates.NO_EVIDENCE
    picks = spark.createDataFrame([("good", "linear", f"s{i % 5}") for i in range(5)] + [("bad", "linear", "s1")] * 5, "signal string, model_family string, signal_spec_id string")
    m = saved.save(locked_evidence.robustness_matrix(pred, matched, evidence, picks, ["signal"], ["signal", "fold"], 0.05), "matrix")
    table = {(r["signal"], r["diagnostic"]): r["status"] for r in m.collect()}
    assert len(table) == 30 and table["good", "development_exact_signal_specification_stability"] == "CAUTION"
    assert {v for (s, d), v in table.items() if s == "good" and "specification" not in d} == {"PASS"}
    assert table["bad", "confirmatory_multiplicity"] == "FAIL" and table["bad", "development_exact_signal_specification_stability"] == "PASS"
    classes = {r["signal"]: r["robustness_class"] for r in gates.diagnostic_class(m, ["signal"]).collect()}
    assert classes == {"good": gates.ROBUSTNESS[1], "bad": gates.ROBUSTNESS[0]}


def test_guards_refuse(spark):
    states = spark.createDataFrame([(0.5, 0.3, 0.2, "range"), (0.5, 0.3, 0.1, "range")], "state_p_range double, state_p_trend double, state_p_stress double, state_label string")
    assert locked_evidence.require_state_sums(states.limit(1)).count() == 1
    with pytest.raises(ValueError):
        locked_evidence.require_state_sums(states)
    plan = spark.createDataFrame([("outer", 1, 1, 0, 5), ("outer", 1, 1, 0, 6)], "level string, horizon int, outer_fold int, inner_fold int, n_train int")
    for wanted in ([("outer", 1, 1, 0)], [("outer", 1, 2, 0)]):
        with pytest.raises(ValueError):
            locked_evidence.fold_lookup(plan, spark.createDataFrame(wanted, "level string, horizon int, outer_fold int, inner_fold int"))
