"""Keyed Newton fits and one-step screens against plain ones of one fold."""

import numpy as np
import pytest

from tidemark.operators import models, newton


def folds(rng, sizes, dims):
    out = []
    for f, n in enumerate(sizes):
        x = rng.normal(size=(n, dims)) * rng.uniform(0.1, 5, dims) + rng.normal(size=dims)
        y = (rng.random(n) < newton_sigmoid(x[:, 0] / 3 - 0.5)).astype(float)
        out.append((f, x, y))
    return out


def newton_sigmoid(f):
    return 1 / (1 + np.exp(-f))


def test_keyed_newton_equals_single_fits(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for f, x, y in folds(rng, (150, 40, 300), 4):
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        w = rng.uniform(0.5, 2, len(y))
        for setting, d, cost in (("a", 4, 1.0), ("b", 2, 0.1), ("c", 3, 50.0)):
            want[f, setting] = models.fit_logistic(z[:, :d], y, cost, w)
            rows += [(f, setting, z[i, :d].tolist(), float(y[i]), float(w[i])) for i in range(len(y))]
    x = np.array([[-1.0], [1.0]] * 20)  # separable: held by the ridge alone
    want[9, "a"] = models.fit_logistic(x, (x[:, 0] > 0).astype(float), 1.0)
    rows += [(9, "a", v.tolist(), float(v[0] > 0), 1.0) for v in x]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "fold int, setting string, x array<double>, y double, w double").repartition(7)
    cost = {k: {"a": 1.0, "b": 0.1, "c": 50.0}[k[1]] for k in want}
    got = newton.fit(df.cache(), ["fold", "setting"], cost)
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-8)


def plain_screen(train, test, p0, q0, y, t):
    """One step on one fold: intercept free, standardised columns ridged."""
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd[sd == 0] = 1
    d = np.column_stack([np.ones(len(train)), (train - mean) / sd])
    w = np.maximum(p0 * (1 - p0), 1e-6)
    b = np.linalg.solve((d * w[:, None]).T @ d + np.diag([0.0, *np.ones(train.shape[1])]), d.T @ (y - p0))
    p = newton_sigmoid(np.log(q0 / (1 - q0)) + b[0] + ((test - mean) / sd) @ b[1:])
    loss = lambda q: -(t * np.log(q) + (1 - t) * np.log(1 - q)).mean()
    return loss(q0) - loss(p), ((p - t) ** 2).mean(), ((q0 - t) ** 2).mean()


def test_screens_equal_plain_steps(spark):
    rng = np.random.default_rng(2)
    rows, scores = [], {}
    for f, n in ((1, 260), (2, 200)):
        state = rng.dirichlet([4, 3, 2], n)
        p0, y = rng.uniform(0.2, 0.8, n), rng.integers(0, 2, n)
        rows += [(f, "P", 1000 * f + i, "train" if i < n - 50 else "test", float(p0[i]), *map(float, state[i]), int(y[i])) for i in range(n)]
        scores |= {(1000 * f + i, s): float(rng.normal()) if s != "flat" else 0.0 for i in range(n) for s in ("x", "y", "flat")}
    df = spark.createDataFrame(rows, "fold int, symbol string, ts int, part string, p0 double, a double, b double, c double, target int")
    specs = spark.createDataFrame([("P", t, s, v) for (t, s), v in scores.items()], "symbol string, ts int, spec_id string, score double")
    got = {(r["fold"], r["spec_id"]): r for r in newton.offset_screens(df, ["fold"], specs, "p0", ["a", "b", "c"], "target").collect()}
    assert len(got) == 6
    for (f, s), r in got.items():
        own = [x for x in rows if x[0] == f]
        block = np.array([[scores[x[2], s] * v for v in (1.0, *x[5:8])] for x in own])
        train = np.array([x[3] == "train" for x in own])
        p, y = np.array([x[4] for x in own]), np.array([x[8] for x in own], float)
        want = plain_screen(block[train], block[~train], p[train], p[~train], y[train], y[~train])
        assert r["n_test"] == 50 and np.allclose((r["incremental_log_loss"], r["candidate_brier"], r["benchmark_brier"]), want, atol=1e-9)


def test_benchmark_of_a_fold_equals_a_single_fit(spark):
    rng, rows = np.random.default_rng(3), []
    for f, x, y in folds(rng, (180, 60), 3):
        rows += [(f, i, "train" if i < 130 else "test", *map(float, x[i]), int(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "fold int, ts int, part string, a double, b double, c double, y int")
    enough = newton.enough(df, ["fold"], "y")
    got = newton.probabilities(enough, ["fold"], ["a", "b", "c"], "y").collect()
    assert {r["fold"] for r in got} == {0}  # the other has too few test rows
    one = [r for r in rows if r[0] == 0]
    m = models.Linear().fit(np.array([r[3:6] for r in one if r[2] == "train"]), np.array([r[6] for r in one if r[2] == "train"], float))
    want = {r[1]: m.predict(np.array([r[3:6]]))[0] for r in one}
    assert all(np.isclose(r["probability"], want[r["ts"]], atol=1e-9) for r in got)


def test_no_rows_no_models(spark):
    df = spark.createDataFrame([], "fold int, x array<double>, y double, w double")
    assert newton.fit(df, ["fold"]) == {}
    with pytest.raises(KeyError):
        newton.fit(spark.createDataFrame([(1, [0.5], 1.0, 1.0)], "fold int, x array<double>, y double, w double"), ["fold"], {(2,): 1.0})


def test_late_rounds_read_only_keys_that_still_move(spark, monkeypatch):
    rng, rows, read = np.random.default_rng(3), [], []
    for key, sizes, steep in ((0, 400, 0.0), (1, 40, 40.0)):
        x = rng.normal(size=(sizes, 2))
        rows += [(key, v.tolist(), float(rng.random() < newton_sigmoid(steep * v[0])), 1.0) for v in x]
    df = spark.createDataFrame(rows, "k int, x array<double>, y double, w double").cache()
    sums = newton._sums
    monkeypatch.setattr(newton, "_sums", lambda rows, keys, trial: read.append(rows.count()) or sums(rows, keys, trial))
    got = newton.fit(df, ["k"], {(0,): 1.0, (1,): 1e4})
    assert read[0] == 440 and read[-1] == 40
    for k, cost in ((0, 1.0), (1, 1e4)):
        own = [r for r in rows if r[0] == k]
        assert np.allclose(got[(k,)], models.fit_logistic(np.array([r[1] for r in own]), np.array([r[2] for r in own]), cost), atol=1e-6)
