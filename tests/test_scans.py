"""Scans over chunks against plain recursions, and keyed state models against plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import scans, states


def plain_filter(logp, start, transition):
    out, prior = np.empty_like(logp), start
    for i, e in enumerate(logp):
        x = (prior if i == 0 else prior @ transition) * np.exp(e - e.max())
        prior = out[i] = x / x.sum()
    return out


def plain_strength(prices, period):
    move = pd.Series(prices, dtype=float).diff()
    mean = lambda x: x.ewm(alpha=1 / period, adjust=False, min_periods=period).mean()
    gain, loss = mean(move.clip(lower=0)), mean(-move.clip(upper=0))
    return (100 - 100 / (1 + gain / loss.where(loss != 0))).clip(0, 100).to_numpy()


def test_relative_strength_is_a_scan_over_chunks(spark):
    rng = np.random.default_rng(0)
    prices = {"A": 100 * np.exp(np.cumsum(rng.normal(size=1400) * 0.01)), "B": 50 + np.arange(40.0), "C": np.array([1.0])}
    prices["A"][[3, 500, 501, 502]] = np.nan
    prices["A"][900:960] = np.nan
    df = spark.createDataFrame([(k, i, None if np.isnan(x) else float(x)) for k, v in prices.items() for i, x in enumerate(v)], "symbol string, ts long, pri_close double")
    periods = {"a": 14, "b": 2, "c": 1}
    made = I.relative_strengths(df, periods)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    got = made.toPandas()
    for k, v in prices.items():
        own = got[got["symbol"] == k].sort_values("ts")
        for name, period in periods.items():
            assert np.allclose(own[name].to_numpy(float), plain_strength(v, period), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_filter_scan_equals_the_recursion(spark, size):
    rng, n = np.random.default_rng(1), 300
    e = rng.random((n, 3)) ** 6 + 1e-12
    e[100:104] = [1.0, 1e-200, 1e-200]
    t, start = np.array([[0.9, 0.05, 0.05], [0.1, 0.85, 0.05], [0.02, 0.08, 0.9]]), np.array([0.5, 0.3, 0.2])
    df = spark.createDataFrame([("s", i, *map(float, x)) for i, x in enumerate(e)], "symbol string, ts long, e0 double, e1 double, e2 double").withColumns({"st": F.lit(start.tolist()), "tr": F.lit(t.ravel().tolist())})
    rows = scans.filter_scan(df, ["symbol"], "ts", ["e0", "e1", "e2"], "st", "tr", size).orderBy("ts").collect()
    want = plain_filter(np.log(e), start, t)
    assert [r["ts"] for r in rows] == list(range(n)) and np.allclose([r["posterior"] for r in rows], want, atol=1e-9)
    part = scans.filter_scan(df.where("ts < 40"), ["symbol"], "ts", ["e0", "e1", "e2"], "st", "tr", size).orderBy("ts").collect()
    assert np.allclose([r["posterior"] for r in part], want[:40], atol=1e-9)  # causal


def plain_lloyd(z, at):
    for _ in range(300):
        k = ((z[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
        now = np.array([z[k == i].mean(axis=0) if (k == i).any() else at[i] for i in range(3)])
        if np.abs(now - at).max() <= 1e-12:
            return now
        at = now
    return at


def fold_rows(seed, n):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, 3)) * [0.01, 0.002, 0.001] + [0, 0.05 * (1 + k), 0.01 * (k == 1)] for k in range(3)])
    return x[rng.permutation(len(x))]


def test_keyed_states_equal_plain_ones(spark):
    folds = {1: fold_rows(1, 40), 2: fold_rows(2, 25), 3: fold_rows(3, 2)}
    rows = spark.createDataFrame([(f, "P", i, *map(float, r), "train" if i < 0.8 * len(x) else "test") for f, x in folds.items() for i, r in enumerate(x)], "fold int, symbol string, ts long, pri_ret_1 double, vol_20 double, trend_12 double, part string")
    fitted = {r["fold"]: r for r in states.fit_folds(rows, ["fold"], 4).collect()}
    assert sorted(fitted) == [1, 2]  # fold 3 has too few rows
    got = states.fold_states(rows, ["fold"], 4).toPandas()
    for f in (1, 2):
        x, p = folds[f], fitted[f]
        train = x[: int(np.ceil(0.8 * len(x)))]
        z = (train - train.mean(axis=0)) / train.std(axis=0)
        means = np.array(p["means"]).reshape(3, 3)
        now = plain_lloyd(z, means)
        assert np.allclose(now, means, atol=1e-9)  # the centroids of its own clusters
        k = ((z[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        cov = np.array([np.cov(z[k == i], rowvar=False) + 1e-5 * np.eye(3) for i in range(3)])
        assert np.allclose(np.array(p["cov"]).reshape(3, 3, 3), cov) and np.linalg.eigvalsh(cov).min() > 0
        moves = np.ones((3, 3))
        np.add.at(moves, (k[:-1], k[1:]), 1)
        assert np.allclose(np.array(p["transition"]).reshape(3, 3), moves / moves.sum(axis=1, keepdims=True))
        assert train[k == 2, 1].mean() == max(train[k == i, 1].mean() for i in range(3))
        d = (x - p["location"]) / p["scale"]
        logp = np.array([[-0.5 * ((r - means[i]) @ np.linalg.inv(cov[i]) @ (r - means[i]) + np.linalg.slogdet(cov[i])[1]) for i in range(3)] for r in d])
        want = plain_filter(logp, np.array(p["start"]), np.array(p["transition"]).reshape(3, 3))
        own = got[got["fold"] == f].sort_values("ts")
        assert np.allclose(own[[f"state_p_{s}" for s in states.STATES]].to_numpy(), want, atol=1e-9)
        assert (own["state_label"].to_numpy() == np.array(states.STATES)[want.argmax(axis=1)]).all()


def test_lloyd_from_equal_starts(spark):
    x = fold_rows(4, 50)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([(1, *map(float, r)) for r in z], "fold int, z0 double, z1 double, z2 double")
    starts = {(1, s): z[[s, s + 1, s + 2]].copy() for s in range(3)}
    for (_, s), (cost, c, count) in states.lloyd(df, ["fold"], starts).items():
        want = plain_lloyd(z, z[[s, s + 1, s + 2]].copy())
        assert np.allclose(c, want, atol=1e-9) and count.sum() == len(z)
        assert np.isclose(cost, ((z[:, None] - want[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_states_of_empty_and_constant_series(spark):
    schema = "symbol string, ts long, pri_ret_1 double, vol_20 double, trend_12 double"
    empty = spark.createDataFrame([], schema)
    assert states.forward_filter(empty, states.fit(empty, 2)).count() == 0
    flat = spark.createDataFrame([("P", i, 0.0, 0.0, 0.0) for i in range(30)], schema)
    assert states.forward_filter(flat, states.fit(flat, 2)).count() == 0  # no three clusters
