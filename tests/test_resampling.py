"""Counter-based resampling against the same draws in NumPy; declared tests on known cases."""

import hashlib
import math

import numpy as np

from pyspark.sql import functions as F

from tidemark.operators import resampling


def draw(n, *counter):
    return int(int(hashlib.md5(":".join(map(str, counter)).encode()).hexdigest()[:8], 16) * n / 4294967296.0)


def plain_means(x, samples, block, seed=42):
    n, b = len(x), min(block, len(x))
    per = -(-n // b)
    out = []
    for s in range(samples):
        total = 0.0
        for j in range(per):
            at = draw(n - b + 1, seed, s, j)
            total += sum(x[at : at + (n - (per - 1) * b if j == per - 1 else b)])
        out.append(total / n)
    return np.array(out)


def test_bootstrap_makes_the_same_draws(spark):
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(size=57), "b": rng.normal(size=4), "c": rng.normal(size=1)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", 90, None), ("a", 91, float("nan")), ("a", 92, float("inf")), ("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, ts int, v double")
    got = {r["k"]: r for r in resampling.bootstrap_mean(df, ["k"], "v", 150, 10).collect()}
    assert got["d"]["n"] == 0 and got["d"]["mean"] is None and got["d"]["lower"] is None
    for k, x in series.items():
        m = plain_means(x, 150, 10)
        assert got[k]["n"] == len(x) and np.allclose([got[k]["lower"], got[k]["upper"]], np.quantile(m, [0.025, 0.975])) and np.isclose(got[k]["p_not_positive"], (m <= 0).mean())
    many = resampling.bootstrap_means(df.withColumn("w", F.col("v") * 2), ["k"], ["v", "w"], (10, 7), 50).collect()
    assert len(many) == 3 * 2 * 2 and all(np.isclose(r["lower"], np.quantile(plain_means(series[r["k"]] * (2 if r["value"] == "w" else 1), 50, r["block"]), 0.025)) for r in many)


def test_random_events_make_the_same_draws(spark):
    rng = np.random.default_rng(3)
    r, pos = rng.normal(size=40), rng.choice([-1.0, 0.0, 1.0], 40)
    df = spark.createDataFrame([("a", i, float(p), float(v)) for i, (p, v) in enumerate(zip(pos, r))] + [("b", 0, 0.0, 1.0)], "k string, ts int, pos double, r double")
    got = {x["k"]: x for x in resampling.random_event_pvalue(df, ["k"], "pos", "r", 0.001, 60).collect()}
    events = pos[pos != 0]
    seen = (events * r[pos != 0] - 0.002).mean()
    hits = sum(np.mean([p * r[draw(40, 42, s, j)] - 0.002 for j, p in enumerate(events)]) >= seen - 1e-12 for s in range(60))
    assert got["a"]["events"] == len(events) and np.isclose(got["a"]["observed"], seen) and np.isclose(got["a"]["p_value"], (hits + 1) / 61)
    assert got["b"]["events"] == 0 and got["b"]["p_value"] is None


def test_superior_ability_rejects_nulls_at_the_stated_rate(spark):
    rng = np.random.default_rng(4)
    worlds, n, k = 60, 80, 4
    x = rng.normal(size=(worlds, k, n))
    rows = [(w, f"c{c}", i, float(x[w, c, i])) for w in range(worlds) for c in range(k) for i in range(n)]
    rows += [(1000, f"c{c}", i, float(x[0, c, i] + (0.8 if c == 2 else -3.0))) for c in range(k) for i in range(n)]
    df = spark.createDataFrame(rows, "world int, name string, ts int, gain double")
    got = {r["world"]: r for r in resampling.superior_ability(df, ["world"], "name", "gain", 200, 1).collect()}
    null = [r for w, r in got.items() if w < 1000]
    assert np.mean([r["p_consistent"] < 0.1 for r in null]) < 0.1 + 3 * math.sqrt(0.09 / worlds)
    assert all(r["p_consistent"] <= r["p_upper"] + 1e-12 and r["candidates"] == k for r in got.values())
    best = got[1000]
    assert best["best"] == "c2" and best["p_consistent"] < 0.01  # candidates far below 0 do not hide it
    # The joint draws by hand: one world's statistic and values.
    d, m = x[0].mean(axis=1), np.array([plain_means(v, 200, 1) for v in x[0]])
    sd = m.std(axis=1)
    low = -sd * math.sqrt(2 * math.log(math.log(n)))
    stat = max((d / sd).max(), 0)
    upper = np.maximum(((m - d[:, None]) / sd[:, None]).max(axis=0), 0)
    consistent = np.maximum(((m - np.where(d >= low, d, 0)[:, None]) / sd[:, None]).max(axis=0), 0)
    assert np.isclose(got[0]["statistic"], stat) and np.isclose(got[0]["p_upper"], (upper >= stat - 1e-12).mean()) and np.isclose(got[0]["p_consistent"], (consistent >= stat - 1e-12).mean())


def test_one_standard_error_takes_the_simplest_near_the_best(spark):
    losses = {("a", 3): [0.50, 0.52, 0.48], ("b", 2): [0.505, 0.51, 0.50], ("c", 1): [0.60, 0.61, 0.62], ("d", 2): [0.505, 0.51, 0.50]}
    df = spark.createDataFrame([("k", n, c, f, v) for (n, c), x in losses.items() for f, v in enumerate(x)], "k string, name string, complexity int, fold int, loss double")
    r = resampling.one_standard_error(df, ["k"], "name", "complexity", "loss").first()
    assert r["name"] == "b" and np.isclose(r["limit"], 0.5 + np.std([0.50, 0.52, 0.48], ddof=1) / math.sqrt(3))
    one = resampling.one_standard_error(df.where("fold = 0"), ["k"], "name", "complexity", "loss").first()
    assert one["name"] == "a"  # a single fold has no error to allow for


def test_groups_of_a_length_share_their_draws(spark):
    """The plan deals draws by length and place, whatever the number of groups; results stay each group's own."""
    rng = np.random.default_rng(5)
    series = {k: rng.normal(size=n) for k, n in (("a", 31), ("b", 31), ("c", 12))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, place int, x double")
    means = resampling.block_means(df, ["k"], 40, 7)
    lines = [x for x in means._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "place" in x]
    assert lines and all("k#" not in x for x in lines if "end#" not in x)
    got = {}
    for r in means.orderBy("sample").collect():
        got.setdefault(r["k"], []).append(r["mean"])
    for k, x in series.items():
        assert np.allclose(got[k], plain_means(x, 40, 7), atol=1e-12)
