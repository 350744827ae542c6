"""Structures fitted all at once equal single fits; isotonic ranges and spline columns equal plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import curves, models, structures


def test_structures_equal_single_fits(spark):
    rng, n = np.random.default_rng(5), {1: 330, 2: 200, 3: 150}
    rows, data = [], {}
    for f, k in n.items():
        b, s, c = rng.normal(size=(k, 2)), rng.normal(size=k), rng.normal(size=k)
        y = (rng.random(k) < 1 / (1 + np.exp(-(b[:, 0] + np.sin(2 * s))))).astype(int)
        data[f] = (b, s, c, y)
        rows += [(f, 2, i, "train" if i < k - 40 else "test", float(b[i, 0]), float(b[i, 1]), float(s[i]), float(c[i]), int(y[i]), 0.5) for i in range(k)]
    rows += [(1, 2, 9000, "train", None, 0.0, 0.0, 0.0, 1, 0.0), (1, 2, 9001, "purge", 0.0, 0.0, 0.0, 0.0, 1, 0.0)]
    df = spark.createDataFrame(rows, "fold int, horizon int, ts int, part string, b0 double, b1 double, s double, c double, target_up int, future_return double")
    grid = [("linear", "c0.1", None, False), ("linear", "c0.1", 150, True), ("spline", "k4-c1", None, True), ("spline", "k6-c0.1", 150, False)]
    tasks = spark.createDataFrame([(m, st, f"{m}-{st}-{w}", w, r, "none") for m, st, w, r in grid], "model string, setting string, pipeline_id string, rows int, regime_conditioned boolean, method string")
    got = structures.fit_tasks(df, tasks, ["fold"], ["b0", "b1"], ["s"], ["c"]).collect()
    assert {(r["fold"], r["pipeline_id"]) for r in got} == {(f, f"{m}-{st}-{w}") for f in (1, 2) for m, st, w, _ in grid}  # fold 3: 110 training rows
    for f in (1, 2):
        b, s, c, y = data[f]
        train = n[f] - 40
        for m, st, w, crossed in grid:
            first = train - min(train, w or train)
            setting = models.parse_setting(m, st)
            whole = np.column_stack([b, s, *([c] if crossed else [])])
            one = models.make_model(m, 1 + crossed, setting).fit(whole[first:train], y[first:train].astype(float)).predict(whole[train:])
            mark = models.make_model(m, 0, setting).fit(b[first:train], y[first:train].astype(float)).predict(b[train:])
            mine = sorted((r["ts"], r["candidate_probability"], r["benchmark_probability"], r["target_up"]) for r in got if r["fold"] == f and r["pipeline_id"] == f"{m}-{st}-{w}")
            assert [r[0] for r in mine] == list(range(train, n[f])) and [r[3] for r in mine] == y[train:].tolist()
            assert np.allclose([r[1] for r in mine], one, atol=1e-7) and np.allclose([r[2] for r in mine], mark, atol=1e-7)


def test_no_task_and_too_few_rows_give_nothing(spark):
    df = spark.createDataFrame([(1, 1, i, "train", 0.1 * i, 0.2, i % 2, 0.0) for i in range(50)], "fold int, horizon int, ts int, part string, b double, s double, target_up int, future_return double")
    tasks = spark.createDataFrame([("linear", "c1", "p", None, False, "none")], "model string, setting string, pipeline_id string, rows int, regime_conditioned boolean, method string")
    assert structures.fit_tasks(df, tasks, ["fold"], ["b"], ["s"], []).count() == 0
    assert structures.fit_tasks(df, tasks.limit(0), ["fold"], ["b"], ["s"], []).count() == 0


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_isotonic_ranges_merge_to_the_whole_map(spark, ranges):
    rng, rows, want, ask = np.random.default_rng(6), [], {}, np.linspace(-0.1, 1.1, 60)
    for k in ("a", "b", "c"):
        p = np.round(rng.random(150 if k != "c" else 1), 2)
        y = (rng.random(len(p)) < (p if k == "a" else 1 - p)).astype(float)
        rows += [(k, float(v), float(t)) for v, t in zip(p, y)]
        xs, ys = models.isotonic(p, y)
        want[k] = np.clip(np.interp(ask, xs, ys), 1e-9, 1 - 1e-9)
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("a", 0.5, None)], "k string, p double, y double")
    blocks = curves.isotonic_blocks(df, ["k"], "p", "y", ranges)
    asked = spark.createDataFrame([(k, i, float(v)) for k in want for i, v in enumerate(ask)] + [("a", 99, None)], "k string, i int, q double")
    got = {(r["k"], r["i"]): r["calibrated"] for r in curves.isotonic_map(asked, ["k"], "q", blocks).collect()}
    assert got.pop(("a", 99)) is None
    for k in want:
        assert np.allclose([got[k, i] for i in range(60)], want[k])


def test_spline_columns_equal_the_recursion(spark):
    x = np.concatenate([np.linspace(-1.5, 2.5, 81), [0.0, 1.0, 1 / 3]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    for knots, low, high in ((4, 0.0, 1.0), (6, -1.0, 2.0), (4, 0.5, 0.5)):
        made = curves.spline_columns(F.col("v"), knots)
        got = np.array([r[1:] for r in df.withColumn("v", curves.spline_place(F.col("x"), F.lit(low), F.lit(high), knots)).select("i", *made).orderBy("i").collect()])
        assert np.allclose(got, models.spline_basis(x, low, high, knots), atol=1e-12)
