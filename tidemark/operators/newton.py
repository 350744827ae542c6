"""Logistic models of many folds and settings at once: keyed Newton steps and one-step screens.

The state of a fit is a small table: the coefficients of every key (a fold and setting). A round is one
pass over the rows: tasks add up each key's losses, gradients and Hessians of the rows they read, Spark
adds the tasks' sums, and the driver solves one small system a key. Rows of a fold may lie in any number
of tasks, and a key's rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.saved import save

ROUNDS, TOLERANCE = 100, 1e-10


def _sums(rows: DataFrame, keys: list[str], trial: dict[tuple, np.ndarray]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
    """{key: (loss, gradient, Hessian)} of the weighted logistic losses at trial coefficients.

    rows: (keys, x array of doubles, y, w). A task returns one row a key it met.
    """
    table = dict(trial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # Array lengths differ between settings, so rows are taken key by key.
            groups = pd.DataFrame({k: batch.column(k).to_pylist() for k in keys}).groupby(keys, sort=False).indices
            x, y, w = batch.column("x"), batch.column("y").to_numpy(zero_copy_only=False).astype(float), batch.column("w").to_numpy(zero_copy_only=False)
            at, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
            for k, mine in groups.items():
                k = k if isinstance(k, tuple) else (k,)
                if k not in table:
                    continue
                b = table[k]
                d = np.empty((len(mine), len(b)))
                d[:, 0] = 1.0
                d[:, 1:] = flat[at[mine][:, None] + np.arange(len(b) - 1)]
                f = d @ b
                p = 0.5 * (1 + np.tanh(f / 2))
                v = w[mine]
                own = total.setdefault(k, [0.0, np.zeros(len(b)), np.zeros((len(b), len(b)))])
                own[0] += float(v @ (np.logaddexp(0, f) - y[mine] * f))
                own[1] += d.T @ (v * (p - y[mine]))
                own[2] += (d * (v * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ d
        if total:
            packed = [np.concatenate([[loss], g, h.ravel()]).tolist() for loss, g, h in total.values()]
            columns = [pa.array([k[i] for k in total], rows_schema.field(name).type) for i, name in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.list_(pa.float64()))], names=[*keys, "sums"])

    rows_schema = pa.schema([(k, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[dict(rows.dtypes)[k]]) for k in keys])
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    parts = rows.select(*keys, "x", "y", "w").mapInArrow(run, schema)
    added = parts.select(*keys, F.posexplode("sums").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    packed = added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))
    out = {}
    for r in packed.collect():  # a row a key
        k = tuple(r[c] for c in keys)
        n, s = len(trial[k]), np.array(r["sums"])
        out[k] = (float(s[0]), s[1 : 1 + n], s[1 + n :].reshape(n, n))
    return out


def fit(rows: DataFrame, keys: list[str], cost: dict[tuple, float] | float = 1.0, rounds: int = ROUNDS) -> dict[tuple, np.ndarray]:
    """{key: intercept and weights} minimising 1/2 |weights|^2 + cost * the sum of w * log loss, by Newton's method.

    rows: (keys, x, y, w), written or cached; keys without rows have no model. Steps that do not lower the
    objective are halved: a round looks at every key's trial point, and moves on only where it is better.
    """
    widths = {tuple(r[k] for k in keys): r["d"] for r in rows.groupBy(*keys).agg(F.max(F.size("x")).alias("d")).collect()}
    c = {k: cost if isinstance(cost, float) else cost[k] for k in widths}
    best = {k: np.zeros(d + 1) for k, d in widths.items()}
    value, step, done = {k: np.inf for k in best}, {k: None for k in best}, {}
    trial, scale = {k: b.copy() for k, b in best.items()}, {k: 1.0 for k in best}

    def moving(rows: DataFrame) -> DataFrame:
        """The rows of keys that have no model yet: late rounds, of a few slow keys, read few rows."""
        schema = T.StructType([rows.schema[k] for k in keys])
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(trial), schema)), keys, "left_semi")

    for _ in range(rounds):
        if not trial:
            break
        found = _sums(rows if len(trial) == len(widths) else moving(rows), keys, trial)
        for k in list(trial):
            loss, g, h = found[k]
            b = trial[k]
            now = c[k] * loss + 0.5 * float(b[1:] @ b[1:])
            if now > value[k] + 1e-12 * max(1.0, abs(now)) and scale[k] > 1e-6:  # no better: half the step from the point before
                scale[k] /= 2
                trial[k] = best[k] - scale[k] * step[k]
                continue
            moved = np.inf if step[k] is None else np.abs(scale[k] * step[k]).max()
            best[k], value[k], scale[k] = b, now, 1.0
            if moved < TOLERANCE:
                done[k] = trial.pop(k)
                continue
            ridge = np.diag([0.0, *np.ones(len(b) - 1)])
            step[k] = np.linalg.solve(c[k] * h + ridge + 1e-12 * np.eye(len(b)), c[k] * g + ridge @ b)
            trial[k] = b - step[k]
    return best | done


def enough(rows: DataFrame, keys: list[str], target: str, least_train: int = 120, least_test: int = 20) -> DataFrame:
    """Rows of the folds with enough training and test rows and both outcomes among the training rows."""
    train = F.col("part") == "train"
    rows = rows.where(F.col("part").isin("train", "test"))
    sizes = rows.groupBy(*keys).agg(F.count_if(train).alias("n"), F.count_if(~train).alias("m"), F.count_if(train & (F.col(target) == 1)).alias("ups"))
    kept = save(sizes.where((F.col("n") >= least_train) & (F.col("m") >= least_test) & (F.col("ups") > 0) & (F.col("ups") < F.col("n"))).select(*keys), "folds")
    return rows.join(kept, keys)


def table(models: dict[tuple, np.ndarray], rows: DataFrame, keys: list[str], name: str = "beta") -> DataFrame:
    """Coefficients as a table (keys, beta)."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(name, T.ArrayType(T.DoubleType()))])
    return rows.sparkSession.createDataFrame([(*k, b.tolist()) for k, b in models.items()], schema)


def score(beta: Column, x: Column) -> Column:
    """intercept + weights . x"""
    return F.aggregate(F.zip_with(F.slice(beta, 2, F.size(x)), x, lambda a, b: a * b), beta[0], lambda s, v: s + v)


def sigmoid(f: Column) -> Column:
    return F.when(f >= 0, 1.0 / (1.0 + F.exp(-f))).otherwise(F.exp(f) / (1.0 + F.exp(f)))


def standardised(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with x: the columns centred and scaled by the means and deviations of each key's training rows.

    One aggregate a key; a column that does not vary is only centred.
    """
    train = F.col("part") == "train"
    own = rows.groupBy(*keys).agg(*[F.avg(F.when(train, F.col(c))).alias(f"__m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(F.when(train, F.col(c))).alias(f"__s{i}") for i, c in enumerate(columns)])
    own = save(own, "moments")
    z = [(F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0) for i, c in enumerate(columns)]
    return rows.join(own, keys).withColumn("x", F.array(*z)).drop(*own.drop(*keys).columns)


def balanced(rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """rows with w: each outcome's training rows weigh as much as the other's."""
    train = F.col("part") == "train"
    n = rows.groupBy(*keys).agg(F.count_if(train).alias("__n"), F.count_if(train & (F.col(target) == 1)).alias("__n1"))
    own = F.when(F.col(target) == 1, F.col("__n1")).otherwise(F.col("__n") - F.col("__n1"))
    return rows.join(save(n, "weights"), keys).withColumn("w", F.when(own > 0, F.col("__n") / (2.0 * own)).otherwise(1.0)).drop("__n", "__n1")


def probabilities(rows: DataFrame, keys: list[str], columns: list[str], target: str, cost: float = 1.0, name: str = "probability") -> DataFrame:
    """rows (keys, part, columns, target) with the probability of a ridge model fitted on each key's training rows."""
    z = save(standardised(rows, keys, columns), "standardised")
    train = z.where("part = 'train'").select(*keys, "x", F.col(target).alias("y"), F.lit(1.0).alias("w"))
    models = table(fit(train, keys, cost), rows, keys, "__beta")
    return z.join(F.broadcast(models), keys).withColumn(name, sigmoid(score(F.col("__beta"), F.col("x")))).drop("__beta", "x")


def matched_folds(rows: DataFrame, keys: list[str], base: list[str], candidates: dict[str, list[str]], target: str, cost: float = 1.0, balance: bool = False) -> DataFrame:
    """(signal, keys, ts, benchmark_probability, candidate_probability) of every candidate on each fold's test rows.

    candidates: the further columns of each signal. All see the rows that are complete in all columns; the
    benchmark is fitted once a fold. The models of all folds and signals are one keyed fit.
    """
    every = list(dict.fromkeys([*base, *(c for extra in candidates.values() for c in extra)]))
    whole = rows.where(F.col("part").isin("train", "test")).select(*keys, "ts", "part", *every, target).na.drop()
    whole = save(balanced(whole, keys, target) if balance else whole.withColumn("w", F.lit(1.0)), "matched-rows")
    parts = None
    for model, extra in (("", []), *candidates.items()):
        one = standardised(whole, keys, [*base, *extra]).select(*keys, "ts", "part", target, "w", F.lit(model).alias("signal"), "x")
        parts = one if parts is None else parts.unionByName(one)
    parts, who = save(parts, "standardised"), [*keys, "signal"]
    models = table(fit(parts.where("part = 'train'").select(*who, "x", F.col(target).alias("y"), "w"), who, cost), parts, who, "__beta")
    p = parts.where("part = 'test'").join(F.broadcast(models), who).select(*who, "ts", sigmoid(score(F.col("__beta"), F.col("x"))).alias("p"))
    mark = p.where("signal = ''").select(*keys, "ts", F.col("p").alias("benchmark_probability"))
    return p.where("signal <> ''").withColumnRenamed("p", "candidate_probability").join(mark, [*keys, "ts"])


# ---------------------------------------------------------------- one-step screens


def screen_sums(rows: DataFrame, keys: list[str], base: str, target: str, columns: list[str]) -> DataFrame:
    """Per key: weights, residuals and cross products of a one-step logistic model on an offset.

    The design is 1 and `columns`, standardised on the training rows. Sums of raw products are enough: the
    standardised ones follow from them, so all keys take one pass. w = max(p (1 - p), 1e-6), r = y - p.
    """
    k = len(columns)
    p = F.col(base)
    w, r = F.greatest(p * (1 - p), F.lit(1e-6)), F.col(target) - p
    d = [F.lit(1.0), *[F.col(c) for c in columns]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(w * d[i] * d[j]).alias(f"h{i}{j}") for i, j in pairs],
        *[F.sum(r * d[i]).alias(f"g{i}") for i in range(k + 1)],
        *[F.avg(c).alias(f"m{i + 1}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i + 1}") for i, c in enumerate(columns)],
    )


def solve_step(sums: DataFrame, k: int, ridge: float = 1.0) -> DataFrame:
    """sums with b0..bk: one Newton step (intercept free, standardised columns ridged), by elimination in columns."""
    size = k + 1
    sd = lambda i: F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0)
    h = lambda i, j: F.col(f"h{min(i, j)}{max(i, j)}")
    at = {}
    for i in range(size):
        for j in range(i, size):
            if i == 0:
                v = h(0, 0) if j == 0 else (h(0, j) - F.col(f"m{j}") * h(0, 0)) / sd(j)
            else:
                v = (h(i, j) - F.col(f"m{i}") * h(0, j) - F.col(f"m{j}") * h(0, i) + F.col(f"m{i}") * F.col(f"m{j}") * h(0, 0)) / (sd(i) * sd(j)) + (ridge if i == j else 0.0)
            at[f"a{i}{j}"] = v
        at[f"y{i}"] = F.col("g0") if i == 0 else (F.col(f"g{i}") - F.col(f"m{i}") * F.col("g0")) / sd(i)
    out = sums.withColumns(at)
    # The matrix is positive definite, so no rows change places; it stays symmetric, so its upper half is enough.
    for p in range(size - 1):
        new = {}
        for i in range(p + 1, size):
            part = F.col(f"a{p}{i}") / F.col(f"a{p}{p}")
            new |= {f"a{i}{j}": F.col(f"a{i}{j}") - part * F.col(f"a{p}{j}") for j in range(i, size)}
            new[f"y{i}"] = F.col(f"y{i}") - part * F.col(f"y{p}")
        out = out.withColumns(new)
    for i in reversed(range(size)):
        rest = sum((F.col(f"a{i}{j}") * F.col(f"b{j}") for j in range(i + 1, size)), F.lit(0.0))
        out = out.withColumn(f"b{i}", (F.col(f"y{i}") - rest) / F.col(f"a{i}{i}"))
    made = [f"b{i}" for i in range(size)]
    return out.select(*sums.columns, *made)


def offset_screens(rows: DataFrame, keys: list[str], specs: DataFrame, base: str, states: list[str], target: str, least_train: int = 120, least_test: int = 20) -> DataFrame:
    """(keys, spec_id, n_test, incremental_log_loss, candidate_brier, benchmark_brier): a one-step screen a fold and specification.

    rows: (keys, symbol, ts, part, base probability, states, target); specs: (symbol, ts, spec_id, score).
    A specification adds its score and the products with the states to the benchmark's logit. Two
    aggregates by (keys, spec_id) do all: the sums of the step, and the test rows' losses.
    """
    columns = ["score", *[f"score_x_{s}" for s in states]]
    joined = rows.join(specs, ["symbol", "ts"]).withColumns({f"score_x_{s}": F.col("score") * F.col(s) for s in states})
    who = [*keys, "spec_id"]
    sums = screen_sums(joined.where("part = 'train'"), who, base, target, columns).where(F.col("n") >= least_train)
    step = save(solve_step(sums, len(columns)).select(*who, *[F.col(f"{a}{i}") for i in range(1, len(columns) + 1) for a in "ms"], *[f"b{i}" for i in range(len(columns) + 1)]), "steps")
    p0, y = F.col(base), F.col(target)
    safe = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    shift = F.col("b0") + sum((F.col(f"b{i + 1}") * (F.col(c) - F.col(f"m{i + 1}")) / F.when(F.col(f"s{i + 1}") > 0, F.col(f"s{i + 1}")).otherwise(1.0) for i, c in enumerate(columns)), F.lit(0.0))
    tested = joined.where("part = 'test'").join(step, who).withColumn("__p", sigmoid(F.log(safe(p0) / (1 - safe(p0))) + shift))
    loss = lambda p: -(y * F.log(F.greatest(p, F.lit(1e-9))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-9))))
    p1 = F.col("__p")
    out = tested.groupBy(*who).agg(F.count("*").alias("n_test"), F.avg(loss(p0) - loss(p1)).alias("incremental_log_loss"), F.avg((p1 - y) * (p1 - y)).alias("candidate_brier"), F.avg((p0 - y) * (p0 - y)).alias("benchmark_brier"))
    return out.where(F.col("n_test") >= least_test)
