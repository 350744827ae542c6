"""Latent market states: clusters of each fold's training rows, then a causal forward filter.

All folds are fitted at once: the centroids of every (fold, start) are a small table, and one aggregate a
round moves them all. The filter is a scan over chunks (`operators.scans`).
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scans import filter_scan
from tidemark.sources.saved import discard, save

INPUTS = ("pri_ret_1", "vol_20", "trend_12")
STATES = ("range", "trend", "stress")
LEAST_ROWS, STARTS, ROUNDS, SEED = 10, 10, 300, 42
RIDGE = 1e-5
Z = ("z0", "z1", "z2")


def _squared(c: str, k: int) -> Column:
    """The squared distance of a row to the kth of three centroids in an array of nine numbers."""
    gaps = [F.col(z) - F.col(c)[3 * k + i] for i, z in enumerate(Z)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def nearest(c: str) -> tuple[Column, Column]:
    """(number of the nearest of three centroids, its squared distance); ties to the lower number."""
    d = [_squared(c, k) for k in range(3)]
    return F.when((d[0] <= d[1]) & (d[0] <= d[2]), 0).when(d[1] <= d[2], 1).otherwise(2), F.least(*d)


def _fields(rows: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [rows.schema[k] for k in keys]


def lloyd(z: DataFrame, keys: list[str], first: dict[tuple, np.ndarray], rounds: int = ROUNDS) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
    """Three-means of every fold from each of its starts: {(fold..., start): (cost, centroids, counts)}.

    z: (keys, z0, z1, z2). The state is the table of centroids, nine numbers a fold and start; each round
    is one aggregate over the rows of the folds whose centroids still move. An unused centroid stays.
    """
    spark, done = z.sparkSession, {}
    schema = T.StructType([*_fields(z, keys), T.StructField("start", T.IntegerType()), T.StructField("c", T.ArrayType(T.DoubleType()))])
    moving = {k: np.array(c, np.float64) for k, c in first.items()}
    k, d = nearest("c")
    for _ in range(rounds):
        table = F.broadcast(spark.createDataFrame([(*key, c.ravel().tolist()) for key, c in moving.items()], schema))
        near = z.join(table, keys).select(*keys, "start", *Z, k.alias("k"), d.alias("d"))
        found = near.groupBy(*keys, "start", "k").agg(F.count("*").alias("n"), F.sum("d").alias("cost"), *[F.avg(c).alias(c) for c in Z]).collect()
        new, count, cost = {key: c.copy() for key, c in moving.items()}, {key: np.zeros(3, np.int64) for key in moving}, dict.fromkeys(moving, 0.0)
        for r in found:
            key = (*[r[c] for c in keys], r["start"])
            new[key][r["k"]] = [r[c] for c in Z]
            count[key][r["k"]] = r["n"]
            cost[key] += r["cost"]
        for key, c in new.items():
            done[key] = (cost[key], c, count[key])
        moving = {key: c for key, c in new.items() if np.abs(c - moving[key]).max() > 1e-12}
        if not moving:
            break
    return done


def starting_rows(z: DataFrame, keys: list[str], starts: int, seed: int = SEED) -> dict[tuple, np.ndarray]:
    """The first centroids of every (fold, start): the three rows of the least hashes of (seed, start, row number)."""
    tried = z.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("start").cast("string"), F.col("rn").cast("string")).cast("binary"))
    ranked = tried.withColumn("place", F.row_number().over(W.partitionBy(*keys, "start").orderBy(draw, "rn"))).where("place <= 3")
    out: dict[tuple, np.ndarray] = {}
    for r in ranked.collect():  # three rows a fold and start
        out.setdefault((*[r[k] for k in keys], r["start"]), np.zeros((3, 3)))[r["place"] - 1] = [r[c] for c in Z]
    return out


PARAMETERS = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("location", "scale", "means", "cov", "precision", "logdet", "start", "transition")])


def fit_folds(rows: DataFrame, keys: list[str], starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """(keys, location, scale, means, cov, precision, logdet, start, transition): a model of each fold's training rows.

    Inputs are standardised and clustered (the cheapest of several starts that uses three clusters), and
    summarised: means, covariances, smoothed shares and transitions. The state with the greatest mean
    volatility is stress, of the others the one with the greatest mean |trend| is trend, the last range.
    Arrays hold the states in the order of STATES. Folds with fewer than ten rows or no three clusters
    give none. What the driver holds is a few numbers a fold.
    """
    spark = rows.sparkSession
    train = rows.where("part = 'train'").select(*keys, "symbol", "ts", *INPUTS).na.drop()
    moments = train.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(INPUTS)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(INPUTS)]).where(F.col("n") >= LEAST_ROWS)
    moments = save(moments, "moments")
    spread = lambda i: F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}"))
    z = train.join(moments, keys).select(*keys, "symbol", "ts", (F.row_number().over(W.partitionBy(*keys).orderBy("ts", "symbol")) - 1).alias("rn"), *[((F.col(c) - F.col(f"m{i}")) / spread(i)).alias(Z[i]) for i, c in enumerate(INPUTS)], F.col(INPUTS[1]).alias("x1"), F.col(INPUTS[2]).alias("x2"))
    z = save(z, "standardised")
    runs, best = lloyd(z, keys, starting_rows(z, keys, starts, seed)), {}
    for (*fold, start), (cost, c, count) in sorted(runs.items(), key=lambda r: (round(r[1][0], 9), r[0][-1])):
        if count.all():
            best.setdefault(tuple(fold), c)
    located = {tuple(r[k] for k in keys): r for r in moments.collect()}
    schema = T.StructType([*_fields(z, keys), *PARAMETERS.fields])
    if not best:
        discard(moments, z)
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(*fold, c.ravel().tolist()) for fold, c in best.items()], T.StructType([*_fields(z, keys), T.StructField("c", T.ArrayType(T.DoubleType()))]))
    labelled = save(z.join(F.broadcast(table), keys).withColumn("k", nearest("c")[0]), "labelled")
    pairs = [(i, j) for i in range(3) for j in range(3)]
    stats, moves = {}, {}
    for r in labelled.groupBy(*keys, "k").agg(F.count("*").alias("n"), F.avg("x1").alias("x1"), F.avg(F.abs("x2")).alias("x2"), *[F.avg(c).alias(c) for c in Z], *[F.covar_samp(Z[i], Z[j]).alias(f"c{i}{j}") for i, j in pairs]).collect():
        stats.setdefault(tuple(r[k] for k in keys), {})[r["k"]] = r
    was = F.lag("k").over(W.partitionBy(*keys, "symbol").orderBy("ts"))
    for r in labelled.withColumn("was", was).where("was is not null").groupBy(*keys, "was", "k").count().collect():
        moves.setdefault(tuple(r[k] for k in keys), np.ones((3, 3)))[r["was"], r["k"]] += r["count"]
    discard(moments, z, labelled)
    made = []
    for fold, of in stats.items():
        stress = max(range(3), key=lambda k: of[k]["x1"])
        trend = max((k for k in range(3) if k != stress), key=lambda k: of[k]["x2"])
        order, n = [3 - stress - trend, trend, stress], sum(r["n"] for r in of.values())
        cov = np.array([(np.array([of[k][f"c{i}{j}"] for i, j in pairs]).reshape(3, 3) if of[k]["n"] > 1 else np.eye(3)) + RIDGE * np.eye(3) for k in order])
        t = moves.get(fold, np.ones((3, 3)))
        t = (t / t.sum(axis=1, keepdims=True))[np.ix_(order, order)]
        at = located[fold]
        arrays = [[at[f"m{i}"] for i in range(3)], [at[f"s{i}"] or 1.0 for i in range(3)], [of[k][c] for k in order for c in Z], cov, np.linalg.inv(cov), np.linalg.slogdet(cov)[1], [(of[k]["n"] + 1) / (n + 3) for k in order], t]
        made.append((*fold, *[np.asarray(a, np.float64).ravel().tolist() for a in arrays]))
    return spark.createDataFrame(made, schema)


def filter_folds(rows: DataFrame, keys: list[str], parameters: DataFrame) -> DataFrame:
    """(keys, symbol, ts, state_p_..., state_label) of rows (keys, symbol, ts, inputs) under their fold's model:
    causal, never smoothed. Rows with a missing input are left out."""
    own = rows.select(*keys, "symbol", "ts", *INPUTS).na.drop().join(F.broadcast(parameters.drop("cov")), keys)  # a row a fold
    z = [(F.col(c) - F.col("location")[i]) / F.col("scale")[i] for i, c in enumerate(INPUTS)]

    def log_density(k: int) -> Column:
        d = [z[i] - F.col("means")[3 * k + i] for i in range(3)]
        terms = [d[i] * d[j] * F.col("precision")[9 * k + 3 * i + j] for i in range(3) for j in range(3)]
        return -0.5 * (sum(terms[1:], terms[0]) + F.col("logdet")[k] + 3 * math.log(2 * math.pi))

    logs = own.select(*keys, "symbol", "ts", "start", "transition", *[log_density(k).alias(f"l{k}") for k in range(3)])
    top = F.greatest("l0", "l1", "l2")
    dense = logs.select(*keys, "symbol", "ts", "start", "transition", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(3)])
    p = filter_scan(dense, [*keys, "symbol"], "ts", ["e0", "e1", "e2"], "start", "transition")
    named = p.select(*keys, "symbol", "ts", *[F.col("posterior")[k].alias(f"state_p_{s}") for k, s in enumerate(STATES)])
    a, b, c = (F.col(f"state_p_{s}") for s in STATES)
    return named.withColumn("state_label", F.when((a >= b) & (a >= c), STATES[0]).when(b >= c, STATES[1]).otherwise(STATES[2]))


def fold_states(rows: DataFrame, keys: list[str], starts: int = STARTS) -> DataFrame:
    """(keys, symbol, ts, state_p_..., state_label): each fold's own model, fitted on its training rows
    and filtered forward over them and its test rows."""
    used = rows.where("part <> 'purge'")
    return filter_folds(used, keys, fit_folds(used, keys, starts))


def fit(train: DataFrame, starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """The parameters of one model of all rows: a table of one row, its key 0."""
    return fit_folds(train.withColumns({"__fold": F.lit(0), "part": F.lit("train")}), ["__fold"], starts, seed)


def forward_filter(frame: DataFrame, parameters: DataFrame) -> DataFrame:
    """(symbol, ts, state_p_range, state_p_trend, state_p_stress, state_label) under one model."""
    return filter_folds(frame.withColumn("__fold", F.lit(0)), ["__fold"], parameters).drop("__fold")


def parameter_text(parameters: DataFrame, keys: list[str]) -> list[tuple[tuple, str, float, float]]:
    """(fold, canonical JSON, least eigenvalue, departure of the transitions from 1) of every model."""
    found = []
    for r in parameters.collect():  # a row a fold
        cov = np.array(r["cov"]).reshape(3, 3, 3)
        eigen = np.linalg.eigvalsh(cov)
        body = {c: r[c] for c in ("location", "scale", "means", "cov", "start", "transition")} | {"eigenvalues": eigen.ravel().tolist()}
        off = np.abs(np.array(r["transition"]).reshape(3, 3).sum(axis=1) - 1).max()
        found.append((tuple(r[k] for k in keys), json.dumps(body, sort_keys=True, separators=(",", ":")), float(eigen.min()), float(off)))
    return found


def interactions(frame: DataFrame, signal: str) -> DataFrame:
    return frame.withColumns({f"{signal}_x_{s}": F.col(signal) * F.col(f"state_p_{s}") for s in STATES})
