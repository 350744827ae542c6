"""Latent states of the panel, fitted on the first two thirds of its time, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import states
from tidemark.plans import inputs as N
from tidemark.plans import second_generation
from tidemark.plans.oracle import FEATURES, r6, sql
from tidemark.sources.saved import save

STARTS = 3
ROUNDS = 60  # of the twin; the query itself goes on until no centroid moves


TWO_THIRDS = "SELECT min(ts) + to_seconds(CAST(floor((epoch(max(ts)) - epoch(min(ts))) * 2 / 3) AS BIGINT)) AS until"


def state_parameters(s, d):
    f = save(N.features(s, d).select("symbol", "ts", *states.INPUTS), "features")
    p = states.fit(f.where(F.col("ts") <= F.lit(N.two_thirds(f)).cast(f.schema["ts"].dataType)), STARTS)
    row = lambda i, name: F.struct(F.lit(name).alias("state"), *[F.col("means")[3 * i + j].alias(c) for j, c in enumerate(("mean_return", "mean_scale", "mean_trend"))], *[F.col("transition")[3 * i + j].alias(f"to_{k}") for j, k in enumerate(states.STATES)], F.col("start")[i].alias("start"), *[F.col("cov")[9 * i + 4 * j].alias(c) for j, c in enumerate(("var_return", "var_scale", "var_trend"))])
    return N.out(p.select(F.inline(F.array(*[row(i, k) for i, k in enumerate(states.STATES)]))))


def state_filter(s, d):
    f = save(N.features(s, d).select("symbol", "ts", *states.INPUTS), "features")
    return N.out(second_generation.with_states(f, N.two_thirds(f), STARTS).select("ts", *second_generation.STATE_COLUMNS, "state_label"))


def _twin(rounds: int = ROUNDS, starts: int = STARTS) -> str:
    """The model and its rows in SQL: rounds written out, parameters by closed forms."""
    d = lambda k: f"(z0 - c[{3 * k + 1}]) * (z0 - c[{3 * k + 1}]) + (z1 - c[{3 * k + 2}]) * (z1 - c[{3 * k + 2}]) + (z2 - c[{3 * k + 3}]) * (z2 - c[{3 * k + 3}])"
    near = f"(SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS k, least(d0, d1, d2) AS d FROM (SELECT *, {d(0)} AS d0, {d(1)} AS d1, {d(2)} AS d2 FROM sz, {{}}))"
    steps = []
    for i in range(rounds):
        mean = ", ".join(f"coalesce(avg({z}) FILTER (k = {k}), any_value(c)[{3 * k + j + 1}])" for k in range(3) for j, z in enumerate(states.Z))
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT s, [{mean}] AS c FROM {near.format(f'c{i}')} GROUP BY s)")
    last = f"c{rounds}"
    pair = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = ", ".join(f"coalesce(covar_samp(z{i}, z{j}), {float(i == j)}) + {states.RIDGE if i == j else 0.0} AS c{i}{j}" for i, j in pair)
    name = "CASE WHEN k = stress THEN 2 WHEN k = trend THEN 1 ELSE 0 END"
    det = "(c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02))"
    quad = f"((u0 * u0 * (c11 * c22 - c12 * c12) + u1 * u1 * (c00 * c22 - c02 * c02) + u2 * u2 * (c00 * c11 - c01 * c01) + 2 * u0 * u1 * (c02 * c12 - c01 * c22) + 2 * u0 * u2 * (c01 * c12 - c02 * c11) + 2 * u1 * u2 * (c01 * c02 - c00 * c12)) / {det})"
    return (
        FEATURES
        + f""",
sr AS MATERIALIZED (SELECT ts, pri_ret_1 AS x0, vol_20 AS x1, trend_12 AS x2 FROM feat),
sc AS ({TWO_THIRDS} FROM feat),
st AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS rn FROM sr WHERE ts <= (SELECT until FROM sc) AND x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
sm AS MATERIALIZED (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM st),
sz AS MATERIALIZED (SELECT ts, rn, x1, x2, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM st, sm),
c0 AS MATERIALIZED (SELECT s, flatten(list([z0, z1, z2] ORDER BY place)) AS c FROM (SELECT s, z0, z1, z2, row_number() OVER (PARTITION BY s ORDER BY md5('{states.SEED}:' || s || ':' || rn), rn) AS place FROM sz, (SELECT unnest(range({starts})) AS s)) WHERE place <= 3 GROUP BY s),
{", ".join(steps)},
sb AS MATERIALIZED (SELECT s, c FROM {last} JOIN (SELECT s, round(sum(d), 9) AS cost, count(DISTINCT k) AS used FROM {near.format(last)} GROUP BY s) USING (s) WHERE used = 3 ORDER BY cost, s LIMIT 1),
sl AS MATERIALIZED (SELECT ts, x1, x2, z0, z1, z2, k FROM {near.format('sb')}),
sk AS (SELECT k, avg(x1) AS v, avg(abs(x2)) AS t FROM sl GROUP BY k),
sn AS (SELECT (SELECT arg_max(k, v) FROM sk) AS stress, (SELECT arg_max(k, t) FROM sk WHERE k <> (SELECT arg_max(k, v) FROM sk)) AS trend),
sq AS MATERIALIZED (SELECT ts, z0, z1, z2, {name} AS k FROM sl, sn),
sp AS MATERIALIZED (SELECT k, avg(z0) AS e0, avg(z1) AS e1, avg(z2) AS e2, {cov}, (count(*) + 1.0) / ((SELECT count(*) FROM sq) + 3) AS start FROM sq GROUP BY k),
sv AS (SELECT lag(k) OVER (ORDER BY ts) AS was, k FROM sq),
sx AS MATERIALIZED (SELECT a.k AS was, b.k AS k, (1.0 + count(sv.k)) / sum(1.0 + count(sv.k)) OVER (PARTITION BY a.k) AS t FROM sp AS a CROSS JOIN sp AS b LEFT JOIN sv ON sv.was = a.k AND sv.k = b.k GROUP BY a.k, b.k),
su AS (SELECT ts, sp.k AS k, (x0 - m0) / s0 - e0 AS u0, (x1 - m1) / s1 - e1 AS u1, (x2 - m2) / s2 - e2 AS u2, c00, c01, c02, c11, c12, c22, start FROM (SELECT * FROM sr WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), sm, sp),
sd AS (SELECT ts, dense_rank() OVER (ORDER BY ts) AS n, k, -0.5 * ({quad} + ln({det})) AS l FROM su),
se AS MATERIALIZED (SELECT n, ts, [exp(max(l) FILTER (k = 0) - max(l)), exp(max(l) FILTER (k = 1) - max(l)), exp(max(l) FILTER (k = 2) - max(l))] AS e FROM sd GROUP BY n, ts),
sa AS MATERIALIZED (SELECT list(start ORDER BY k) AS p, (SELECT list(t ORDER BY was, k) FROM sx) AS t FROM sp),
sf AS (SELECT n, [p[1] * e[1] / w, p[2] * e[2] / w, p[3] * e[3] / w] AS p FROM (SELECT n, sa.p AS p, e, sa.p[1] * e[1] + sa.p[2] * e[2] + sa.p[3] * e[3] AS w FROM se, sa WHERE n = 1)
  UNION ALL SELECT n, [q[1] / (q[1] + q[2] + q[3]), q[2] / (q[1] + q[2] + q[3]), q[3] / (q[1] + q[2] + q[3])] FROM (SELECT se.n AS n, [(sf.p[1] * t[1] + sf.p[2] * t[4] + sf.p[3] * t[7]) * e[1], (sf.p[1] * t[2] + sf.p[2] * t[5] + sf.p[3] * t[8]) * e[2], (sf.p[1] * t[3] + sf.p[2] * t[6] + sf.p[3] * t[9]) * e[3]] AS q FROM sf JOIN se ON se.n = sf.n + 1, sa))"""
    )


_FILTERED = "SELECT feat.ts AS ts, p[1] AS state_p_range, p[2] AS state_p_trend, p[3] AS state_p_stress, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 'range' WHEN p[2] >= p[3] THEN 'trend' WHEN p IS NOT NULL THEN 'stress' END AS state_label FROM feat LEFT JOIN se ON se.ts = feat.ts LEFT JOIN sf ON sf.n = se.n"
_PARAMETERS = "SELECT ['range', 'trend', 'stress'][k + 1] AS state, e0 AS mean_return, e1 AS mean_scale, e2 AS mean_trend, t[3 * k + 1] AS to_range, t[3 * k + 2] AS to_trend, t[3 * k + 3] AS to_stress, start, c00 AS var_return, c11 AS var_scale, c22 AS var_trend FROM sp, sa"

ENTRIES = {
    "sta_parameters": (state_parameters, sql(_twin(), f"SELECT state, {r6('mean_return', 'mean_scale', 'mean_trend', 'to_range', 'to_trend', 'to_stress', 'start', 'var_return', 'var_scale', 'var_trend')} FROM ({_PARAMETERS})")),
    "sta_filter": (state_filter, sql(_twin(), f"SELECT ts, {r6('state_p_range', 'state_p_trend', 'state_p_stress')}, state_label FROM ({_FILTERED})")),
}
