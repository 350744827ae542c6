"""One-step screens from given benchmark probabilities, isotonic maps and spline columns, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import curves, newton
from tidemark.plans import evidence_queries, second_generation
from tidemark.plans import inputs as N
from tidemark.plans.oracle import FEATURES, PREDICTIONS, r6, sql
from tidemark.sources.saved import save

FLAGS = ["regime_range", "regime_trend", "regime_stress"]
FOLDS = (2, 3, 4, 5)


def step_screens(s, d):
    """All 84 specifications on four expanding folds, from a benchmark that reads the trend alone."""
    scores = save(evidence_queries.scores(s, d).select("symbol", "ts", "spec_id", "score"), "scores")
    rows = N.features(s, d).where("trend_12 is not null and target_up is not null").select("symbol", "ts", *FLAGS, "target_up", (1.0 / (1.0 + F.exp(10.0 * F.col("trend_12")))).alias("p0"))
    rows = rows.join(second_generation.complete_scores(scores), ["symbol", "ts"]).withColumn("fifth", F.ntile(5).over(W.partitionBy("symbol").orderBy("ts")))
    folds = save(rows.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in FOLDS]))).where("fifth <= fold").withColumn("part", F.when(F.col("fifth") < F.col("fold"), "train").otherwise("test")), "folds")
    return N.out(newton.offset_screens(newton.enough(folds, ["fold"], "target_up"), ["fold"], scores, "p0", FLAGS, "target_up"))


def _screen_sql(k: int = 4, ridge: float = 1.0) -> str:
    """The same sums, an elimination written out column by column, and the test rows' losses."""
    size, d = k + 1, ["1.0", *[f"d{i}" for i in range(1, k + 1)]]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [f"sum(w * {d[i]} * {d[j]}) AS h{i}{j}" for i, j in pairs] + [f"sum((target_up - p0) * {d[i]}) AS g{i}" for i in range(size)]
    sums += [f"avg(d{i}) AS m{i}" for i in range(1, size)] + [f"CASE WHEN stddev_pop(d{i}) > 0 THEN stddev_pop(d{i}) ELSE 1.0 END AS s{i}" for i in range(1, size)]
    first = []
    for i, j in pairs:
        v = "h00" if j == 0 else f"(h0{j} - m{j} * h00) / s{j}" if i == 0 else f"(h{i}{j} - m{i} * h0{j} - m{j} * h0{i} + m{i} * m{j} * h00) / (s{i} * s{j}) + {ridge if i == j else 0.0}"
        first.append(f"{v} AS a{i}{j}")
    first += ["g0 AS y0"] + [f"(g{i} - m{i} * g0) / s{i} AS y{i}" for i in range(1, size)]
    scale = ", ".join(f"m{i}, s{i}" for i in range(1, size))
    steps = [f"l0 AS (SELECT fold, spec_id, {scale}, {', '.join(first)} FROM ls)"]
    for p in range(size - 1):
        new = [f"a{i}{j} - a{p}{i} / a{p}{p} * a{p}{j} AS a{i}{j}" for i in range(p + 1, size) for j in range(i, size)] + [f"y{i} - a{p}{i} / a{p}{p} * y{p} AS y{i}" for i in range(p + 1, size)]
        old = [f"a{i}{j}" for i in range(p + 1) for j in range(i, size)] + [f"y{i}" for i in range(p + 1)]
        steps.append(f"l{p + 1} AS (SELECT fold, spec_id, {scale}, {', '.join(old + new)} FROM l{p})")
    last = f"l{size - 1}"
    for i in reversed(range(size)):
        rest = "".join(f" - a{i}{j} * b{j}" for j in range(i + 1, size))
        steps.append(f"e{i} AS (SELECT *, (y{i}{rest}) / a{i}{i} AS b{i} FROM {last})")
        last = f"e{i}"
    shift = "b0" + "".join(f" + b{i} * (d{i} - m{i}) / s{i}" for i in range(1, size))
    loss = lambda p: f"-(target_up * ln(greatest({p}, 1e-9)) + (1 - target_up) * ln(greatest(1 - {p}, 1e-9)))"
    chain = (
        evidence_queries.spec_chain(FEATURES)
        + f""",
lw AS (SELECT ts FROM s WHERE score IS NOT NULL GROUP BY ts HAVING count(*) = 84),
lr AS (SELECT ts, regime_range, regime_trend, regime_stress, target_up, 1.0 / (1.0 + exp(10.0 * trend_12)) AS p0, ntile(5) OVER (ORDER BY ts) AS fifth FROM feat SEMI JOIN lw USING (ts) WHERE trend_12 IS NOT NULL AND target_up IS NOT NULL),
lf AS MATERIALIZED (SELECT *, fifth < fold AS train FROM lr, (SELECT unnest([{', '.join(map(str, FOLDS))}]) AS fold) WHERE fifth <= fold),
lg AS (SELECT fold FROM lf GROUP BY fold HAVING count(*) FILTER (train) >= 120 AND count(*) FILTER (NOT train) >= 20 AND count(DISTINCT target_up) FILTER (train) = 2),
lj AS MATERIALIZED (SELECT lf.*, spec_id, score AS d1, score * regime_range AS d2, score * regime_trend AS d3, score * regime_stress AS d4, greatest(p0 * (1 - p0), 1e-6) AS w FROM lf SEMI JOIN lg USING (fold) JOIN s USING (ts)),
ls AS (SELECT fold, spec_id, {', '.join(sums)} FROM lj WHERE train GROUP BY fold, spec_id),
{', '.join(steps)},
lt AS (SELECT *, 1.0 / (1.0 + exp(-(ln(p0 / (1 - p0)) + {shift}))) AS p1 FROM lj JOIN {last} USING (fold, spec_id) WHERE NOT train)"""
    )
    return sql(chain, f"SELECT fold, spec_id, n_test, {r6('incremental_log_loss', 'candidate_brier', 'benchmark_brier')} FROM (SELECT fold, spec_id, count(*) AS n_test, avg({loss('p0')} - {loss('p1')}) AS incremental_log_loss, avg((p1 - target_up) * (p1 - target_up)) AS candidate_brier, avg((p0 - target_up) * (p0 - target_up)) AS benchmark_brier FROM lt GROUP BY fold, spec_id)")


def isotonic(s, d):
    """Each signal's probabilities of the last two folds, mapped by the isotonic map of the first three."""
    pred = save(N.predictions(s, d).select("signal", "fold", "ts", "candidate_probability", "target_up"), "pred")
    blocks = save(curves.isotonic_blocks(pred.where("fold <= 3"), ["signal"], "candidate_probability", "target_up"), "blocks")
    late = pred.where("fold > 3").select("signal", "fold", "ts", "candidate_probability")
    return N.out(curves.isotonic_map(late, ["signal"], "candidate_probability", blocks))


#: The map by its min-max formula: at each point the greatest, over where a stretch may begin, of the least mean of a stretch that reaches the point.
ISOTONIC = (
    PREDICTIONS
    + """,
ip AS MATERIALIZED (SELECT signal, p, row_number() OVER w AS i, sum(w) OVER w AS cw, sum(s) OVER w AS cs, w, s FROM (SELECT signal, candidate_probability AS p, count(*) AS w, sum(target_up) AS s FROM pred WHERE fold <= 3 GROUP BY ALL) WINDOW w AS (PARTITION BY signal ORDER BY p ROWS UNBOUNDED PRECEDING)),
im AS (SELECT a.signal AS signal, a.i AS j, b.i AS i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.signal, a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM ip AS a JOIN ip AS b ON a.signal = b.signal AND b.i >= a.i),
iv AS MATERIALIZED (SELECT ip.signal AS signal, p, v, lead(p) OVER w AS p2, lead(v) OVER w AS v2 FROM ip JOIN (SELECT signal, i, max(m) AS v FROM im GROUP BY signal, i) AS q ON q.signal = ip.signal AND q.i = ip.i WINDOW w AS (PARTITION BY ip.signal ORDER BY p)),
iq AS (SELECT l.signal AS signal, fold, ts, candidate_probability, least(greatest(CASE WHEN v IS NULL THEN first WHEN p2 IS NULL THEN v ELSE v + (v2 - v) * (candidate_probability - p) / (p2 - p) END, 1e-9), 1 - 1e-9) AS calibrated
       FROM (SELECT * FROM pred WHERE fold > 3) AS l ASOF LEFT JOIN iv ON l.signal = iv.signal AND l.candidate_probability >= iv.p JOIN (SELECT signal, arg_min(v, p) AS first FROM iv GROUP BY signal) AS f ON f.signal = l.signal)"""
)


def splines(s, d):
    """Spline columns of a score on the later fifths of the panel, with knots over the fifths before."""
    rows = N.features(s, d).where("bb_reversal_score is not null").select("symbol", "ts", F.col("bb_reversal_score").alias("x"))
    rows = save(rows.withColumn("fifth", F.ntile(5).over(W.partitionBy("symbol").orderBy("ts"))), "rows")
    folds = rows.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in FOLDS]))).where("fifth <= fold")
    ends = folds.where("fifth < fold").groupBy("fold").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    tested = folds.where("fifth = fold").join(F.broadcast(ends), "fold")  # a row a fold
    placed = tested.withColumn("place", curves.spline_place(F.col("x"), F.col("low"), F.col("high"), 4))
    return N.out(placed.select("fold", "ts", *[c.alias(f"b{j}") for j, c in enumerate(curves.spline_columns(F.col("place"), 4), 1)]))


def _spline_sql(knots: int = 4) -> str:
    """The columns by the recursion over degrees, on lists."""
    t = "list_transform(range(0, " + str(knots + 6) + "), lambda j: low + step * (j - 3))"
    chain = (
        FEATURES
        + f""",
zr AS (SELECT ts, bb_reversal_score AS x, ntile(5) OVER (ORDER BY ts) AS fifth FROM feat WHERE bb_reversal_score IS NOT NULL),
zf AS MATERIALIZED (SELECT * FROM zr, (SELECT unnest([{', '.join(map(str, FOLDS))}]) AS fold) WHERE fifth <= fold),
ze AS (SELECT fold, low, high, (high - low) / {knots - 1} AS step FROM (SELECT fold, min(x) AS low, max(x) AS high FROM zf WHERE fifth < fold GROUP BY fold)),
z0 AS (SELECT fold, ts, least(greatest(x, low), high - (high - low) * 1e-12) AS x, {t} AS t FROM zf JOIN ze USING (fold) WHERE fifth = fold),
y0 AS (SELECT *, list_transform(range(1, len(t)), lambda j: CASE WHEN x >= t[j] AND x < t[j + 1] THEN 1.0 ELSE 0.0 END) AS b FROM z0),
"""
        + ", ".join(f"y{k} AS (SELECT * REPLACE (list_transform(range(1, len(b)), lambda j: (x - t[j]) / (t[j + {k}] - t[j]) * b[j] + (t[j + {k + 1}] - x) / (t[j + {k + 1}] - t[j + 1]) * b[j + 1]) AS b) FROM y{k - 1})" for k in (1, 2, 3))
    )
    columns = ", ".join(f"b[{j + 1}] AS b{j}" for j in range(1, knots + 2))
    return sql(chain, f"SELECT fold, ts, {r6(*[f'b{j}' for j in range(1, knots + 2)])} FROM (SELECT fold, ts, {columns} FROM y3)")


ENTRIES = {
    "mod_isotonic": (isotonic, sql(ISOTONIC, f"SELECT signal, fold, ts, {r6('candidate_probability', 'calibrated')} FROM iq")),
    "mod_spline_basis": (splines, _spline_sql()),
    "mod_screen_step": (step_screens, _screen_sql()),
}
