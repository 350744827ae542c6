"""Queries of the locked period's evidence and of the lookups around it, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import gates, grids, inference, splits
from tidemark.plans import inputs as N
from tidemark.plans import locked_evidence as L
from tidemark.plans.evidence_queries import SPECS_SQL
from tidemark.plans.oracle import FEATURES, MATCHED, PREDICTIONS, r6, sql

BARRED = ("not-admitted",)  # a registered hypothesis that was not tested


def _ece_sql(name: str) -> str:
    bins = " + ".join(f"abs(sum(CASE WHEN least(CAST(floor({name} * 10) AS INTEGER), 9) = {b} THEN target_up - {name} ELSE 0.0 END))" for b in range(10))
    return f"({bins}) / count(*)"


_MEASURES = {
    "benchmark_log_loss": "avg(benchmark_loss)",
    "candidate_log_loss": "avg(candidate_loss)",
    "incremental_log_loss": "avg(incremental_log_loss)",
    "benchmark_brier": "avg(benchmark_sq)",
    "candidate_brier": "avg(candidate_sq)",
    "benchmark_ece": _ece_sql("benchmark_probability"),
    "candidate_ece": _ece_sql("candidate_probability"),
    "decision_coverage": "avg(CAST(candidate_active AS DOUBLE))",
    "mean_net_edge_active": "coalesce(avg(candidate_net_return) FILTER (candidate_active), 0.0)",
    "cumulative_net_return": "sum(candidate_net_return)",
    "accuracy": "avg(CASE WHEN CAST(candidate_probability >= 0.5 AS INTEGER) = target_up THEN 1.0 ELSE 0.0 END)",
}
_SETS = "me AS (SELECT signal, coalesce(subperiod, 'OVERALL') AS subperiod, count(*) AS rows, count(*) FILTER (candidate_active) AS nonzero_decisions, " + ", ".join(f"{e} AS {n}" for n, e in _MEASURES.items()) + " FROM matched GROUP BY GROUPING SETS ((signal), (signal, subperiod)))"

#: The upper normal tail by the series of the error function, its terms through logarithms of gamma functions.
_TAIL = f"least(1.0, list_sum(list_transform(range(0, 200), lambda n: exp(2 * n * ln(2.0) + (2 * n + 1) * ln(x) - lgamma(2.0 * n + 2) + lgamma(n + 1.0)))) * exp(-x * x) * {2.0 / math.sqrt(math.pi)!r})"
_TEST = f"""t1 AS (SELECT signal, count(*) AS n, any_value(mu) AS mean, sum((g - mu) * (g - mu)) / count(*) / count(*) AS variance FROM (SELECT signal, incremental_log_loss AS g, avg(incremental_log_loss) OVER (PARTITION BY signal) AS mu FROM matched) GROUP BY signal),
t2 AS (SELECT *, mean / sqrt(variance) AS statistic FROM t1),
t3 AS (SELECT *, CASE WHEN x = 0 THEN 0.5 WHEN statistic > 0 THEN (1 - {_TAIL}) / 2 ELSE (1 + {_TAIL}) / 2 END AS p_value FROM (SELECT *, abs(statistic) / sqrt(2.0) AS x FROM t2)),
t4 AS (SELECT name, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS step FROM (SELECT signal AS name, p_value AS p FROM t3 UNION ALL SELECT '{BARRED[0]}', 1.0)),
t5 AS (SELECT name, max(step) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS p_holm FROM t4),
test AS (SELECT t3.*, p_holm FROM t3 JOIN t5 ON name = signal)"""
_CHECKED = f"""{_SETS}, {_TEST},
mo AS (SELECT signal, CASE WHEN max(total) > 0 THEN max(greatest(total, 0)) / sum(greatest(total, 0)) ELSE 1.0 END AS month_share FROM (SELECT signal, strftime(ts, '%Y-%m') AS month, sum(incremental_net_return) AS total FROM matched GROUP BY 1, 2) GROUP BY signal),
pa AS (SELECT signal, count(*) FILTER (incremental_log_loss > 0) AS positive_parts, max(candidate_brier - benchmark_brier) AS worst FROM me WHERE subperiod <> 'OVERALL' GROUP BY signal),
ne AS (SELECT signal, avg(incremental_net_return) AS mean_net_return FROM matched GROUP BY signal)"""
_FLAGS = {
    "positive_mean": "mean > 0",
    "holm_below_alpha": "p_holm < 0.05",
    "enough_positive_parts": "positive_parts >= 2",
    "calibration_gate": "candidate_brier - benchmark_brier <= 0.001 AND candidate_ece - benchmark_ece <= 0.01",
    "positive_net_mean": "mean_net_return > 0",
    "enough_coverage": "decision_coverage >= 0.1",
    "enough_decisions": "nonzero_decisions >= 100",
    "spread_over_months": "month_share <= 0.4",
}
_COSTS = {
    "candidate_coverage": "avg(CAST(ca AS DOUBLE))",
    "benchmark_coverage": "avg(CAST(ba AS DOUBLE))",
    "candidate_turnover": "sum(ct)",
    "benchmark_turnover": "sum(bt)",
    "candidate_gross_return": "sum(cp * future_return)",
    "benchmark_gross_return": "sum(bp * future_return)",
    "candidate_net_return": "sum(cp * future_return - ct * bps / 10000.0)",
    "benchmark_net_return": "sum(bp * future_return - bt * bps / 10000.0)",
    "mean_incremental_net_return": "avg(cp * future_return - ct * bps / 10000.0 - (bp * future_return - bt * bps / 10000.0))",
    "cumulative_incremental_net_return": "sum(cp * future_return - ct * bps / 10000.0 - (bp * future_return - bt * bps / 10000.0))",
}
_SIDE = lambda p: f"CASE WHEN abs({p} - 0.5) > 0.05 THEN CASE WHEN {p} > 0.5 THEN 1.0 ELSE -1.0 END ELSE 0.0 END"

#: The columns that a screen of each family uses, in order.
SCREENING_COLUMNS = {f: [*names, "signal_x_range", "signal_x_trend", "signal_x_stress"] for f, names in {"rsi": ["rsi_signal_score", "rsi_signal_event", "rsi_extreme", "rsi_event_persistence"], "bollinger": ["bb_signal_score", "bb_signal_event", "bb_extreme", "bb_event_persistence"]}.items()}

def signal_specs_of_candidates(spark):
    """The distinct specifications of the whole candidate inventory, their missing parts last."""
    specs = grids.signal_specs(spark).drop("ordinal")
    return grids.candidates(spark).select("spec_id").distinct().join(F.broadcast(specs), "spec_id").orderBy("family", "period", F.asc_nulls_last("lower"), F.asc_nulls_last("width"), "mode")


def plan_lookup(s, d):
    n = N.panel(s, d).count()
    wanted = s.createDataFrame([("outer", h, 5, 0) for h in splits.HORIZONS] + [("inner", 1, 3, 2)], "level string, horizon int, outer_fold int, inner_fold int")
    return L.fold_lookup(splits.nested_plan(s, n), wanted).select("level", "horizon", "outer_fold", "inner_fold", "n_train", "test_start", "test_end")


def state_frame(s, d):
    """Prices and features at the bars that have predictions, with the predictions' regime."""
    regimes = N.predictions(s, d).where("signal = 'combined'").select("ts", "regime", "candidate_probability")
    return N.features(s, d).select("ts", "pri_close", "rsi", "bb_percent_b").join(regimes, "ts")


_PLAN_SQL = """SELECT level, h AS horizon, o AS outer_fold, i AS inner_fold, CAST(start - h AS BIGINT) AS n_train, CAST(start AS BIGINT) AS test_start, CAST(stop - 1 AS BIGINT) AS test_end FROM (
SELECT 'outer' AS level, h, 5 AS o, 0 AS i, n - n // 6 AS start, n AS stop FROM (SELECT unnest([1, 2, 3, 6]) AS h), (SELECT count(*) AS n FROM panel)
UNION ALL SELECT 'inner', 1, 3, 2, m - 2 * (m // 4), m - m // 4 FROM (SELECT n - 3 * (n // 6) - 1 AS m FROM (SELECT count(*) AS n FROM panel)))"""
_text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()

ENTRIES = {
    "agg_locked_measures": (lambda s, d: N.out(L.measures(N.matched(s, d), ["signal"])), sql(f"{MATCHED}, {_SETS}", f"SELECT signal, subperiod, rows, nonzero_decisions, {r6(*_MEASURES)} FROM me")),
    "inf_dm_test": (
        lambda s, d: N.out(inference.predictive_test(N.matched(s, d), ["signal"], "incremental_log_loss", 0, BARRED).withColumn("variance", F.col("variance") * 1e6)),
        sql(f"{MATCHED}, {_TEST}", f"SELECT signal, n, {r6('mean', 'variance', 'statistic', 'p_value', 'p_holm')} FROM (SELECT * REPLACE (variance * 1e6 AS variance) FROM test)"),
    ),
    "gat_locked_checks": (
        lambda s, d: N.out(L.checks(N.matched(s, d), ["signal"], 0, BARRED).select("signal", "p_holm", "brier_gap", "ece_gap", "month_share", "positive_parts", *_FLAGS)),
        sql(f"{MATCHED}, {_CHECKED}", f"SELECT signal, {r6('p_holm', 'brier_gap', 'ece_gap', 'month_share')}, positive_parts, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())} FROM (SELECT *, candidate_brier - benchmark_brier AS brier_gap, candidate_ece - benchmark_ece AS ece_gap FROM test JOIN (SELECT * FROM me WHERE subperiod = 'OVERALL') USING (signal) JOIN pa USING (signal) JOIN ne USING (signal) JOIN mo USING (signal))"),
    ),
    "agg_cost_sensitivity": (
        lambda s, d: N.out(L.cost_sensitivity(N.predictions(s, d), ["signal"], N.PRED_KEYS, 0.05)),
        sql(
            PREDICTIONS,
            f"SELECT signal, bps, rows, candidate_decisions, benchmark_decisions, {r6(*_COSTS)} FROM (SELECT signal, bps, count(*) AS rows, count(*) FILTER (ca) AS candidate_decisions, count(*) FILTER (ba) AS benchmark_decisions, {', '.join(f'{e} AS {n}' for n, e in _COSTS.items())} FROM (SELECT *, abs(cp - lag(cp, 1, 0.0) OVER w) AS ct, abs(bp - lag(bp, 1, 0.0) OVER w) AS bt FROM (SELECT *, {_SIDE('candidate_probability')} AS cp, {_SIDE('benchmark_probability')} AS bp, abs(candidate_probability - 0.5) > 0.05 AS ca, abs(benchmark_probability - 0.5) > 0.05 AS ba FROM pred, (SELECT CAST(unnest([10.0, 5.0, 20.0]) AS DOUBLE) AS bps)) WINDOW w AS (PARTITION BY signal, fold, bps ORDER BY ts)) GROUP BY signal, bps)",
        ),
    ),
    "joi_subperiod_economics": (
        lambda s, d: N.out(L.subperiod_economics(N.matched(s, d), ["signal"])),
        sql(MATCHED, f"SELECT signal, subperiod, rows, {r6('mean_incremental_log_loss', 'mean_incremental_net_return', 'cumulative_incremental_net_return')}, mean_incremental_log_loss > 0 AS positive FROM (SELECT signal, subperiod, count(*) AS rows, avg(incremental_log_loss) AS mean_incremental_log_loss, avg(incremental_net_return) AS mean_incremental_net_return, sum(incremental_net_return) AS cumulative_incremental_net_return FROM matched GROUP BY signal, subperiod)"),
    ),
    "joi_state_frame": (
        lambda s, d: N.out(state_frame(s, d)),
        sql(PREDICTIONS, f"SELECT f.ts AS ts, {r6('pri_close', 'rsi', 'bb_percent_b')}, p.regime AS regime, {r6('candidate_probability')} FROM feat AS f JOIN pred AS p ON f.ts = p.ts AND p.signal = 'combined'"),
    ),
    "joi_fold_lookup": (plan_lookup, sql(FEATURES, _PLAN_SQL)),
    "set_signal_specs": (lambda s, d: signal_specs_of_candidates(s), SPECS_SQL + "SELECT spec_id, family, period, lower, upper, width, mode FROM specs"),
    "prj_screening_columns": (
        lambda s, d: s.createDataFrame([(f, i + 1, c) for f, names in SCREENING_COLUMNS.items() for i, c in enumerate(names)], "family string, place int, column_name string"),
        "SELECT family, CAST(place AS INTEGER) AS place, column_name FROM (VALUES " + ", ".join(f"('{f}', {i + 1}, '{c}')" for f, names in SCREENING_COLUMNS.items() for i, c in enumerate(names)) + ") AS t(family, place, column_name)",
    ),
    "gat_evidence_grade": (
        lambda s, d: N.matched(s, d).groupBy("signal").agg((F.avg("incremental_log_loss") > 0).alias("predictive"), (F.avg("incremental_net_return") > 0).alias("economic")).select("signal", gates.evidence_grade(F.col("predictive")).alias("evidence_grade"), gates.determination(F.col("predictive"), F.col("economic")).alias("determination")),
        sql(MATCHED, f"SELECT signal, CASE WHEN p THEN '{gates.PREDICTIVE_ONLY}' ELSE '{gates.NO_EVIDENCE}' END AS evidence_grade, CASE WHEN NOT p THEN '{gates.DETERMINATIONS[0]}' WHEN NOT e THEN '{gates.DETERMINATIONS[1]}' ELSE '{gates.DETERMINATIONS[2]}' END AS determination FROM (SELECT signal, avg(incremental_log_loss) > 0 AS p, avg(incremental_net_return) > 0 AS e FROM matched GROUP BY signal)"),
    ),
}
