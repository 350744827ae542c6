"""Splits, grids, metrics, policies, evidence tables, inference, selections and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.indicators import flag, full, relative_strengths
from tidemark.operators import drift, gates, grids, inference, policy, selectors, splits, summaries
from tidemark.plans import inputs as N
from tidemark.plans.oracle import BARS, MATCHED, OUTER, PREDICTIONS, r6, sql
from tidemark.sources.bars import by_time
from tidemark.sources.saved import save

KEYS = N.PRED_KEYS


def _literal(rows: list[tuple], names: str) -> str:
    """A SQL table of literal rows."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names}))"


#: Five folds with a gap of six rows over the panel's own number of bars.
_FOLDS = "(SELECT fold, 0 AS train_start, s - 7 AS train_end, s AS test_start, CASE WHEN fold = 5 THEN n - 1 ELSE s + n // 6 - 1 END AS test_end FROM (SELECT k AS fold, n, n - (6 - k) * (n // 6) AS s FROM (SELECT count(*) AS n FROM panel), (SELECT unnest([1, 2, 3, 4, 5]) AS k)))"


def _nested_sql() -> str:
    outer = "SELECT h, o, n - (5 - o + 1) * size AS start, CASE WHEN o = 5 THEN n ELSE n - (5 - o) * size END AS stop FROM (SELECT unnest([1, 2, 3, 6]) AS h), (SELECT unnest([1, 2, 3, 4, 5]) AS o), (SELECT n, n // 6 AS size FROM (SELECT count(*) AS n FROM bars WHERE symbol = 'PRI'))"
    inner = "SELECT h, o, i, m - (3 - i + 1) * (m // 4) AS start, CASE WHEN i = 3 THEN m ELSE m - (3 - i) * (m // 4) END AS stop FROM (SELECT h, o, start - h AS m FROM o), (SELECT unnest([1, 2, 3]) AS i)"
    cols = "CAST(h AS INTEGER) AS horizon, CAST(o AS INTEGER) AS outer_fold"
    tail = "CAST(start - h AS BIGINT) AS n_train, CAST(start AS BIGINT) AS test_start, CAST(stop - 1 AS BIGINT) AS test_end, CAST(stop - start AS BIGINT) AS n_test"
    return sql(f"{BARS}, o AS ({outer}), i AS ({inner})", f"SELECT 'outer' AS level, {cols}, 0 AS inner_fold, {tail} FROM o UNION ALL SELECT 'inner', {cols}, CAST(i AS INTEGER), {tail} FROM i")


SPECS_SQL = """WITH r AS (SELECT 'rsi' AS family, p, t[1] AS lo, t[2] AS hi, NULL AS k, m, 'rsi-p' || p || '-l' || t[1] || '-u' || t[2] || '-' || m AS spec_id FROM (SELECT unnest([7, 14, 21, 28]) AS p), (SELECT unnest([[20, 80], [25, 75], [30, 70], [35, 65]]) AS t), (SELECT unnest(['continuous', 'contrarian', 'continuation']) AS m)),
b AS (SELECT 'bollinger' AS family, p, NULL AS lo, NULL AS hi, k, m, 'bollinger-p' || p || '-k' || replace(k, '.0', '') || '-' || m AS spec_id FROM (SELECT unnest([10, 20, 30, 40]) AS p), (SELECT unnest(['1.5', '2.0', '2.5']) AS k), (SELECT unnest(['continuous', 'contrarian', 'continuation']) AS m)),
specs AS (SELECT family, p AS period, CAST(lo AS DOUBLE) AS lower, CAST(hi AS DOUBLE) AS upper, CAST(k AS DOUBLE) AS width, m AS mode, spec_id FROM r UNION ALL SELECT family, p, CAST(lo AS DOUBLE), CAST(hi AS DOUBLE), CAST(k AS DOUBLE), m, spec_id FROM b)
"""


def scores(s, d):
    return spec_scores(N.panel(s, d))


def spec_scores(panel):
    """(symbol, ts, spec_id, score, event): every signal specification's score and event at every bar: 4 + 4 frames and indexes, not 84.

    Events are crossings of the specification's own thresholds or bands: 1 from below the lower one, -1
    above the upper one; continuation turns the sign of a contrarian one, continuous ones have none.
    """
    p = panel.select("symbol", "ts", "pri_close")
    c, w = F.col("pri_close"), by_time()
    for n in grids.BB_PERIODS:
        p = p.withColumns({f"m{n}": full(F.avg(c), c, n), f"s{n}": full(F.stddev_pop(c), c, n)})
    p = relative_strengths(p, {f"rsi{n}": n for n in grids.RSI_PERIODS})
    entry = lambda family, n, k, raw, value, event: F.struct(F.lit(family).alias("family"), F.lit(n).alias("period"), F.lit(k).cast("double").alias("w"), raw.alias("raw"), value.alias("value"), F.lag(value).over(w).alias("was"), event.alias("crossing"))
    rsi = [entry("rsi", n, None, (F.col(f"rsi{n}") - 50.0) / 50.0, F.col(f"rsi{n}"), F.lit(None).cast("double")) for n in grids.RSI_PERIODS]
    bb = []
    for n in grids.BB_PERIODS:
        for k in grids.BB_WIDTHS:
            low, up = F.col(f"m{n}") - k * F.col(f"s{n}"), F.col(f"m{n}") + k * F.col(f"s{n}")
            was = lambda x: F.lag(x).over(w)
            crossing = flag((c < low) & (was(c) >= was(low))) - flag((c > up) & (was(c) <= was(up)))
            bb.append(entry("bollinger", n, k, (c - low) / F.nullif(2 * k * F.col(f"s{n}"), F.lit(0.0)) - 0.5, c, crossing))
    long = p.select("symbol", "ts", F.array(*rsi, *bb).alias("every")).select("symbol", "ts", F.inline("every"))
    joined = long.join(F.broadcast(grids.signal_specs(panel.sparkSession).drop("ordinal")), ["family", "period"]).where(F.col("width").eqNullSafe(F.col("w")))
    v, was, low, up = (F.col(x) for x in ("value", "was", "lower", "upper"))
    event = F.coalesce("crossing", flag((v < low) & (was >= low)) - flag((v > up) & (was <= up)))
    sign = lambda a, b, other: F.when(F.col("mode") == "contrarian", a).when(F.col("mode") == "continuation", b).otherwise(other)
    return joined.select("symbol", "ts", "spec_id", sign(-F.col("raw"), F.col("raw"), F.col("raw")).alias("score"), sign(event, -event, F.lit(0.0)).alias("event"))


def spec_chain(base: str = BARS) -> str:
    """Tables of all specifications' scores and events in SQL: s (spec_id, ts, score, event)."""
    bands = " UNION ALL ".join(f"SELECT {n} AS p, rn, c, CASE WHEN rn >= {n} THEN avg(c) OVER (ORDER BY rn ROWS {n - 1} PRECEDING) END AS mid, CASE WHEN rn >= {n} THEN stddev_pop(c) OVER (ORDER BY rn ROWS {n - 1} PRECEDING) END AS sd FROM m" for n in grids.BB_PERIODS)
    one = lambda test: f"CASE WHEN coalesce({test}, false) THEN 1.0 ELSE 0.0 END"
    return f"""{base}, {SPECS_SQL.strip()[5:]},
m AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, pri_close AS c, pri_close - lag(pri_close) OVER (ORDER BY ts) AS move FROM panel),
ew4 AS (SELECT p, rn, greatest(move, 0.0) AS g, greatest(-move, 0.0) AS l FROM m, (SELECT unnest({list(grids.RSI_PERIODS)}) AS p) WHERE rn = 2 UNION ALL SELECT p, m.rn, g + (greatest(m.move, 0.0) - g) / p, l + (greatest(-m.move, 0.0) - l) / p FROM ew4 JOIN m ON m.rn = ew4.rn + 1),
rs AS (SELECT *, lag(v) OVER (PARTITION BY p ORDER BY rn) AS was FROM (SELECT p, rn, CASE WHEN rn > p THEN greatest(0.0, least(100.0, 100.0 - 100.0 / (1.0 + g / nullif(l, 0.0)))) END AS v FROM ew4)),
bw AS (SELECT *, mid + k * sd AS up, mid - k * sd AS lo FROM ({bands}), (SELECT CAST(unnest({list(grids.BB_WIDTHS)}) AS DOUBLE) AS k)),
be AS (SELECT p, k, rn, (c - lo) / nullif(2 * k * sd, 0.0) - 0.5 AS raw, {one('c < lo AND lag(c) OVER w >= lag(lo) OVER w')} - {one('c > up AND lag(c) OVER w <= lag(up) OVER w')} AS e FROM bw WINDOW w AS (PARTITION BY p, k ORDER BY rn)),
every AS (SELECT spec_id, mode, rn, (v - 50.0) / 50.0 AS raw, {one('v < lower AND was >= lower')} - {one('v > upper AND was <= upper')} AS e FROM specs JOIN rs ON family = 'rsi' AND period = p UNION ALL SELECT spec_id, mode, rn, raw, e FROM specs JOIN be ON family = 'bollinger' AND period = p AND width = k),
s AS (SELECT spec_id, m.ts AS ts, CASE WHEN mode = 'contrarian' THEN -raw ELSE raw END AS score, CASE mode WHEN 'contrarian' THEN e WHEN 'continuation' THEN -e ELSE 0 END AS event FROM every JOIN m USING (rn))"""


def _spec_scores_sql() -> str:
    return sql(spec_chain(), f"SELECT spec_id, n, {r6('mean_score', 'least', 'most')}, long_events, short_events FROM (SELECT spec_id, count(score) AS n, avg(score) AS mean_score, min(score) AS least, max(score) AS most, count(*) FILTER (event > 0) AS long_events, count(*) FILTER (event < 0) AS short_events FROM s GROUP BY spec_id)")


def inner_rows(s, d):
    """Per signal and fold, four stand-in settings with gains, scores, coverage: selector input."""
    m = N.matched(s, d)
    base = m.groupBy("signal", "fold").agg(F.avg("incremental_log_loss").alias("g"), F.avg("candidate_sq").alias("candidate_brier"), F.avg("benchmark_sq").alias("benchmark_brier"), F.avg(F.col("candidate_active").cast("double")).alias("coverage"), F.count_if("candidate_active").alias("nonzero_decisions"), F.avg("candidate_net_return").alias("edge"))
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")
    return base.select("signal", "fold", k, "g", "candidate_brier", "benchmark_brier", "coverage", "nonzero_decisions", "edge")


INNER = MATCHED + """,
inner_rows AS (SELECT signal, fold, k, avg(incremental_log_loss) AS g, avg(candidate_sq) AS candidate_brier, avg(benchmark_sq) AS benchmark_brier, avg(CAST(candidate_active AS DOUBLE)) AS coverage, CAST(sum(CAST(candidate_active AS INTEGER)) AS BIGINT) AS nonzero_decisions, avg(candidate_net_return) AS edge FROM matched, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY signal, fold, k)"""


def screening_rows(s, d):
    r = inner_rows(s, d)
    return r.select("signal", F.concat(F.lit("spec-"), F.col("k")).alias("signal_spec_id"), F.col("fold").alias("inner_fold"), (F.col("g") + 0.001 * ((F.col("k") + F.col("fold")) % 3)).alias("incremental_log_loss"), (F.col("candidate_brier") + 0.001 * F.col("k")).alias("candidate_brier"), "benchmark_brier", F.lit(0.05).alias("candidate_ece"), F.lit(0.04).alias("benchmark_ece"), (4 - F.col("k")).alias("complexity_rank"))


def structural_rows(s, d):
    return screening_rows(s, d).withColumnRenamed("signal_spec_id", "pipeline_id")


def calibration_rows(s, d):
    r = screening_rows(s, d).where("signal_spec_id <> 'spec-3'")
    name = F.element_at(F.array(F.lit("none"), F.lit("sigmoid"), F.lit("isotonic")), F.substring("signal_spec_id", 6, 1).cast("int") + 1)
    return r.withColumn("calibration_method", name).withColumn("eligible_for_selection", F.col("calibration_method") != "isotonic")


def policy_rows(s, d):
    r = inner_rows(s, d)
    t = F.element_at(F.array(*[F.lit(x) for x in grids.THRESHOLDS]), F.col("k") + 1)
    return r.select("signal", F.col("fold").alias("inner_fold"), t.alias("threshold"), (F.col("coverage") / (1 + F.col("k"))).alias("coverage"), F.floor(F.col("nonzero_decisions") / (1 + F.col("k"))).alias("nonzero_decisions"), (F.col("edge") * (1 + F.col("k"))).alias("mean_net_edge"))


_SCREEN = "(SELECT signal, 'spec-' || k AS id, fold AS inner_fold, g + 0.001 * ((k + fold) % 3) AS gain, candidate_brier + 0.001 * k AS cb, benchmark_brier AS bb, 4 - k AS complexity_rank, k FROM inner_rows)"
_SEL = "count(*) AS evaluation_rows, avg(gain) AS mean_incremental_log_loss, coalesce(stddev_samp(gain) / sqrt(count(*)), 0) AS standard_error, count(*) FILTER (gain > 0) AS positive_inner_folds"


def state_rows(s, d):
    return N.matched(s, d)


def diagnostics(s, d):
    """One row per signal and check, in place of recorded verdicts."""
    f = gates.admission(N.outer_rows(s, d))
    c = F.col
    rows = F.array(
        F.struct(F.lit("gain").alias("diagnostic"), F.when(c("mean_incremental_log_loss") > 0, "PASS").otherwise("FAIL").alias("status")),
        F.struct(F.lit("concentration").alias("diagnostic"), F.when(c("concentration") <= 0.6, "PASS").otherwise("CAUTION").alias("status")),
        F.struct(F.lit("calibration").alias("diagnostic"), F.when(c("mean_candidate_ece") <= c("mean_benchmark_ece") + 0.02, "PASS").otherwise("FAIL").alias("status")),
    )
    return f.select("signal_family", "horizon", F.inline(rows))


_FAM = "FROM (SELECT signal_family, horizon, count(DISTINCT outer_fold) AS outer_folds, avg(incremental_log_loss) AS mean_incremental_log_loss, coalesce(stddev_samp(incremental_log_loss) / sqrt(count(*)), 0) AS standard_error, count(*) FILTER (incremental_log_loss > 0) AS positive_outer_folds, coalesce(max(greatest(incremental_log_loss, 0)) / nullif(sum(greatest(incremental_log_loss, 0)), 0), 1.0) AS concentration, avg(candidate_brier) AS mean_candidate_brier, avg(benchmark_brier) AS mean_benchmark_brier, avg(candidate_ece) AS mean_candidate_ece, avg(benchmark_ece) AS mean_benchmark_ece, avg(policy_coverage) AS mean_policy_coverage, avg(policy_mean_net_edge) AS mean_policy_mean_net_edge, CAST(sum(policy_nonzero_decisions) AS BIGINT) AS total_decisions FROM outer_rows GROUP BY signal_family, horizon)"
_FAM_COLS = f"signal_family, horizon, outer_folds, positive_outer_folds, total_decisions, {r6('mean_incremental_log_loss', 'standard_error', 'concentration', 'mean_candidate_brier', 'mean_benchmark_brier', 'mean_candidate_ece', 'mean_benchmark_ece', 'mean_policy_coverage', 'mean_policy_mean_net_edge')}"
_PRE = "mean_incremental_log_loss > 0 AND positive_outer_folds >= 3 AND concentration <= 0.6"
_CHECKS = {"COMPLETE_OUTER_FOLDS": "outer_folds = 5", "POSITIVE_MEAN_INCREMENTAL_LOG_LOSS": "mean_incremental_log_loss > 0", "MINIMUM_POSITIVE_OUTER_FOLDS": "positive_outer_folds >= 3", "FOLD_CONCENTRATION_CONTROL": "concentration <= 0.6", "BRIER_NON_DOMINANCE": "mean_candidate_brier <= mean_benchmark_brier + 0.0025", "ECE_NON_DOMINANCE": "mean_candidate_ece <= mean_benchmark_ece + 0.02", "MINIMUM_POLICY_COVERAGE": "mean_policy_coverage >= 0.1", "MINIMUM_POLICY_DECISIONS": "total_decisions >= 100"}
_FAILS = "concat_ws('|', " + ", ".join(f"CASE WHEN NOT ({e}) THEN '{n}' END" for n, e in _CHECKS.items()) + ")"


def fold_assignment(s, d):
    """Folds planned over all of the panel's bars."""
    panel = save(N.panel(s, d).select("symbol", "ts"), "panel")
    return splits.assign(panel, splits.fold_table(s, panel.count(), 5, 6)).groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def rolling_edge(s, d):
    """The window follows the greatest number of rows of a signal."""
    p = save(N.predictions(s, d).select("signal", "ts", "incremental_net_edge"), "predictions")
    n = p.groupBy("signal").count().agg(F.max("count")).first()[0] or 0
    return N.out(summaries.rolling_edge(p, ["signal"], "incremental_net_edge", n).select("signal", "ts", "rolling_incremental_net_edge"))


COSTS = [(10.0,), (5.0,), (20.0,)]
def share_tests(s, d):
    """(name, p_value): of every signal and fold, the share of its rows that gain nothing."""
    gains = N.predictions(s, d).groupBy("signal", "fold").agg(((F.count_if(F.col("incremental_log_loss") <= 0) + 1) / (F.count("*") + 1)).alias("p_value"))
    return gains.select(F.concat_ws("|", "signal", F.col("fold").cast("string")).alias("name"), "p_value")


def unknown_ids(s, d):
    """Specification ids that events name and the grid does not have."""
    named = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("rsi-p"), (F.col("event_id") % 6 * 7).cast("string"), F.lit("-l30-u70-"), F.element_at(F.array(*[F.lit(m) for m in (*grids.MODES, "unheard")]), (F.col("event_id") % 4 + 1).cast("int"))).alias("spec_id"))
    return named.distinct().join(grids.signal_specs(s).select("spec_id"), "spec_id", "left_anti")


ENTRIES = {
    "spl_expanding_folds": (lambda s, d: splits.fold_table(s, N.panel(s, d).count(), 5, 1), sql(BARS, f"SELECT CAST(fold AS INTEGER) AS fold, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('train_start', 'train_end', 'purge_start', 'purge_end', 'test_start', 'test_end'))} FROM (SELECT f AS fold, 0 AS train_start, s - 2 AS train_end, s - 1 AS purge_start, s - 1 AS purge_end, s AS test_start, CASE WHEN f = 5 THEN n - 1 ELSE s + n // 6 - 1 END AS test_end FROM (SELECT f, n, n - (6 - f) * (n // 6) AS s FROM (SELECT count(*) AS n FROM panel), (SELECT unnest([1, 2, 3, 4, 5]) AS f)))")),
    "spl_nested_plan": (lambda s, d: splits.nested_plan(s, N.index(s, d).where("symbol = 'PRI'").count()), _nested_sql()),
    "joi_fold_assignment": (
        fold_assignment,
        sql(BARS, f"SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN rn <= train_end THEN 'train' WHEN rn < test_start THEN 'purge' ELSE 'test' END AS part, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM panel) JOIN {_FOLDS} ON rn BETWEEN train_start AND test_end GROUP BY 1, 2"),
    ),
    "spl_calibration": (lambda s, d: splits.calibration_split(N.panel(s, d).select("symbol", "ts"), 6).groupBy("part").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts")), sql(BARS, "SELECT CASE WHEN back <= size THEN 'calibrate' WHEN back <= size + 6 THEN 'purge' ELSE 'fit' END AS part, count(*) AS rows, min(ts) AS first_ts FROM (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS back, greatest(60, floor(count(*) OVER () * 0.2)) AS size FROM panel) GROUP BY 1")),
    "grid_signal_specs": (lambda s, d: grids.signal_specs(s).drop("ordinal"), SPECS_SQL + "SELECT * FROM specs"),
    "grid_candidates": (
        lambda s, d: grids.candidates(s).groupBy("family", "horizon", "model", "window", "calibration").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_id"), F.max("candidate_id").alias("last_id")),
        SPECS_SQL
        + ", g AS (SELECT *, row_number() OVER (ORDER BY o, hi, mi, wi, ci) AS k FROM (SELECT *, row_number() OVER () AS o FROM (SELECT * FROM specs ORDER BY family DESC, period, lower, width, CASE mode WHEN 'continuous' THEN 0 WHEN 'contrarian' THEN 1 ELSE 2 END)), (SELECT unnest([1, 2, 3, 6]) AS horizon, unnest([0, 1, 2, 3]) AS hi), (SELECT unnest(['regularized_linear', 'spline_regularized', 'shallow_boosting']) AS model, unnest([0, 1, 2]) AS mi), (SELECT unnest(['expanding', 'rolling_1y', 'rolling_2y']) AS \"window\", unnest([0, 1, 2]) AS wi), (SELECT unnest(['none', 'sigmoid']) AS calibration, unnest([0, 1]) AS ci)) SELECT family, horizon, model, \"window\", calibration, count(*) AS n, 'v2-candidate-' || lpad(CAST(min(k) AS VARCHAR), 5, '0') AS first_id, 'v2-candidate-' || lpad(CAST(max(k) AS VARCHAR), 5, '0') AS last_id FROM g GROUP BY ALL",
    ),
    "grid_parsed_specs": (lambda s, d: grids.signal_specs(s).select("spec_id", grids.parsed_spec(F.col("spec_id")).alias("x")).select("spec_id", "x.*"), SPECS_SQL + "SELECT spec_id, period, width, mode FROM specs"),
    "grid_structural": (lambda s, d: grids.structures(s).groupBy("model", "window", "regime_conditioned").agg(F.count("*").alias("n"), F.min("complexity_rank").alias("first_rank")), "WITH m AS (SELECT unnest(['linear', 'linear', 'linear', 'spline', 'spline', 'spline', 'spline', 'boosting', 'boosting', 'boosting', 'boosting', 'boosting', 'boosting', 'boosting', 'boosting']) AS model, unnest(generate_series(0, 14)) AS i), g AS (SELECT model, \"window\", r = 1 AS regime_conditioned, i * 6 + w * 2 + r + 1 AS rank FROM m, (SELECT unnest(['expanding', 'rolling_1y', 'rolling_2y']) AS \"window\", unnest([0, 1, 2]) AS w), (SELECT unnest([0, 1]) AS r)) SELECT model, \"window\", regime_conditioned, count(*) AS n, CAST(min(rank) AS INTEGER) AS first_rank FROM g GROUP BY ALL"),
    "grid_policies": (lambda s, d: grids.policies(s), f"SELECT policy, CAST(threshold AS DOUBLE) AS threshold FROM {_literal([('always_on', 0.0), ('threshold_0.02', 0.02), ('threshold_0.05', 0.05), ('threshold_0.1', 0.1)], 'policy, threshold')}"),
    "win_spec_scores": (
        lambda s, d: N.out(scores(s, d).groupBy("spec_id").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"), F.count_if(F.col("event") > 0).alias("long_events"), F.count_if(F.col("event") < 0).alias("short_events"))),
        _spec_scores_sql(),
    ),
    "prd_predictions": (lambda s, d: N.out(N.predictions(s, d).select("signal", "fold", "ts", "regime", "candidate_probability", "benchmark_probability", "target_up")), sql(PREDICTIONS, f"SELECT signal, fold, ts, regime, {r6('candidate_probability', 'benchmark_probability')}, target_up FROM pred")),
    "met_loss_brier": (
        lambda s, d: N.out(N.predictions(s, d).groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("candidate_loss", "benchmark_loss", "candidate_sq", "benchmark_sq", "incremental_log_loss")], F.avg(((F.col("candidate_probability") >= 0.5).cast("int") == F.col("target_up")).cast("double")).alias("accuracy"))),
        sql(PREDICTIONS, f"SELECT signal, fold, n, {r6('candidate_loss', 'benchmark_loss', 'candidate_sq', 'benchmark_sq', 'incremental_log_loss', 'accuracy')} FROM (SELECT signal, fold, count(*) AS n, avg(candidate_loss) AS candidate_loss, avg(benchmark_loss) AS benchmark_loss, avg(candidate_sq) AS candidate_sq, avg(benchmark_sq) AS benchmark_sq, avg(incremental_log_loss) AS incremental_log_loss, avg(CASE WHEN CAST(candidate_probability >= 0.5 AS INTEGER) = target_up THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY signal, fold)"),
    ),
    "met_ece": (lambda s, d: N.out(M.calibration_error(N.predictions(s, d), KEYS, "candidate_probability", "target_up")), sql(PREDICTIONS, f"SELECT signal, fold, {r6('ece')} FROM (SELECT signal, fold, sum(n * abs(my - mp)) / sum(n) AS ece FROM (SELECT signal, fold, least(CAST(floor(candidate_probability * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(candidate_probability) AS mp, avg(target_up) AS my FROM pred GROUP BY ALL) GROUP BY signal, fold)")),
    "met_auc": (lambda s, d: N.out(M.auc(N.predictions(s, d), KEYS, "candidate_probability", "target_up")), sql(PREDICTIONS, f"SELECT signal, fold, {r6('auc')} FROM (SELECT signal, fold, CASE WHEN sum(target_up) > 0 AND sum(1 - target_up) > 0 THEN (sum(CASE WHEN target_up = 1 THEN rk END) - sum(target_up) * (sum(target_up) + 1) / 2.0) / (sum(target_up) * sum(1 - target_up)) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY signal, fold ORDER BY candidate_probability) + (count(*) OVER (PARTITION BY signal, fold, candidate_probability) - 1) / 2.0 AS rk FROM pred) GROUP BY signal, fold)")),
    "agg_reliability": (lambda s, d: N.out(M.reliability(N.predictions(s, d).where("signal = 'rsi'"), "candidate_probability", "target_up")), sql(PREDICTIONS, f"SELECT bin, {r6('mean_probability', 'mean_outcome')}, n FROM (SELECT CAST(len(list_filter(q, lambda e: candidate_probability > e)) AS INTEGER) AS bin, avg(candidate_probability) AS mean_probability, avg(target_up) AS mean_outcome, count(*) AS n FROM pred, (SELECT quantile_cont(candidate_probability, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM pred WHERE signal = 'rsi') WHERE signal = 'rsi' GROUP BY 1)")),
    "pol_banded_returns": (lambda s, d: N.out(N.predictions(s, d).select("signal", "fold", "ts", "signal_position", "signal_turnover", "signal_net_return", "baseline_net_return", "incremental_net_edge")), sql(PREDICTIONS, f"SELECT signal, fold, ts, {r6('signal_position', 'signal_turnover', 'signal_net_return', 'baseline_net_return', 'incremental_net_edge')} FROM pred")),
    "pol_matched": (lambda s, d: N.out(N.matched(s, d).select("signal", "fold", "ts", "candidate_active", "candidate_position", "benchmark_position", "candidate_net_return", "benchmark_net_return", "incremental_net_return")), sql(MATCHED, f"SELECT signal, fold, ts, candidate_active, {r6('candidate_position', 'benchmark_position', 'candidate_net_return', 'benchmark_net_return', 'incremental_net_return')} FROM matched")),
    "pol_cost_grid": (
        lambda s, d: N.out(policy.policy_metrics(N.predictions(s, d).select("signal", "fold", "ts", "candidate_probability", "future_return"), KEYS, grids.policies(s).select("threshold"), s.createDataFrame(COSTS, "bps double"))),
        sql(
            PREDICTIONS,
            f"""SELECT signal, fold, threshold, bps, nonzero_decisions, {r6('coverage', 'mean_net_edge', 'gross_return', 'cumulative_net_return', 'turnover_units')} FROM (
SELECT signal, fold, threshold, bps, avg(CAST(active AS DOUBLE)) AS coverage, count(*) FILTER (active) AS nonzero_decisions, coalesce(avg(net) FILTER (active), 0.0) AS mean_net_edge, sum(position * future_return) AS gross_return, sum(net) AS cumulative_net_return, sum(moved) AS turnover_units FROM (
SELECT *, position * future_return - moved * bps / 10000.0 AS net FROM (
SELECT *, abs(position - lag(position, 1, 0.0) OVER (PARTITION BY signal, fold, threshold, bps ORDER BY ts)) AS moved FROM (
SELECT *, abs(candidate_probability - 0.5) > threshold AS active, CASE WHEN abs(candidate_probability - 0.5) > threshold THEN CASE WHEN candidate_probability > 0.5 THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS position FROM pred, (SELECT CAST(unnest([0.0, 0.02, 0.05, 0.1]) AS DOUBLE) AS threshold), (SELECT CAST(unnest([10.0, 5.0, 20.0]) AS DOUBLE) AS bps)))) GROUP BY signal, fold, threshold, bps)""",
        ),
    ),
    "agg_event_study": (
        lambda s, d: N.out(summaries.event_study(N.features(s, d), {"rsi": "rsi_event_position", "bollinger": "bb_event_position", "combined": "bridge_event_position"}, 0.001)),
        sql(PREDICTIONS, f"SELECT symbol, signal, event_count, long_events, short_events, {r6('mean_net_signed_return', 'win_rate_after_cost')} FROM (SELECT symbol, signal, count(*) FILTER (p <> 0) AS event_count, count(*) FILTER (p > 0) AS long_events, count(*) FILTER (p < 0) AS short_events, avg(net) AS mean_net_signed_return, avg(CAST(net > 0 AS DOUBLE)) AS win_rate_after_cost FROM (SELECT *, CASE WHEN p <> 0 THEN p * future_return - 0.002 END AS net FROM (SELECT symbol, future_return, unnest(['rsi', 'bollinger', 'combined']) AS signal, unnest([rsi_event_position, bb_event_position, bridge_event_position]) AS p FROM feat WHERE future_return IS NOT NULL)) GROUP BY symbol, signal)"),
    ),
    "agg_regime_summary": (
        lambda s, d: N.out(summaries.regime_summary(N.predictions(s, d), ["signal"], "regime")),
        sql(PREDICTIONS, f"SELECT signal, regime, observations, {r6('mean_incremental_log_loss', 'mean_incremental_net_edge', 'mean_signal_net_return', 'mean_baseline_net_return')} FROM (SELECT signal, regime, count(*) AS observations, avg(incremental_log_loss) AS mean_incremental_log_loss, avg(incremental_net_edge) AS mean_incremental_net_edge, avg(signal_net_return) AS mean_signal_net_return, avg(baseline_net_return) AS mean_baseline_net_return FROM pred GROUP BY signal, regime)"),
    ),
    "agg_regime_matrix": (
        lambda s, d: N.out(summaries.regime_matrix(summaries.regime_summary(N.predictions(s, d), ["signal"], "regime"), ["range", "trend", "stress"], "mean_incremental_net_edge")),
        sql(PREDICTIONS, f"SELECT signal, {r6('range', 'trend', 'stress').replace('round(range', 'round(\"range\"').replace('AS range', 'AS \"range\"')} FROM (SELECT signal, avg(incremental_net_edge) FILTER (regime = 'range') AS \"range\", avg(incremental_net_edge) FILTER (regime = 'trend') AS trend, avg(incremental_net_edge) FILTER (regime = 'stress') AS stress FROM pred GROUP BY signal)"),
    ),
    "lim_best_regime": (lambda s, d: summaries.regime_summary(N.predictions(s, d), ["signal"], "regime").groupBy("signal").agg(F.max_by("regime", "mean_incremental_net_edge").alias("best_regime")), sql(PREDICTIONS, "SELECT signal, arg_max(regime, e) AS best_regime FROM (SELECT signal, regime, avg(incremental_net_edge) AS e FROM pred GROUP BY signal, regime) GROUP BY signal")),
    "agg_calibration_sets": (
        lambda s, d: N.out(summaries.calibration_sets(N.predictions(s, d), ["signal"])),
        sql(PREDICTIONS, f"SELECT signal, subperiod, n, {r6('mean_outcome', 'mean_probability', 'candidate_loss', 'candidate_sq', 'benchmark_loss', 'benchmark_sq')} FROM (SELECT signal, coalesce(subperiod, 'OVERALL') AS subperiod, count(*) AS n, avg(target_up) AS mean_outcome, avg(candidate_probability) AS mean_probability, avg(candidate_loss) AS candidate_loss, avg(candidate_sq) AS candidate_sq, avg(benchmark_loss) AS benchmark_loss, avg(benchmark_sq) AS benchmark_sq FROM pred GROUP BY GROUPING SETS ((signal), (signal, subperiod)))"),
    ),
    "agg_monthly": (lambda s, d: N.out(summaries.monthly(N.daily(s, d).withColumn("g", F.col("close") - F.col("open")), ["symbol"], "g")), sql(BARS, f"SELECT symbol, month, rows, {r6('mean', 'total', 'share')} FROM (SELECT *, coalesce(greatest(total, 0) / nullif(sum(greatest(total, 0)) OVER (PARTITION BY symbol), 0), 0.0) AS share FROM (SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS rows, avg(close - open) AS mean, sum(close - open) AS total FROM daily GROUP BY 1, 2))")),
    "agg_leave_one_out": (lambda s, d: N.out(summaries.leave_one_out(N.predictions(s, d), ["signal"], F.col("fold"), "incremental_log_loss")), sql(PREDICTIONS, f"SELECT signal, left_out, rows, {r6('mean_without')} FROM (SELECT signal, fold AS left_out, rows, (sum(total) OVER (PARTITION BY signal) - total) / nullif(sum(rows) OVER (PARTITION BY signal) - rows, 0) AS mean_without FROM (SELECT signal, fold, count(incremental_log_loss) AS rows, sum(incremental_log_loss) AS total FROM pred GROUP BY signal, fold))")),
    "agg_joint_trim": (
        lambda s, d: N.out(summaries.joint_trim(N.predictions(s, d), ["signal"], "incremental_log_loss", "incremental_net_edge", [0.0, 0.01, 0.05])),
        sql(PREDICTIONS, f"SELECT signal, fraction, rows, {r6('mean_incremental_log_loss', 'mean_incremental_net_edge')} FROM (SELECT signal, CAST(f AS DOUBLE) AS fraction, count(*) AS rows, avg(a) AS mean_incremental_log_loss, avg(b) AS mean_incremental_net_edge FROM ({' UNION ALL '.join(f'SELECT p.signal, {f} AS f, incremental_log_loss AS a, incremental_net_edge AS b FROM pred AS p JOIN (SELECT signal, quantile_cont(incremental_log_loss, {f}) AS a0, quantile_cont(incremental_log_loss, {1 - f}) AS a1, quantile_cont(incremental_net_edge, {f}) AS b0, quantile_cont(incremental_net_edge, {1 - f}) AS b1 FROM pred GROUP BY signal) AS q ON p.signal = q.signal WHERE {f} = 0 OR (incremental_log_loss BETWEEN a0 AND a1 AND incremental_net_edge BETWEEN b0 AND b1)' for f in (0.0, 0.01, 0.05))}) GROUP BY signal, f)"),
    ),
    "agg_state_strata": (lambda s, d: N.out(summaries.stratify_states(N.predictions(s, d), ["signal"], "regime", ["incremental_log_loss"])), sql(PREDICTIONS, f"SELECT signal, regime, rows, {r6('mean_incremental_log_loss', 'share')}, rows >= 30 AS interpretable FROM (SELECT *, rows / sum(rows) OVER (PARTITION BY signal) AS share FROM (SELECT signal, regime, count(*) AS rows, avg(incremental_log_loss) AS mean_incremental_log_loss FROM pred GROUP BY signal, regime))")),
    "agg_confidence_terciles": (
        lambda s, d: N.out(summaries.confidence_terciles(N.matched(s, d), ["signal"], "candidate_confidence", ["candidate_net_return", "incremental_log_loss"])),
        sql(MATCHED, f"SELECT signal, stratum, rows, {r6('mean_candidate_net_return', 'mean_incremental_log_loss')} FROM (SELECT m.signal, CASE WHEN candidate_confidence <= q[1] THEN 'Q1' WHEN candidate_confidence <= q[2] THEN 'Q2' ELSE 'Q3' END AS stratum, count(*) AS rows, avg(candidate_net_return) AS mean_candidate_net_return, avg(incremental_log_loss) AS mean_incremental_log_loss FROM matched AS m JOIN (SELECT signal, quantile_cont(candidate_confidence, [1/3, 2/3]) AS q FROM matched WHERE candidate_active GROUP BY signal) AS e ON m.signal = e.signal WHERE candidate_active GROUP BY 1, 2)"),
    ),
    "agg_component_modes": (
        lambda s, d: N.out(summaries.component_modes(N.predictions(s, d), ["signal"], ["regime", "fold", "target_up"])),
        sql(PREDICTIONS, f"SELECT signal, component, mode, count, {r6('share')}, CASE WHEN share >= 0.8 THEN 'STABLE' WHEN share >= 0.6 THEN 'MODERATELY_STABLE' ELSE 'DIFFUSE' END AS stability FROM (SELECT *, count / sum(count) OVER (PARTITION BY signal, component) AS share, row_number() OVER (PARTITION BY signal, component ORDER BY count DESC, mode) AS k FROM (SELECT signal, component, mode, count(*) AS count FROM (SELECT signal, unnest(['regime', 'fold', 'target_up']) AS component, unnest([regime, CAST(fold AS VARCHAR), CAST(target_up AS VARCHAR)]) AS mode FROM pred) GROUP BY ALL)) WHERE k = 1"),
    ),
    "win_cumulative": (lambda s, d: N.out(summaries.cumulative(N.predictions(s, d), ["signal"], "signal_net_return").select("signal", "ts", "cumulative_signal_net_return")), sql(PREDICTIONS, f"SELECT signal, ts, {r6('cumulative_signal_net_return')} FROM (SELECT signal, ts, sum(signal_net_return) OVER (PARTITION BY signal ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cumulative_signal_net_return FROM pred)")),
    "win_rolling_edge": (rolling_edge, sql(PREDICTIONS, f"SELECT signal, ts, {r6('rolling_incremental_net_edge')} FROM (SELECT signal, ts, CASE WHEN rk >= greatest(15, size // 3) THEN (total - CASE WHEN rn > size THEN lag(total, CAST(size AS INTEGER)) OVER (PARTITION BY signal ORDER BY ts) ELSE 0 END) / rk END AS rolling_incremental_net_edge FROM (SELECT signal, ts, size, rn, least(rn, size) AS rk, sum(incremental_net_edge) OVER (PARTITION BY signal ORDER BY ts ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY ts) AS rn FROM pred), (SELECT least(180, greatest(30, max(n) // 20)) AS size FROM (SELECT count(*) AS n FROM pred GROUP BY signal))))")),
    "lim_evenly_spaced": (lambda s, d: selectors.evenly_spaced(N.index(s, d).select("symbol", "ts"), ["symbol"], 100), sql(BARS, "SELECT symbol, ts FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE i IN (SELECT CAST(floor(k * (n - 1) / 99) AS BIGINT) FROM (SELECT unnest(generate_series(0, 99)) AS k))")),
    "lim_latest": (lambda s, d: N.out(N.predictions(s, d).groupBy("signal").agg(F.max_by(F.struct("ts", "candidate_probability", "regime"), "ts").alias("x")).select("signal", "x.*")), sql(PREDICTIONS, f"SELECT signal, ts, {r6('candidate_probability')}, regime FROM pred QUALIFY row_number() OVER (PARTITION BY signal ORDER BY ts DESC) = 1")),
    "inf_newey_west": (
        lambda s, d: N.out(inference.newey_west(N.predictions(s, d), ["signal"], "incremental_log_loss", 2).withColumn("variance", F.col("variance") * 1e6)),
        sql(PREDICTIONS, f"SELECT signal, n, {r6('mean')}, {r6('variance')}, {r6('statistic')} FROM (SELECT signal, n, mean, v * 1e6 AS variance, CASE WHEN v > 0 THEN mean / sqrt(v) ELSE 0 END AS statistic FROM (SELECT signal, count(*) AS n, any_value(mu) AS mean, greatest((sum(x * x) + 2 * (1 - 1 / 3) * sum(x * x1) + 2 * (1 - 2 / 3) * sum(x * x2)) / count(*) / count(*), 0) AS v FROM (SELECT *, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM (SELECT signal, ts, avg(incremental_log_loss) OVER (PARTITION BY signal) AS mu, incremental_log_loss - avg(incremental_log_loss) OVER (PARTITION BY signal) AS x FROM pred) WINDOW w AS (PARTITION BY signal ORDER BY ts)) GROUP BY signal))"),
    ),
    "inf_holm": (lambda s, d: N.out(inference.benjamini_hochberg(inference.holm(share_tests(s, d)))), sql(PREDICTIONS + ", t AS (SELECT signal || '|' || fold AS name, (count(*) FILTER (incremental_log_loss <= 0) + 1) / (count(*) + 1) AS p_value FROM pred GROUP BY signal, fold), r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS k, count(*) OVER () AS m FROM t)", f"SELECT name, {r6('p_value', 'p_holm', 'p_bh')} FROM (SELECT name, p_value, max(least(1.0, (m - k + 1) * p_value)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS p_holm, min(least(1.0, p_value * m / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS p_bh FROM r)")),
    "inf_autocorrelation": (
        lambda s, d: N.out(inference.autocorrelations(N.predictions(s, d), ["signal"], "future_return")),
        sql(PREDICTIONS, f"SELECT signal, lag, {r6('acf')} FROM ({' UNION ALL '.join(f'SELECT signal, {k} AS lag, corr(q, l) AS acf FROM (SELECT signal, future_return * future_return AS q, lag(future_return * future_return, {k}) OVER (PARTITION BY signal ORDER BY ts) AS l FROM pred) GROUP BY signal' for k in range(1, 49))})"),
    ),
    "inf_block_length": (
        lambda s, d: inference.block_length(inference.autocorrelations(N.predictions(s, d), ["signal"], "future_return"), ["signal"]),
        sql(PREDICTIONS, f"SELECT signal, min(CASE WHEN ok AND ok1 AND ok2 THEN lag END) AS block_length FROM (SELECT *, lead(ok) OVER w AS ok1, lead(ok, 2) OVER w AS ok2 FROM (SELECT signal, lag, abs(acf) <= 0.1 AS ok FROM ({' UNION ALL '.join(f'SELECT signal, {k} AS lag, corr(q, l) AS acf FROM (SELECT signal, future_return * future_return AS q, lag(future_return * future_return, {k}) OVER (PARTITION BY signal ORDER BY ts) AS l FROM pred) GROUP BY signal' for k in range(1, 49))})) WINDOW w AS (PARTITION BY signal ORDER BY lag)) GROUP BY signal"),
    ),
    "drf_cusum": (
        lambda s, d: N.out(drift.cusum(N.predictions(s, d), ["signal"], 60).select("signal", "ts", "calibrating", "quality", "cusum", "structural_change_alarm", "change_index")),
        sql(
            PREDICTIONS,
            f"""SELECT signal, ts, calibrating, {r6('quality', 'cusum')}, cusum <= -8 AS structural_change_alarm, {r6('change_index')} FROM (SELECT *, ln(1 + greatest(0.0, -cusum) / 8.0) AS change_index FROM (
SELECT *, c - greatest(0.0, max(c) OVER (PARTITION BY signal ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS cusum FROM (
SELECT *, sum(CASE WHEN calibrating THEN 0.0 ELSE quality + 0.1 END) OVER (PARTITION BY signal ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM (
SELECT n.signal, ts, calibrating, CASE WHEN calibrating THEN 0.0 ELSE (greatest(-6.0, least(6.0, (incremental_log_loss - m1) / greatest(1.4826 * d1, 0.1 * s1, 1e-6))) + greatest(-6.0, least(6.0, (incremental_net_edge - m2) / greatest(1.4826 * d2, 0.1 * s2, 1e-6)))) / 2.0 END AS quality
FROM num AS n JOIN med ON n.signal = med.signal JOIN mad ON n.signal = mad.signal))))""",
        ).replace("\nSELECT signal, ts, calibrating,", """,
num AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY ts) <= least(60, greatest(60, floor(count(*) OVER (PARTITION BY signal) / 3))) AS calibrating FROM pred),
med AS (SELECT signal, quantile_cont(incremental_log_loss, 0.5) AS m1, stddev_pop(incremental_log_loss) AS s1, quantile_cont(incremental_net_edge, 0.5) AS m2, stddev_pop(incremental_net_edge) AS s2 FROM num WHERE calibrating GROUP BY signal),
mad AS (SELECT num.signal, quantile_cont(abs(incremental_log_loss - m1), 0.5) AS d1, quantile_cont(abs(incremental_net_edge - m2), 0.5) AS d2 FROM num JOIN med ON num.signal = med.signal WHERE calibrating GROUP BY num.signal)
SELECT signal, ts, calibrating,""", 1),
    ),
    "sel_screening": (
        lambda s, d: N.out(selectors.screening(screening_rows(s, d), ["signal"])),
        sql(INNER, f"SELECT signal, signal_spec_id, evaluation_rows, {r6('mean_incremental_log_loss', 'standard_error')}, positive_inner_folds, {r6('mean_candidate_brier', 'mean_benchmark_brier')}, eligible FROM (SELECT *, mean_candidate_brier <= mean_benchmark_brier + 0.0025 AS eligible FROM (SELECT signal, id AS signal_spec_id, {_SEL}, avg(cb) AS mean_candidate_brier, avg(bb) AS mean_benchmark_brier FROM {_SCREEN} GROUP BY signal, id)) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY eligible DESC, mean_incremental_log_loss DESC, positive_inner_folds DESC, standard_error, signal_spec_id) = 1"),
    ),
    "sel_structural": (
        lambda s, d: N.out(selectors.structural(structural_rows(s, d), ["signal"]).select("signal", "pipeline_id", "complexity_rank", "mean_incremental_log_loss", "eligible")),
        sql(INNER, f"SELECT signal, pipeline_id, complexity_rank, {r6('mean_incremental_log_loss')}, eligible FROM (SELECT *, mean_candidate_brier <= mean_benchmark_brier + 0.0025 AS eligible FROM (SELECT signal, id AS pipeline_id, {_SEL}, avg(cb) AS mean_candidate_brier, avg(bb) AS mean_benchmark_brier, min(complexity_rank) AS complexity_rank FROM {_SCREEN} GROUP BY signal, id)) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY eligible DESC, mean_incremental_log_loss DESC, positive_inner_folds DESC, standard_error, complexity_rank, pipeline_id) = 1"),
    ),
    "sel_calibration": (
        lambda s, d: N.out(selectors.calibration(calibration_rows(s, d), ["signal"]).select("signal", "calibration_method", "evaluation_rows", "mean_incremental_log_loss")),
        sql(INNER, f"SELECT signal, calibration_method, evaluation_rows, {r6('mean_incremental_log_loss')} FROM (SELECT signal, CASE k WHEN 0 THEN 'none' ELSE 'sigmoid' END AS calibration_method, {_SEL}, avg(cb) AS b FROM {_SCREEN} WHERE k < 2 GROUP BY signal, k) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY mean_incremental_log_loss DESC, positive_inner_folds DESC, b, calibration_method) = 1"),
    ),
    "sel_policy": (
        lambda s, d: N.out(selectors.abstention(policy_rows(s, d), ["signal"])),
        sql(INNER, f"SELECT signal, {r6('threshold', 'mean_coverage')}, total_nonzero_decisions, {r6('mean_net_edge')}, positive_inner_folds, eligible FROM (SELECT *, mean_coverage >= 0.1 AND total_nonzero_decisions >= 100 AS eligible FROM (SELECT signal, CAST([0.0, 0.02, 0.05, 0.1][k + 1] AS DOUBLE) AS threshold, avg(coverage / (1 + k)) AS mean_coverage, CAST(sum(CAST(floor(nonzero_decisions / (1 + k)) AS BIGINT)) AS BIGINT) AS total_nonzero_decisions, avg(edge * (1 + k)) AS mean_net_edge, count(*) FILTER (edge > 0) AS positive_inner_folds FROM inner_rows GROUP BY signal, k)) WHERE eligible OR threshold = 0 QUALIFY row_number() OVER (PARTITION BY signal ORDER BY eligible DESC, mean_net_edge DESC, positive_inner_folds DESC, mean_coverage DESC, threshold) = 1"),
    ),
    "sel_component": (
        lambda s, d: N.out(selectors.component(screening_rows(s, d).drop("candidate_ece", "benchmark_ece"), ["signal"], ["signal_spec_id"], 5).select("signal", "signal_spec_id", "mean_incremental_log_loss", "positive_evaluations")),
        sql(INNER, f"SELECT signal, signal_spec_id, {r6('mean_incremental_log_loss')}, positive_inner_folds AS positive_evaluations FROM (SELECT signal, id AS signal_spec_id, {_SEL}, avg(cb) AS mean_candidate_brier, avg(bb) AS mean_benchmark_brier FROM {_SCREEN} GROUP BY signal, id) WHERE evaluation_rows = 5 AND mean_candidate_brier <= mean_benchmark_brier + 0.0025 QUALIFY row_number() OVER (PARTITION BY signal ORDER BY mean_incremental_log_loss DESC, positive_inner_folds DESC, standard_error, signal_spec_id) = 1"),
    ),
    "flt_complete_folds": (
        lambda s, d: selectors.complete_ids(screening_rows(s, d).withColumn("status", F.when((F.col("signal_spec_id") == "spec-2") & (F.col("inner_fold") == 3), "SKIPPED").otherwise("EVALUATED")), ["signal"], "signal_spec_id", "inner_fold", 5).groupBy("signal", "signal_spec_id").agg(F.count("*").alias("rows")),
        sql(INNER, f"SELECT signal, id AS signal_spec_id, count(*) AS rows FROM {_SCREEN} WHERE id <> 'spec-2' GROUP BY signal, id"),
    ),
    "joi_unknown_ids": (unknown_ids, SPECS_SQL + "SELECT DISTINCT spec_id FROM (SELECT 'rsi-p' || (event_id % 6 * 7) || '-l30-u70-' || ['continuous', 'contrarian', 'continuation', 'unheard'][event_id % 4 + 1] AS spec_id FROM events) WHERE spec_id NOT IN (SELECT spec_id FROM specs)"),
    "gat_family_summary": (lambda s, d: N.out(gates.family_summary(N.outer_rows(s, d))), sql(OUTER, f"SELECT {_FAM_COLS}, {_PRE} AS preliminary_gate, {_PRE} AND mean_candidate_brier <= mean_benchmark_brier + 0.0025 AS stability_gate {_FAM}")),
    "gat_admission": (lambda s, d: gates.admission(N.outer_rows(s, d)).select("signal_family", "horizon", "failure_reasons", "development_admission_pass"), sql(OUTER, f"SELECT signal_family, horizon, {_FAILS} AS failure_reasons, {_FAILS} = '' AS development_admission_pass {_FAM}")),
    "gat_family_decision": (
        lambda s, d: N.out(selectors.family_horizon(gates.admission(N.outer_rows(s, d)))),
        sql(OUTER, f"SELECT signal_family, CASE WHEN h IS NOT NULL THEN 'PIPELINE_ADMITTED' ELSE 'NO_PIPELINE_ADMITTED' END AS family_decision, h AS selected_horizon, {r6('selected_gain')}, CASE WHEN h IS NOT NULL THEN '' ELSE why END AS rejection_reasons FROM (SELECT signal_family, string_agg('h' || horizon || ':' || CASE WHEN f = '' THEN 'UNSPECIFIED' ELSE f END, ';' ORDER BY horizon) AS why, arg_max(horizon, (g, -horizon)) FILTER (f = '') AS h, max(g) FILTER (f = '') AS selected_gain FROM (SELECT signal_family, horizon, {_FAILS} AS f, mean_incremental_log_loss AS g {_FAM}) GROUP BY signal_family)"),
    ),
    "gat_establishment": (
        lambda s, d: N.predictions(s, d).groupBy("signal", "fold").agg(F.avg("incremental_log_loss").alias("g"), F.sum("incremental_log_loss").alias("gs"), F.sum("incremental_net_edge").alias("es"), F.count("*").alias("n")).groupBy("signal").agg((F.sum("gs") / F.sum("n")).alias("gain"), (F.sum("es") / F.sum("n")).alias("edge"), F.count_if(F.col("g") > 0).alias("positive_folds"), F.count("*").alias("folds")).select("signal", "positive_folds", "folds", gates.established(F.col("gain"), F.col("edge"), F.col("positive_folds"), F.col("folds")).alias("established")),
        sql(PREDICTIONS, "SELECT signal, count(*) FILTER (g > 0) AS positive_folds, count(*) AS folds, sum(gs) > 0 AND sum(es) > 0 AND count(*) FILTER (g > 0) >= greatest(1, ceil(count(*) * 0.6)) AS established FROM (SELECT signal, fold, avg(incremental_log_loss) AS g, sum(incremental_log_loss) AS gs, sum(incremental_net_edge) AS es FROM pred GROUP BY signal, fold) GROUP BY signal"),
    ),
    "gat_robustness_class": (
        lambda s, d: gates.diagnostic_class(diagnostics(s, d)),
        sql(OUTER, f"SELECT pass, caution, fail, CASE WHEN fail > 0 THEN '{gates.ROBUSTNESS[0]}' WHEN caution > 0 THEN '{gates.ROBUSTNESS[1]}' ELSE '{gates.ROBUSTNESS[2]}' END AS robustness_class, CASE WHEN fail > 0 THEN '{gates.FRAGILITY[0]}' WHEN caution > 0 THEN '{gates.FRAGILITY[1]}' ELSE '{gates.FRAGILITY[2]}' END AS fragility_class FROM (SELECT count(*) FILTER (s = 'PASS') AS pass, count(*) FILTER (s = 'CAUTION') AS caution, count(*) FILTER (s = 'FAIL') AS fail FROM (SELECT unnest([CASE WHEN mean_incremental_log_loss > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN concentration <= 0.6 THEN 'PASS' ELSE 'CAUTION' END, CASE WHEN mean_candidate_ece <= mean_benchmark_ece + 0.02 THEN 'PASS' ELSE 'FAIL' END]) AS s {_FAM}))"),
    ),
}
