"""DuckDB twins of the shared inputs: bars, panel, features, stand-in predictions."""

from __future__ import annotations


def r6(*names: str) -> str:
    """Doubles for output: six decimals, no negative zero."""
    return ", ".join(f"CAST(CASE WHEN round({n}, 6) = 0 THEN 0.0 ELSE round({n}, 6) END AS DOUBLE) AS {n.split('.')[-1]}" for n in names)


BARS = """
ev AS (SELECT CASE WHEN event_type IN ('click', 'view', 'error') THEN 'PRI' ELSE 'CTX' END AS symbol, date_trunc('hour', ts) AS bar, ts AS at_ts, event_id, value FROM events WHERE value > 0),
hourly AS (SELECT symbol, bar AS ts, arg_min(value, (at_ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (at_ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ev GROUP BY symbol, bar),
od AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'PRI' ELSE 'CTX' END AS symbol, o_orderdate AS bar, o_orderkey AS k, o_totalprice AS value FROM orders),
daily AS (SELECT symbol, bar AS ts, arg_min(value, k) AS open, max(value) AS high, min(value) AS low, arg_max(value, k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM od GROUP BY symbol, bar),
x1 AS (SELECT symbol, bar AS ts, avg(value) AS x, CAST(count(*) AS DOUBLE) AS volume FROM ev GROUP BY symbol, bar),
x2 AS (SELECT *, 0.02 * (x - avg(x) OVER (PARTITION BY symbol)) / stddev_samp(x) OVER (PARTITION BY symbol) AS r FROM x1),
x3 AS (SELECT symbol, ts, volume, 100.0 * exp(sum(r) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS close FROM x2),
x4 AS (SELECT symbol, ts, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open, close, volume FROM x3),
bars AS MATERIALIZED (SELECT symbol, ts, open, greatest(open, close) * 1.005 AS high, least(open, close) * 0.995 AS low, close, volume FROM x4),
panel AS MATERIALIZED (SELECT 'PRI' AS symbol, p.ts AS ts, p.open AS pri_open, p.high AS pri_high, p.low AS pri_low, p.close AS pri_close, p.volume AS pri_volume, c.close AS ctx_close, c.volume AS ctx_volume FROM bars AS p JOIN bars AS c ON p.ts = c.ts AND p.symbol = 'PRI' AND c.symbol = 'CTX')"""

FEATURES = (
    BARS
    + """,
f1 AS (SELECT *, ln(pri_close) - lag(ln(pri_close)) OVER w AS pri_ret_1, ln(pri_close) - lag(ln(pri_close), 3) OVER w AS pri_ret_3, ln(ctx_close) - lag(ln(ctx_close)) OVER w AS ctx_ret_1, ln(ctx_close) - lag(ln(ctx_close), 3) OVER w AS ctx_ret_3, (ln(pri_close) - lag(ln(pri_close), 12) OVER w) / 12.0 AS trend_12, ln(1 + pri_volume) AS lv, row_number() OVER w AS rn, pri_close - lag(pri_close) OVER w AS move FROM panel WINDOW w AS (ORDER BY ts)),
f2 AS MATERIALIZED (SELECT *, CASE WHEN count(pri_ret_1) OVER f20 = 20 THEN stddev_samp(pri_ret_1) OVER f20 * sqrt(20.0) END AS vol_20, CASE WHEN count(pri_high) OVER f12 = 12 THEN max(pri_high) OVER f12 / min(pri_low) OVER f12 - 1.0 END AS range_12, CASE WHEN count(lv) OVER f30 = 30 THEN (lv - avg(lv) OVER f30) / nullif(stddev_samp(lv) OVER f30, 0) END AS volume_z FROM f1 WINDOW f20 AS (ORDER BY ts ROWS 19 PRECEDING), f12 AS (ORDER BY ts ROWS 11 PRECEDING), f30 AS (ORDER BY ts ROWS 29 PRECEDING)),
f3 AS (SELECT *, CASE WHEN coalesce(vol_20 > CASE WHEN count(vol_20) OVER q = 180 THEN quantile_cont(vol_20, 0.75) OVER q END, false) THEN 1.0 ELSE 0.0 END AS regime_stress, coalesce(abs(trend_12) > CASE WHEN count(trend_12) OVER q = 180 THEN quantile_cont(abs(trend_12), 0.75) OVER q END, false) AS moving FROM f2 WINDOW q AS (ORDER BY ts ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING)),
f4 AS (SELECT *, CASE WHEN regime_stress = 0 AND moving THEN 1.0 ELSE 0.0 END AS regime_trend, CASE WHEN regime_stress = 0 AND NOT moving THEN 1.0 ELSE 0.0 END AS regime_range FROM f3),
ew AS (SELECT rn, greatest(move, 0.0) AS g, greatest(-move, 0.0) AS l FROM f2 WHERE rn = 2 UNION ALL SELECT f2.rn, ew.g + (greatest(f2.move, 0.0) - ew.g) / 14.0, ew.l + (greatest(-f2.move, 0.0) - ew.l) / 14.0 FROM ew JOIN f2 ON f2.rn = ew.rn + 1),
f5 AS (SELECT f4.*, CASE WHEN f4.rn >= 15 THEN greatest(0.0, least(100.0, 100.0 - 100.0 / (1.0 + g / nullif(l, 0.0)))) END AS rsi FROM f4 LEFT JOIN ew ON f4.rn = ew.rn),
f6 AS (SELECT *, (rsi - 50.0) / 50.0 AS rsi_norm, (rsi - lag(rsi, 3) OVER w) / 100.0 AS rsi_slope, -(rsi - 50.0) / 50.0 AS rsi_reversal_score, CASE WHEN coalesce(rsi < 30 AND lag(rsi) OVER w >= 30, false) THEN 1.0 ELSE 0.0 END AS rsi_long_event, CASE WHEN coalesce(rsi > 70 AND lag(rsi) OVER w <= 70, false) THEN 1.0 ELSE 0.0 END AS rsi_short_event, CASE WHEN coalesce(rsi < 30 OR rsi > 70, false) THEN 1.0 ELSE 0.0 END AS rsi_extreme FROM f5 WINDOW w AS (ORDER BY ts)),
f7 AS (SELECT *, rsi_long_event - rsi_short_event AS rsi_event_position, rsi_norm * trend_12 AS rsi_x_trend, rsi_norm * vol_20 AS rsi_x_volatility, rsi_norm * regime_range AS rsi_x_range, rsi_norm * regime_stress AS rsi_x_stress, CASE WHEN count(pri_close) OVER b = 20 THEN avg(pri_close) OVER b END AS bb_middle, CASE WHEN count(pri_close) OVER b = 20 THEN stddev_pop(pri_close) OVER b END AS bb_sd FROM f6 WINDOW b AS (ORDER BY ts ROWS 19 PRECEDING)),
f8 AS (SELECT *, bb_middle + 2.0 * bb_sd AS bb_upper, bb_middle - 2.0 * bb_sd AS bb_lower FROM f7),
f9 AS (SELECT *, (pri_close - bb_lower) / nullif(bb_upper - bb_lower, 0.0) AS bb_percent_b, (bb_upper - bb_lower) / nullif(bb_middle, 0.0) AS bb_bandwidth, CASE WHEN coalesce(pri_close < bb_lower AND lag(pri_close) OVER w >= lag(bb_lower) OVER w, false) THEN 1.0 ELSE 0.0 END AS bb_long_event, CASE WHEN coalesce(pri_close > bb_upper AND lag(pri_close) OVER w <= lag(bb_upper) OVER w, false) THEN 1.0 ELSE 0.0 END AS bb_short_event, pri_close / bb_upper - 1.0 AS bb_distance_upper, pri_close / bb_lower - 1.0 AS bb_distance_lower, ln(lead(pri_close) OVER w / pri_close) AS future_return FROM f8 WINDOW w AS (ORDER BY ts)),
f10 AS (SELECT *, 0.5 - bb_percent_b AS bb_reversal_score, bb_long_event - bb_short_event AS bb_event_position, CASE WHEN coalesce(bb_percent_b < 0 OR bb_percent_b > 1, false) THEN 1.0 ELSE 0.0 END AS bb_extreme, CAST(future_return > 0 AS INTEGER) AS target_up FROM f9),
f11 AS (SELECT *, bb_reversal_score * trend_12 AS bb_x_trend, bb_reversal_score * vol_20 AS bb_x_volatility, bb_reversal_score * regime_range AS bb_x_range, bb_reversal_score * regime_stress AS bb_x_stress, CASE WHEN coalesce(sign(rsi_reversal_score) = sign(bb_reversal_score) AND rsi_extreme = 1 AND bb_extreme = 1, false) THEN 1.0 ELSE 0.0 END AS bridge_direction_agreement, rsi_reversal_score * bb_reversal_score AS bridge_score_product, rsi_reversal_score - bb_reversal_score AS bridge_score_difference FROM f10),
feat AS MATERIALIZED (SELECT *, CASE WHEN bridge_direction_agreement = 1 THEN CAST(sign(rsi_reversal_score) AS DOUBLE) ELSE 0.0 END AS bridge_event_position FROM f11)"""
)

PREDICTIONS = (
    FEATURES
    + """,
p1 AS (SELECT symbol, ts, trend_12, future_return, target_up, rsi_reversal_score AS r, bb_reversal_score AS b, CASE WHEN regime_stress = 1 THEN 'stress' WHEN regime_trend = 1 THEN 'trend' ELSE 'range' END AS regime FROM feat WHERE rsi_reversal_score IS NOT NULL AND bb_reversal_score IS NOT NULL AND trend_12 IS NOT NULL AND future_return IS NOT NULL),
p2 AS (SELECT symbol, ts, trend_12, future_return, target_up, regime, 'rsi' AS signal, r AS score FROM p1 UNION ALL SELECT symbol, ts, trend_12, future_return, target_up, regime, 'bollinger', b FROM p1 UNION ALL SELECT symbol, ts, trend_12, future_return, target_up, regime, 'combined', (r + b) / 2.0 FROM p1),
p3 AS (SELECT *, 1.0 / (1.0 + exp(10.0 * trend_12)) AS benchmark_probability, 1.0 / (1.0 + exp(10.0 * trend_12 - 0.5 * score)) AS candidate_probability, CAST(ntile(5) OVER (PARTITION BY signal ORDER BY ts) AS INTEGER) AS fold, 'P' || CAST(ntile(3) OVER (PARTITION BY signal ORDER BY ts) AS VARCHAR) AS subperiod FROM p2),
p4 AS (SELECT *, -(target_up * ln(candidate_probability) + (1 - target_up) * ln(1 - candidate_probability)) AS candidate_loss, -(target_up * ln(benchmark_probability) + (1 - target_up) * ln(1 - benchmark_probability)) AS benchmark_loss, (candidate_probability - target_up) * (candidate_probability - target_up) AS candidate_sq, (benchmark_probability - target_up) * (benchmark_probability - target_up) AS benchmark_sq FROM p3),
p5 AS (SELECT *, benchmark_loss - candidate_loss AS incremental_log_loss, CASE WHEN candidate_probability >= 0.55 THEN 1.0 WHEN candidate_probability <= 0.45 THEN -1.0 ELSE 0.0 END AS signal_position, CASE WHEN benchmark_probability >= 0.55 THEN 1.0 WHEN benchmark_probability <= 0.45 THEN -1.0 ELSE 0.0 END AS baseline_position FROM p4),
p6 AS (SELECT *, abs(signal_position - lag(signal_position, 1, 0.0) OVER w) AS signal_turnover, abs(baseline_position - lag(baseline_position, 1, 0.0) OVER w) AS baseline_turnover FROM p5 WINDOW w AS (PARTITION BY signal, fold ORDER BY ts)),
p7 AS (SELECT *, signal_position * future_return - signal_turnover * 10.0 / 10000.0 AS signal_net_return, baseline_position * future_return - baseline_turnover * 10.0 / 10000.0 AS baseline_net_return FROM p6),
pred AS MATERIALIZED (SELECT *, signal_net_return - baseline_net_return AS incremental_net_edge FROM p7)"""
)

MATCHED = (
    PREDICTIONS
    + """,
m1 AS (SELECT *, CASE WHEN abs(candidate_probability - 0.5) > 0.05 THEN CASE WHEN candidate_probability > 0.5 THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS candidate_position, CASE WHEN abs(benchmark_probability - 0.5) > 0.05 THEN CASE WHEN benchmark_probability > 0.5 THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS benchmark_position, abs(candidate_probability - 0.5) > 0.05 AS candidate_active, abs(candidate_probability - 0.5) AS candidate_confidence FROM pred),
m2 AS (SELECT *, candidate_position * future_return - abs(candidate_position - lag(candidate_position, 1, 0.0) OVER w) * 10.0 / 10000.0 AS candidate_net_return, benchmark_position * future_return - abs(benchmark_position - lag(benchmark_position, 1, 0.0) OVER w) * 10.0 / 10000.0 AS benchmark_net_return FROM m1 WINDOW w AS (PARTITION BY signal, fold ORDER BY ts)),
matched AS MATERIALIZED (SELECT *, candidate_net_return - benchmark_net_return AS incremental_net_return FROM m2)"""
)

OUTER = (
    MATCHED
    + """,
o1 AS (SELECT signal AS signal_family, fold AS outer_fold, avg(incremental_log_loss) AS incremental_log_loss, avg(candidate_sq) AS candidate_brier, avg(benchmark_sq) AS benchmark_brier, avg(CAST(candidate_active AS DOUBLE)) AS policy_coverage, CAST(sum(CAST(candidate_active AS INTEGER)) AS BIGINT) AS policy_nonzero_decisions, coalesce(avg(CASE WHEN candidate_active THEN candidate_net_return END), 0.0) AS policy_mean_net_edge FROM matched GROUP BY signal, fold),
e1 AS (SELECT signal, fold, which, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(target_up) AS my FROM (SELECT signal, fold, target_up, unnest(['candidate', 'benchmark']) AS which, unnest([candidate_probability, benchmark_probability]) AS p FROM pred) GROUP BY ALL),
e2 AS (SELECT signal, fold, which, sum(n * abs(my - mp)) / sum(n) AS ece FROM e1 GROUP BY ALL),
o2 AS (SELECT o1.*, c.ece AS candidate_ece, b.ece AS benchmark_ece FROM o1 JOIN e2 AS c ON c.signal = signal_family AND c.fold = outer_fold AND c.which = 'candidate' JOIN e2 AS b ON b.signal = signal_family AND b.fold = outer_fold AND b.which = 'benchmark'),
outer_rows AS MATERIALIZED (SELECT o2.* REPLACE (incremental_log_loss - 0.001 * h AS incremental_log_loss), h AS horizon FROM o2, (SELECT unnest([1, 2, 3, 6]) AS h))"""
)


def sql(chain: str, query: str) -> str:
    return f"WITH RECURSIVE {chain.strip()}\n{query.strip()}"
