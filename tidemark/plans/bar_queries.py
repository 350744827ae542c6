"""Sources, checks, joins, features and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import checks, splits, states
from tidemark.plans import inputs as N
from tidemark.plans.oracle import BARS, FEATURES, r6, sql
from tidemark.sources import bars as B
from tidemark.sources.saved import save

OHLCV = r6("open", "high", "low", "close", "volume")


def _features(*columns: str):
    return lambda s, d: N.out(N.features(s, d).select("ts", *columns)), sql(FEATURES, f"SELECT ts, {r6(*columns)} FROM feat")


def raw_rows(s, d):
    """Bar rows as a file would hold them: text, odd names, repeats, a bad last repeat, a bad key."""
    h = N.hourly(s, d).where("symbol = 'PRI'")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = lambda seq, close, key=stamp: h.select(F.lit(seq).alias("seq"), key.alias(" Date "), F.col("open").cast("string").alias("OPEN"), F.col("high").cast("string").alias("High"), F.col("low").cast("string").alias("low"), close.alias("Close "), F.col("volume").cast("string").alias("Volume"), F.hour("ts").alias("h"))
    good = text(1, F.col("close").cast("string"))
    again = text(2, (F.col("close") * 2).cast("string")).where("h % 5 = 0")
    bad = text(3, F.lit("n/a")).where("h % 7 = 0")
    lost = text(4, F.col("close").cast("string"), F.lit("not a date")).where("h = 3")
    return good.union(again).union(bad).union(lost)


def flagship(s, d):
    """Net signed return after each crossing of the bands, of the primary symbol."""
    bars = N.index(s, d).where("symbol = 'PRI'").select("symbol", "ts", F.col("close").alias("pri_close"))
    w = B.by_time()
    c = F.col("pri_close")
    band = bars.select("*", I.full(F.avg(c), c, 20).alias("mid"), I.full(F.stddev_pop(c), c, 20).alias("sd"), F.lead("pri_close").over(w).alias("next"))
    edge = band.select("symbol", "ts", "pri_close", "next", (F.col("mid") + 2 * F.col("sd")).alias("up"), (F.col("mid") - 2 * F.col("sd")).alias("low"))
    was = lambda x: F.lag(x).over(w)
    long, short = I.flag((c < F.col("low")) & (was("pri_close") >= was("low"))), I.flag((c > F.col("up")) & (was("pri_close") <= was("up")))
    ev = edge.withColumn("position", long - short).where("position <> 0 and next is not null")
    return ev.select("symbol", "ts", "position", (F.col("position") * F.log(F.col("next") / c) - 0.002).alias("net_signed_return"))


def feature_dictionary(s, d):
    """What the library's feature columns are: family, range, nulls, and whether they are known in time."""
    panel = save(N.panel(s, d), "panel")
    whole, until = save(I.feature_frame(panel), "features"), F.lit(N.two_thirds(panel)).cast(panel.schema["ts"].dataType)
    part = save(I.feature_frame(panel.where(F.col("ts") <= until)), "features")
    return N.out(checks.feature_dictionary(whole, part, I.feature_families(panel), states.INPUTS))


def _dictionary_sql() -> str:
    """The same counts; what looks ahead is the targets alone."""
    targets = ("future_return", "target_up")
    families = {"rsi": "rsi", "bb": "bollinger", "bridge": "bridge", "future": "target", "target": "target"}
    names = ["pri_ret_1", "pri_ret_3", "ctx_ret_1", "ctx_ret_3", "trend_12", "vol_20", "range_12", "volume_z", "regime_stress", "regime_trend", "regime_range", *targets]
    names += [f"rsi{x}" for x in ("", "_norm", "_slope", "_reversal_score", "_long_event", "_short_event", "_event_position", "_extreme", "_x_trend", "_x_volatility", "_x_range", "_x_stress")]
    names += [f"bb_{x}" for x in ("middle", "upper", "lower", "percent_b", "bandwidth", "reversal_score", "long_event", "short_event", "event_position", "extreme", "distance_upper", "distance_lower", "x_trend", "x_volatility", "x_range", "x_stress")]
    names += [f"bridge_{x}" for x in ("direction_agreement", "event_position", "score_product", "score_difference")]
    one = lambda c: f"SELECT '{families.get(c.split('_')[0], 'benchmark')}' AS family, '{c}' AS feature, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, {str(c not in targets).lower()} AS known_at_origin, {str(c in states.INPUTS).lower()} AS state_input FROM feat"
    return sql(FEATURES, f"SELECT family, feature, rows, nulls, {r6('least', 'most')}, known_at_origin, state_input FROM ({' UNION ALL '.join(map(one, names))})")


FLAGSHIP_SQL = sql(
    BARS,
    f"""SELECT symbol, ts, {r6('position', 'net_signed_return')} FROM (
SELECT symbol, ts, position, position * ln(nxt / close) - 0.002 AS net_signed_return FROM (
SELECT *, (CASE WHEN coalesce(close < low AND lag(close) OVER w >= lag(low) OVER w, false) THEN 1.0 ELSE 0.0 END) - (CASE WHEN coalesce(close > up AND lag(close) OVER w <= lag(up) OVER w, false) THEN 1.0 ELSE 0.0 END) AS position FROM (
SELECT symbol, ts, close, lead(close) OVER (ORDER BY ts) AS nxt, CASE WHEN count(close) OVER f = 20 THEN avg(close) OVER f + 2 * stddev_pop(close) OVER f END AS up, CASE WHEN count(close) OVER f = 20 THEN avg(close) OVER f - 2 * stddev_pop(close) OVER f END AS low
FROM bars WHERE symbol = 'PRI' WINDOW f AS (ORDER BY ts ROWS 19 PRECEDING)) WINDOW w AS (ORDER BY ts)) WHERE position <> 0 AND nxt IS NOT NULL)""",
)

ENTRIES = {
    "bars_hourly": (lambda s, d: N.out(N.hourly(s, d)), sql(BARS, f"SELECT symbol, ts, {OHLCV} FROM hourly")),
    "bars_daily": (lambda s, d: N.out(N.daily(s, d)), sql(BARS, f"SELECT symbol, ts, {OHLCV} FROM daily")),
    "bars_index": (lambda s, d: N.out(N.index(s, d)), sql(BARS, f"SELECT symbol, ts, {OHLCV} FROM bars")),
    "band_event_returns": (lambda s, d: N.out(flagship(s, d)), FLAGSHIP_SQL),
    "src_standardize": (
        lambda s, d: N.out(B.standardize(raw_rows(s, d).drop("h"), F.col("seq"))).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        sql(
            BARS,
            f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {OHLCV} FROM (
SELECT ts, open, high, low, CASE WHEN hour(ts) % 5 = 0 THEN close * 2 ELSE close END AS close, volume FROM hourly WHERE symbol = 'PRI' AND hour(ts) % 7 <> 0)""",
        ),
    ),
    "chk_market_validation": (
        lambda s, d: N.out(checks.validation_status(checks.market_validation(N.hourly(s, d), 1), B.aligned(N.hourly(s, d)).count())),
        sql(
            BARS,
            f"""SELECT symbol, rows, first_ts, last_ts, duplicates, incomplete, invalid, irregular_steps, gaps, {r6('largest_gap_hours')}, CASE WHEN (SELECT count(*) FROM hourly a JOIN hourly b ON a.ts = b.ts AND a.symbol = 'PRI' AND b.symbol = 'CTX') < 500 OR duplicates > 0 THEN 'FAIL' WHEN gaps > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM (
SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS incomplete, count(*) FILTER (least(open, high, low, close) <= 0 OR volume < 0) AS invalid, count(*) FILTER (h <> 1) AS irregular_steps, count(*) FILTER (h > 1) AS gaps, coalesce(max(h), 0.0) AS largest_gap_hours
FROM (SELECT *, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 3600.0 AS h FROM hourly) GROUP BY symbol)""",
        ),
    ),
    "chk_expectations": (
        lambda s, d: checks.expectations(N.index(s, d), {"positive_prices": "least(open, high, low, close) > 0", "high_is_top": "high >= greatest(open, close)", "busy": "volume >= 5"}),
        sql(BARS, "SELECT * FROM (SELECT 'positive_prices' AS rule, count(*) FILTER (NOT (least(open, high, low, close) > 0)) AS violations FROM bars UNION ALL SELECT 'high_is_top', count(*) FILTER (NOT (high >= greatest(open, close))) FROM bars UNION ALL SELECT 'busy', count(*) FILTER (NOT (volume >= 5)) FROM bars)"),
    ),
    "chk_prefix_invariance": (
        lambda s, d: N.out(checks.prefix_invariance(lambda p: I.returns_and_scale(p), N.panel(s, d), N.two_thirds(N.panel(s, d)), ["pri_ret_1", "trend_12", "vol_20", "range_12", "volume_z"])),
        "SELECT unnest(['pri_ret_1', 'trend_12', 'vol_20', 'range_12', 'volume_z']) AS \"column\", CAST(0 AS DOUBLE) AS max_error, CAST(0 AS BIGINT) AS null_mismatches",
    ),
    "flt_feature_dictionary": (feature_dictionary, _dictionary_sql()),
    "joi_aligned": (lambda s, d: N.out(N.panel(s, d)), sql(BARS, f"SELECT symbol, ts, {r6('pri_open', 'pri_high', 'pri_low', 'pri_close', 'pri_volume', 'ctx_close', 'ctx_volume')} FROM panel")),
    "joi_reindex": (
        lambda s, d: N.out(N.hourly(s, d).where("symbol = 'PRI'").select("ts").join(N.index(s, d).where("symbol = 'CTX'").select("ts", "close"), "ts", "left")),
        sql(BARS, f"SELECT h.ts AS ts, {r6('b.close')} FROM (SELECT ts FROM hourly WHERE symbol = 'PRI') AS h LEFT JOIN (SELECT * FROM bars WHERE symbol = 'CTX') AS b ON h.ts = b.ts"),
    ),
    "set_overlap": (
        lambda s, d: N.daily(s, d).where("symbol = 'PRI'").select("ts").intersect(N.daily(s, d).where("symbol = 'CTX'").select("ts")),
        sql(BARS, "SELECT ts FROM daily WHERE symbol = 'PRI' INTERSECT SELECT ts FROM daily WHERE symbol = 'CTX'"),
    ),
    "set_missing": (
        lambda s, d: N.daily(s, d).where("symbol = 'PRI'").select("ts").exceptAll(N.daily(s, d).where("symbol = 'CTX'").select("ts")),
        sql(BARS, "SELECT ts FROM daily WHERE symbol = 'PRI' EXCEPT ALL SELECT ts FROM daily WHERE symbol = 'CTX'"),
    ),
    "win_returns": _features("pri_ret_1", "pri_ret_3", "ctx_ret_1", "ctx_ret_3", "trend_12"),
    "win_scale_range_volume": _features("vol_20", "range_12", "volume_z"),
    "win_regime_flags": _features("regime_stress", "regime_trend", "regime_range"),
    "win_rsi": _features("rsi"),
    "win_rsi_features": _features("rsi_norm", "rsi_slope", "rsi_reversal_score", "rsi_long_event", "rsi_short_event", "rsi_event_position", "rsi_extreme", "rsi_x_trend", "rsi_x_volatility", "rsi_x_range", "rsi_x_stress"),
    "win_bollinger": _features("bb_middle", "bb_upper", "bb_lower", "bb_percent_b", "bb_bandwidth", "bb_reversal_score", "bb_long_event", "bb_short_event", "bb_event_position", "bb_extreme", "bb_distance_upper", "bb_distance_lower", "bb_x_trend", "bb_x_volatility", "bb_x_range", "bb_x_stress"),
    "win_bridge": _features("bridge_direction_agreement", "bridge_event_position", "bridge_score_product", "bridge_score_difference"),
    "prj_baseline": (lambda s, d: N.out(I.complete_rows(N.features(s, d).select("ts", *I.BASELINE), I.BASELINE)), sql(FEATURES, f"SELECT ts, {r6(*I.BASELINE)} FROM feat WHERE volume_z IS NOT NULL AND trend_12 IS NOT NULL AND vol_20 IS NOT NULL AND range_12 IS NOT NULL")),
    "flt_complete_rows": (
        lambda s, d: I.complete_rows(N.features(s, d).select("ts", *I.COMBINED, "future_return")).groupBy().agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
        sql(FEATURES, f"SELECT count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM feat WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*I.COMBINED, 'future_return'])}"),
    ),
    "win_event_persistence": (
        lambda s, d: N.out(I.event_persistence(N.features(s, d), "bb_event_position").select("ts", "persistence")),
        sql(FEATURES, f"SELECT ts, {r6('persistence')} FROM (SELECT ts, CASE WHEN age < 6 THEN sgn * (1.0 - age / 6.0) ELSE 0.0 END AS persistence FROM (SELECT ts, rn - last_value(CASE WHEN bb_event_position <> 0 THEN rn END IGNORE NULLS) OVER w AS age, last_value(CASE WHEN bb_event_position <> 0 THEN sign(bb_event_position) END IGNORE NULLS) OVER w AS sgn FROM feat WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)))"),
    ),
    "win_targets": (
        lambda s, d: N.out(I.horizon_targets(N.panel(s, d)).select("ts", "horizon", "target_ts", "future_return", "direction")),
        sql(BARS, f"SELECT ts, horizon, target_ts, {r6('future_return')}, CAST(future_return > 0 AS INTEGER) AS direction FROM ({' UNION ALL '.join(f'SELECT ts, {h} AS horizon, lead(ts, {h}) OVER (ORDER BY ts) AS target_ts, ln(lead(pri_close, {h}) OVER (ORDER BY ts) / pri_close) AS future_return FROM panel' for h in (1, 2, 3, 6))})"),
    ),
    "flt_bounded_targets": (
        lambda s, d: N.out(I.bounded_targets(I.horizon_targets(N.panel(s, d)), [("2024-01-01 00:00:00", "2024-01-20 00:00:00"), ("2024-01-20 01:00:00", "2024-01-28 00:00:00")]).groupBy("horizon").agg(F.count("target_ts").alias("valid"), F.sum("direction").alias("ups"), F.avg("future_return").alias("mean_return"))),
        sql(BARS, f"SELECT horizon, count(target_ts) AS valid, CAST(sum(CAST(r > 0 AS BIGINT)) AS BIGINT) AS ups, {r6('mean_return')} FROM (SELECT *, avg(r) OVER (PARTITION BY horizon) AS mean_return FROM (SELECT ts, horizon, CASE WHEN ok THEN t END AS target_ts, CASE WHEN ok THEN r END AS r FROM (SELECT *, (ts <= TIMESTAMP '2024-01-20 00:00:00' AND t <= TIMESTAMP '2024-01-20 00:00:00') OR (ts >= TIMESTAMP '2024-01-20 01:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00' AND t <= TIMESTAMP '2024-01-28 00:00:00') AS ok FROM ({' UNION ALL '.join(f'SELECT ts, {h} AS horizon, lead(ts, {h}) OVER (ORDER BY ts) AS t, ln(lead(pri_close, {h}) OVER (ORDER BY ts) / pri_close) AS r FROM panel' for h in (1, 2, 3, 6))})))) GROUP BY horizon, mean_return"),
    ),
    "tgt_large_move": (
        lambda s, d: I.large_move(I.target(N.panel(s, d)), 500).select("ts", "large_move"),
        sql(FEATURES, "SELECT ts, CAST(abs(future_return) > (SELECT quantile_cont(abs(future_return), 0.9) FROM feat WHERE rn <= 500) AS INTEGER) AS large_move FROM feat"),
    ),
    "win_thirds": (lambda s, d: splits.thirds(N.panel(s, d).select("symbol", "ts")).groupBy("subperiod").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), sql(BARS, "SELECT subperiod, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT ts, 'P' || CAST(ntile(3) OVER (ORDER BY ts) AS VARCHAR) AS subperiod FROM panel) GROUP BY subperiod")),
    "flt_training_window": (
        lambda s, d: N.out(splits.training_window(N.index(s, d), 180).groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.avg("close").alias("mean_close"))),
        sql(BARS, f"SELECT symbol, rows, first_ts, {r6('mean_close')} FROM (SELECT symbol, count(*) AS rows, min(ts) AS first_ts, avg(close) AS mean_close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 180 GROUP BY symbol)"),
    ),
    "flt_time_range": (
        lambda s, d: N.out(splits.between(N.index(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("symbol", "ts", "close")),
        sql(BARS, f"SELECT symbol, ts, {r6('close')} FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'"),
    ),
    "win_gaps": (
        lambda s, d: N.out(N.daily(s, d).select("symbol", "ts", ((F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(B.by_time()))) / 86400.0).alias("days"))).where("days > 1"),
        sql(BARS, f"SELECT symbol, ts, {r6('days')} FROM (SELECT symbol, ts, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 86400.0 AS days FROM daily) WHERE days > 1"),
    ),
}
