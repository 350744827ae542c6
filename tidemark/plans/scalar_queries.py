"""Projections, scalar functions, second-generation signal blocks and small joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import metrics as M
from tidemark.plans import inputs as N
from tidemark.plans.oracle import BARS, FEATURES, PREDICTIONS, r6, sql
from tidemark.sources import bars as B

V2 = ("rsi_slope_1", "rsi_distance_mid", "rsi_distance_lower", "rsi_distance_upper", "rsi_nearest", "bb_distance_lower_sd", "bb_distance_upper_sd", "bb_bandwidth_change", "continuation_event", "contrarian_event")


def signal_block(frame, lower: float = 30.0, upper: float = 70.0, width: float = 2.0):
    """Second-generation columns: one-bar slope, distances in points and in deviations, both readings of an event."""
    w, rsi = B.by_time(), F.col("rsi")
    sd = F.nullif((F.col("bb_upper") - F.col("bb_lower")) / (2.0 * width), F.lit(0.0))  # the deviation itself
    return frame.select(
        "symbol",
        "ts",
        (rsi - F.lag("rsi").over(w)).alias("rsi_slope_1"),
        (rsi - 50.0).alias("rsi_distance_mid"),
        (rsi - lower).alias("rsi_distance_lower"),
        (rsi - upper).alias("rsi_distance_upper"),
        F.when(rsi.isNotNull(), F.least(F.abs(rsi - lower), F.abs(rsi - upper))).alias("rsi_nearest"),
        ((F.col("pri_close") - F.col("bb_lower")) / sd).alias("bb_distance_lower_sd"),
        ((F.col("pri_close") - F.col("bb_upper")) / sd).alias("bb_distance_upper_sd"),
        (F.col("bb_bandwidth") - F.lag("bb_bandwidth").over(w)).alias("bb_bandwidth_change"),
        (-F.col("rsi_event_position")).alias("continuation_event"),
        F.col("rsi_event_position").alias("contrarian_event"),
    )


def prefixed(frame, prefix: str, keep: tuple[str, ...] = ("symbol", "ts")):
    return frame.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in frame.columns if c not in keep])


def signal_columns(frame, interactions: list[str], conditioned: bool) -> list[str]:
    """All numeric columns of a signal block; its state interactions only if conditioned."""
    return [c for c, t in frame.dtypes if t in ("double", "int", "bigint") and (conditioned or c not in interactions)]


def scalars(s, d):
    p = N.predictions(s, d)
    c = F.col("candidate_probability")
    return p.select(
        "signal",
        "ts",
        M.logit(c).alias("logit"),
        M.sigmoid(M.logit(c)).alias("back"),
        M.clip(F.col("future_return"), 0.001).alias("clipped"),
        F.signum("score").alias("side"),
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"),
        F.initcap("regime").alias("title"),
        F.array_join(F.array_compact(F.array(F.when(F.col("target_up") == 1, "UP"), F.when(F.col("regime") == "stress", "STRESS"))), "|").alias("reasons"),
    )


ENTRIES = {
    "prj_prefixed": (lambda s, d: N.out(prefixed(N.index(s, d).select("symbol", "ts", "close", "volume"), "ctx_")), sql(BARS, f"SELECT symbol, ts, {r6('close').replace('AS close', 'AS ctx_close')}, {r6('volume').replace('AS volume', 'AS ctx_volume')} FROM bars")),
    "prj_feature_sets": (
        lambda s, d: s.createDataFrame([(k, len(v), ",".join(v)) for k, v in I.FEATURE_SETS.items()], "feature_set string, n int, names string"),
        "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({len(v)} AS INTEGER), '{','.join(v)}')" for k, v in I.FEATURE_SETS.items()) + ") AS t(feature_set, n, names)",
    ),
    "prj_signal_columns": (
        lambda s, d: s.createDataFrame([(c,) for c in signal_columns(N.features(s, d).select("ts", *[x for x in I.RSI if x not in I.BASELINE]), ["rsi_x_trend", "rsi_x_range", "rsi_x_stress"], False)], "column_name string"),
        "SELECT unnest(['rsi_norm', 'rsi_slope', 'rsi_reversal_score', 'rsi_extreme', 'rsi_x_volatility']) AS column_name",
    ),
    "win_signal_block": (
        lambda s, d: N.out(signal_block(N.features(s, d)).drop("symbol")),
        sql(
            FEATURES,
            f"""SELECT ts, {r6(*V2)} FROM (SELECT ts, rsi - lag(rsi) OVER w AS rsi_slope_1, rsi - 50 AS rsi_distance_mid, rsi - 30 AS rsi_distance_lower, rsi - 70 AS rsi_distance_upper, CASE WHEN rsi IS NOT NULL THEN least(abs(rsi - 30), abs(rsi - 70)) END AS rsi_nearest, (pri_close - bb_lower) / nullif((bb_upper - bb_lower) / 4.0, 0) AS bb_distance_lower_sd, (pri_close - bb_upper) / nullif((bb_upper - bb_lower) / 4.0, 0) AS bb_distance_upper_sd, bb_bandwidth - lag(bb_bandwidth) OVER w AS bb_bandwidth_change, -rsi_event_position AS continuation_event, rsi_event_position AS contrarian_event FROM feat WINDOW w AS (ORDER BY ts))""",
        ),
    ),
    "sca_scalars": (
        lambda s, d: N.out(scalars(s, d)),
        sql(PREDICTIONS, f"""SELECT signal, ts, {r6('logit', 'back', 'clipped', 'side')}, strftime(ts, '%Y-%m') AS month, epoch_ms(ts) AS epoch_ms, upper(regime[1]) || regime[2:] AS title, concat_ws('|', CASE WHEN target_up = 1 THEN 'UP' END, CASE WHEN regime = 'stress' THEN 'STRESS' END) AS reasons FROM (SELECT *, ln(candidate_probability / (1 - candidate_probability)) AS logit, candidate_probability AS back, greatest(0.001, least(0.999, future_return)) AS clipped, CAST(sign(score) AS DOUBLE) AS side FROM pred)"""),
    ),
    "joi_matched_frame": (
        lambda s, d: N.out(I.complete_rows(N.features(s, d).select("ts", "trend_12", "vol_20").join(N.features(s, d).select("ts", "rsi_reversal_score"), "ts", "left").join(I.target(N.panel(s, d)).select("ts", "future_return"), "ts", "left"))),
        sql(FEATURES, f"SELECT ts, {r6('trend_12', 'vol_20', 'rsi_reversal_score', 'future_return')} FROM feat WHERE trend_12 IS NOT NULL AND vol_20 IS NOT NULL AND rsi_reversal_score IS NOT NULL AND future_return IS NOT NULL"),
    ),
    "set_union_folds": (
        lambda s, d: N.predictions(s, d).where("fold <= 2").select("signal", "ts").unionByName(N.predictions(s, d).where("fold = 5").select("ts", "signal")).groupBy("signal").agg(F.count("*").alias("rows")),
        sql(PREDICTIONS, "SELECT signal, count(*) AS rows FROM pred WHERE fold IN (1, 2, 5) GROUP BY signal"),
    ),
    "flt_active_decisions": (
        lambda s, d: N.out(N.predictions(s, d).where(F.abs(F.col("candidate_probability") - 0.5) > 0.05).select("signal", "ts", "candidate_probability")),
        sql(PREDICTIONS, f"SELECT signal, ts, {r6('candidate_probability')} FROM pred WHERE abs(candidate_probability - 0.5) > 0.05"),
    ),
    "agg_manifest_counts": (
        lambda s, d: N.predictions(s, d).groupBy("signal").agg(F.count("*").alias("rows"), F.countDistinct("ts").alias("times"), F.countDistinct("fold").alias("folds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
        sql(PREDICTIONS, "SELECT signal, count(*) AS rows, count(DISTINCT ts) AS times, count(DISTINCT fold) AS folds, min(ts) AS first_ts, max(ts) AS last_ts FROM pred GROUP BY signal"),
    ),
    "agg_fold_errors": (
        lambda s, d: N.out(N.predictions(s, d).groupBy("signal", "fold").agg(F.avg("incremental_log_loss").alias("g")).groupBy("signal").agg(M.standard_error(F.col("g")).alias("standard_error"), M.positive_concentration(F.col("g")).alias("concentration"))),
        sql(PREDICTIONS, f"SELECT signal, {r6('standard_error', 'concentration')} FROM (SELECT signal, coalesce(stddev_samp(g) / sqrt(count(g)), 0) AS standard_error, coalesce(max(greatest(g, 0)) / nullif(sum(greatest(g, 0)), 0), 1.0) AS concentration FROM (SELECT signal, fold, avg(incremental_log_loss) AS g FROM pred GROUP BY signal, fold) GROUP BY signal)"),
    ),
}
