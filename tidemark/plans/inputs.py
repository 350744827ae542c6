"""Shared inputs of the registered queries, built from the events and orders tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import indicators, metrics
from tidemark.operators import policy, splits, summaries
from tidemark.sources import bars as B

PRED_KEYS = ["signal", "fold"]


def out(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without negative zero."""
    clean = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6))
    return df.select(*[clean(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(B.event_ticks(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(B.order_ticks(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.index_bars(B.event_ticks(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.aligned(index(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.feature_frame(panel(spark, sf_dir))


def two_thirds(frame: DataFrame) -> str:
    """The time two thirds of the way from a table's first to its last, in whole seconds."""
    ends = frame.agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    first, last = (datetime.fromisoformat(x or "2024-01-01") for x in ends)
    return str(first + timedelta(seconds=(last - first) // timedelta(seconds=1) * 2 // 3))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions that SQL can express too: the benchmark reads the trend alone, the
    candidate a signal's score besides; five folds in time order; V1 positions and returns."""
    f = features(spark, sf_dir).where("rsi_reversal_score is not null and bb_reversal_score is not null and trend_12 is not null and future_return is not null")
    regime = F.when(F.col("regime_stress") == 1, "stress").when(F.col("regime_trend") == 1, "trend").otherwise("range")
    scores = {"rsi": F.col("rsi_reversal_score"), "bollinger": F.col("bb_reversal_score"), "combined": (F.col("rsi_reversal_score") + F.col("bb_reversal_score")) / 2.0}
    long = f.select("symbol", "ts", "trend_12", "future_return", "target_up", regime.alias("regime"), F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), c.alias("score")) for s, c in scores.items()])))
    p = long.withColumns({"benchmark_probability": 1.0 / (1.0 + F.exp(10.0 * F.col("trend_12"))), "candidate_probability": 1.0 / (1.0 + F.exp(10.0 * F.col("trend_12") - 0.5 * F.col("score"))), "fold": F.ntile(5).over(W.partitionBy("signal").orderBy("ts"))})
    p = splits.thirds(p, ["signal"])
    return policy.banded_returns(summaries.scored(p), PRED_KEYS)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.matched_returns(predictions(spark, sf_dir), PRED_KEYS, 0.05)


def outer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per signal, horizon and fold, as the admission gates read them; horizons are
    shifted copies, so that gates see contexts that pass and contexts that do not."""
    m = matched(spark, sf_dir)
    base = m.groupBy(F.col("signal").alias("signal_family"), F.col("fold").alias("outer_fold")).agg(F.avg("incremental_log_loss").alias("incremental_log_loss"), F.avg("candidate_sq").alias("candidate_brier"), F.avg("benchmark_sq").alias("benchmark_brier"), F.avg(F.col("candidate_active").cast("double")).alias("policy_coverage"), F.count_if("candidate_active").alias("policy_nonzero_decisions"), F.coalesce(F.avg(F.when(F.col("candidate_active"), F.col("candidate_net_return"))), F.lit(0.0)).alias("policy_mean_net_edge"), *[metrics.ece(F.col(f"{n}_probability"), F.col("target_up")).alias(f"{n}_ece") for n in ("candidate", "benchmark")])
    h = F.explode(F.array(*[F.lit(k) for k in splits.HORIZONS]))
    return base.withColumn("horizon", h).withColumn("incremental_log_loss", F.col("incremental_log_loss") - 0.001 * F.col("horizon"))
