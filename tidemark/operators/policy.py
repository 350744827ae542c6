"""Decision rules, turnover costs and policy aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def banded_position(p: Column, low: float = 0.45, high: float = 0.55) -> Column:
    """1 at or above `high`, -1 at or below `low`, else 0."""
    if not 0 < low < high < 1:
        raise ValueError("bounds must satisfy 0 < low < high < 1")
    return F.when(p >= high, 1.0).when(p <= low, -1.0).otherwise(0.0)


def distance_position(p: Column, threshold: Column) -> Column:
    """The side of one half, if the probability is further from it than the threshold."""
    return F.when(F.abs(p - 0.5) > threshold, F.when(p > 0.5, 1.0).otherwise(-1.0)).otherwise(0.0)


def turnover(position: Column, keys: list[str]) -> Column:
    """|change of position|, from 0 at the start of each slice."""
    return F.abs(position - F.lag(position, 1, 0.0).over(W.partitionBy(*keys).orderBy("ts")))


def net_return(position: Column, ret: Column, moved: Column, bps: Column | float) -> Column:
    return position * ret - moved * (F.lit(bps) if not isinstance(bps, Column) else bps) / 10000.0


def banded_returns(pred: DataFrame, keys: list[str], bps: float = 10.0) -> DataFrame:
    """Adds position, turnover and net_return of candidate (signal_) and benchmark (baseline_)."""
    held = pred.withColumns({"signal_position": banded_position(F.col("candidate_probability")), "baseline_position": banded_position(F.col("benchmark_probability"))})
    moved = held.withColumns({f"{n}_turnover": turnover(F.col(f"{n}_position"), keys) for n in ("signal", "baseline")})
    out = moved.withColumns({f"{n}_net_return": net_return(F.col(f"{n}_position"), F.col("future_return"), F.col(f"{n}_turnover"), bps) for n in ("signal", "baseline")})
    return out.withColumn("incremental_net_edge", F.col("signal_net_return") - F.col("baseline_net_return"))


def matched_returns(pred: DataFrame, keys: list[str], threshold: float, bps: float = 10.0) -> DataFrame:
    """Candidate and benchmark under one threshold and one cost; confidence is the distance from one half."""
    t, p = F.lit(threshold), {"candidate": F.col("candidate_probability"), "benchmark": F.col("benchmark_probability")}
    held = pred.withColumns({**{f"{n}_position": distance_position(c, t) for n, c in p.items()}, **{f"{n}_active": F.abs(c - 0.5) > t for n, c in p.items()}, "candidate_confidence": F.abs(p["candidate"] - 0.5)})
    moved = held.withColumns({f"{n}_turnover": turnover(F.col(f"{n}_position"), keys) for n in p})
    out = moved.withColumns({**{f"{n}_gross_return": F.col(f"{n}_position") * F.col("future_return") for n in p}, **{f"{n}_net_return": net_return(F.col(f"{n}_position"), F.col("future_return"), F.col(f"{n}_turnover"), bps) for n in p}})
    return out.withColumn("incremental_net_return", F.col("candidate_net_return") - F.col("benchmark_net_return"))


def policy_metrics(pred: DataFrame, keys: list[str], policies: DataFrame, costs: DataFrame) -> DataFrame:
    """Coverage, decisions, mean over active rows, sums and turnover per policy and cost.

    policies and costs are small tables (threshold; bps) that every row meets.
    """
    every = pred.join(F.broadcast(policies), F.lit(True)).join(F.broadcast(costs), F.lit(True))
    slice_ = [*keys, "threshold", "bps"]
    held = every.withColumns({"active": F.abs(F.col("candidate_probability") - 0.5) > F.col("threshold"), "position": distance_position(F.col("candidate_probability"), F.col("threshold"))})
    moved = held.withColumn("moved", turnover(F.col("position"), slice_))
    net = moved.withColumn("net", net_return(F.col("position"), F.col("future_return"), F.col("moved"), F.col("bps")))
    return net.groupBy(*slice_).agg(
        F.avg(F.col("active").cast("double")).alias("coverage"),
        F.count_if("active").alias("nonzero_decisions"),
        F.coalesce(F.avg(F.when(F.col("active"), F.col("net"))), F.lit(0.0)).alias("mean_net_edge"),
        F.sum(F.col("position") * F.col("future_return")).alias("gross_return"),
        F.sum("net").alias("cumulative_net_return"),
        F.sum("moved").alias("turnover_units"),
    )
