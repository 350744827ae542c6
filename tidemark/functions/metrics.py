"""Scoring rules and economics as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clip(p: Column, eps: float = 1e-9) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def logit(p: Column, eps: float = 1e-9) -> Column:
    return F.log(clip(p, eps) / (1.0 - clip(p, eps)))


def log_loss(p: Column, y: Column, eps: float = 1e-9) -> Column:
    """The loss of one row; average it for the mean."""
    return -(y * F.log(clip(p, eps)) + (1.0 - y) * F.log(1.0 - clip(p, eps)))


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def ece_bin(p: Column, bins: int = 10) -> Column:
    """Equal-width bins, closed on the left; the last one on both sides."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def ece(p: Column, y: Column, bins: int = 10) -> Column:
    """An aggregate: the gaps of summed outcomes and probabilities of each bin over the number of rows."""
    gap, at = y - p, ece_bin(p, bins)
    return sum((F.abs(F.coalesce(F.sum(F.when(at == b, gap)), F.lit(0.0))) for b in range(1, bins)), F.abs(F.coalesce(F.sum(F.when(at == 0, gap)), F.lit(0.0)))) / F.count(p)


def accuracy(p: Column, y: Column) -> Column:
    """An aggregate: the share of rows whose side of one half was right."""
    return F.avg(((p >= 0.5).cast("int") == y.cast("int")).cast("double"))


def calibration_error(rows: DataFrame, keys: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """(keys, ece): the weighted gap of mean outcome and mean probability over bins."""
    return rows.groupBy(*keys).agg(ece(F.col(p), F.col(y), bins).alias("ece"))


def auc(rows: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """(keys, auc) by rank sums with ties at their mean rank; NULL with one class only.

    Rows are first counted by score, so the ordered window sees distinct scores.
    """
    by_score = rows.groupBy(*keys, F.col(p).alias("s")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    ranked = by_score.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), (F.sum("n") - F.sum("pos")).alias("nn"))
    value = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2.0) / (F.col("np") * F.col("nn"))
    return sums.select(*keys, F.when((F.col("np") > 0) & (F.col("nn") > 0), value).alias("auc"))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, mean_probability, mean_outcome, n) over quantile bins, closed on the right."""
    edges = rows.agg(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    placed = rows.join(F.broadcast(edges), F.lit(True))  # one row of edges
    number = F.size(F.filter("edges", lambda e: F.col(p) > e)).alias("bin")
    return placed.select(number, p, y).groupBy("bin").agg(F.avg(p).alias("mean_probability"), F.avg(y).alias("mean_outcome"), F.count("*").alias("n"))


def standard_error(x: Column) -> Column:
    """Sample deviation over the root of n; 0 for a single value."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def positive_concentration(gain: Column) -> Column:
    """The greatest positive gain over all positive gains; 1 if there are none."""
    up = F.greatest(gain, F.lit(0.0))
    return F.coalesce(F.max(up) / F.nullif(F.sum(up), F.lit(0.0)), F.lit(1.0))
