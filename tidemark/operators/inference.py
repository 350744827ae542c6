"""Long-run variances, tests and multiplicity control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newey_west(rows: DataFrame, keys: list[str], value: str, lag: int) -> DataFrame:
    """(keys, n, mean, variance, statistic): long-run variance of a mean with Bartlett weights."""
    centred = rows.withColumn("__x", F.col(value) - F.avg(value).over(W.partitionBy(*keys)))
    w = W.partitionBy(*keys).orderBy("ts")
    products = centred.withColumns({f"__g{k}": F.col("__x") * (F.lag("__x", k).over(w) if k else F.col("__x")) for k in range(lag + 1)})
    n = F.count(value)
    total = sum((F.sum(f"__g{k}") * (1.0 if k == 0 else 2.0 * (1 - k / (lag + 1))) for k in range(1, lag + 1)), F.sum("__g0"))
    out = products.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.greatest(total / n / n, F.lit(0.0)).alias("variance"))
    stat = F.when(F.col("variance") > 0, F.col("mean") / F.sqrt("variance")).when(F.col("mean") > 0, float("inf")).when(F.col("mean") < 0, float("-inf")).otherwise(0.0)
    return out.withColumn("statistic", stat)


def normal_survival(z: float) -> float:
    """The upper tail of the standard normal law."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def survival(z: Column, terms: int = 200) -> Column:
    """The same of a column, by the series of the error function whose terms are all positive."""
    x = F.least(F.abs(z), F.lit(9.0)) / math.sqrt(2.0)
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda acc, n: F.struct((acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"])
    erf = F.least(F.lit(1.0), whole * F.exp(-x * x) * (2.0 / math.sqrt(math.pi)))
    return F.when(z >= 9, 0.0).when(z <= -9, 1.0).when(z >= 0, (1.0 - erf) / 2.0).otherwise((1.0 + erf) / 2.0)


def predictive_test(rows: DataFrame, keys: list[str], value: str, lag: int, barred: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, mean, variance, statistic, p_value, p_holm): one-sided tests that the mean is positive.

    barred: names of hypotheses that were not tested; they count with a p-value of 1. Without any
    variance the statistic is infinite, of the mean's sign (negative for a mean of 0).
    """
    test = newey_west(rows, keys, value, lag)
    plain = F.when(F.col("variance") > 0, F.col("statistic")).when(F.col("mean") > 0, float("inf")).otherwise(float("-inf"))
    test = test.withColumn("statistic", plain).withColumn("p_value", survival(F.col("statistic")))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    pool = test.select(name.alias("name"), "p_value")
    if barred:
        pool = pool.union(rows.sparkSession.createDataFrame([(b, 1.0) for b in barred], "name string, p_value double"))
    adjusted = holm(pool).select(F.col("name").alias("__name"), "p_holm")
    return test.withColumn("__name", name).join(adjusted, "__name").drop("__name")


def holm(tests: DataFrame, name: str = "name", p: str = "p_value", keys: list[str] | None = None) -> DataFrame:
    """Adds p_holm: step-down adjusted values, monotone and at most 1; ties in order of name."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    order = part.orderBy(p, name)
    rank, m = F.row_number().over(order), F.count("*").over(part)
    step = tests.withColumn("__s", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    return step.withColumn("p_holm", F.max("__s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def benjamini_hochberg(tests: DataFrame, name: str = "name", p: str = "p_value", keys: list[str] | None = None) -> DataFrame:
    """Adds p_bh, the step-up values of the false discovery rate (an extension of ours)."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    rank, m = F.row_number().over(part.orderBy(p, name)), F.count("*").over(part)
    step = tests.withColumn("__s", F.least(F.lit(1.0), F.col(p) * m / rank))
    return step.withColumn("p_bh", F.min("__s").over(part.orderBy(F.desc(p), F.desc(name)).rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def autocorrelations(rows: DataFrame, keys: list[str], value: str, lags: int = 48) -> DataFrame:
    """(keys, lag, acf) of the squared values, all lags in one pass over one ordering."""
    w = W.partitionBy(*keys).orderBy("ts")
    sq = rows.withColumn("__q", F.col(value) * F.col(value))
    wide = sq.select(*keys, "__q", *[F.lag("__q", k).over(w).alias(f"__q{k}") for k in range(1, lags + 1)])
    one = wide.groupBy(*keys).agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.corr("__q", f"__q{k}").alias("acf")) for k in range(1, lags + 1)]).alias("a"))
    return one.select(*keys, F.inline("a"))


def block_length(acf: DataFrame, keys: list[str], level: float = 0.10, run: int = 3) -> DataFrame:
    """(keys, block_length): the first lag from which `run` lags in a row are within the level."""
    w = W.partitionBy(*keys).orderBy("lag")
    calm = acf.withColumn("__ok", F.abs("acf") <= level)
    ok = F.col("__ok")
    for k in range(1, run):
        ok = ok & F.coalesce(F.lead("__ok", k).over(w), F.lit(False))
    return calm.withColumn("__run", ok).groupBy(*keys).agg(F.min(F.when(F.col("__run"), F.col("lag"))).alias("block_length"))
