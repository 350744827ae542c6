"""Structural-change monitor: a robust one-sided cumulative sum, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("incremental_log_loss", "incremental_net_edge")


def cusum(pred: DataFrame, keys: list[str], window: int = 180, slack: float = 0.10, limit: float = -8.0, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Adds calibrating, quality, cusum, structural_change_alarm, change_index.

    Each metric is centred by the calibration rows' median and scaled by the greatest of their
    1.4826 * MAD, a tenth of their deviation, and 1e-6, then held within six. S = min(0, S + q +
    slack) is C - max(0, running max of C) with C the running sum, so no recursion is needed.
    """
    w = W.partitionBy(*keys).orderBy("ts")
    n = F.count("*").over(W.partitionBy(*keys))
    size = F.least(F.greatest(F.lit(60), F.lit(window)).cast("long"), F.greatest(F.lit(60).cast("long"), F.floor(n / 3)))
    rows = pred.withColumns({"__rn": F.row_number().over(w), "__size": size}).withColumn("calibrating", F.col("__rn") <= F.col("__size"))
    whole = W.partitionBy(*keys)
    calm = lambda x: F.when(F.col("calibrating"), x)
    mid = rows.withColumns({**{f"__med_{m}": F.percentile(calm(F.col(m)), 0.5).over(whole) for m in metrics}, **{f"__sd_{m}": F.stddev_pop(calm(F.col(m))).over(whole) for m in metrics}})
    scaled = mid.withColumns({f"__mad_{m}": F.percentile(calm(F.abs(F.col(m) - F.col(f"__med_{m}"))), 0.5).over(whole) for m in metrics})
    z = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(m) - F.col(f"__med_{m}")) / F.greatest(1.4826 * F.col(f"__mad_{m}"), 0.1 * F.col(f"__sd_{m}"), F.lit(1e-6)))) for m in metrics]
    quality = F.when(F.col("calibrating"), 0.0).otherwise(sum(z[1:], z[0]) / float(len(z)))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    one = scaled.withColumn("quality", quality)
    two = one.withColumn("__c", F.sum(F.when(F.col("calibrating"), 0.0).otherwise(F.col("quality") + slack)).over(run))
    out = two.withColumn("cusum", F.col("__c") - F.greatest(F.lit(0.0), F.max("__c").over(run)))
    out = out.withColumns({"structural_change_alarm": F.col("cusum") <= limit, "change_index": F.log1p(F.greatest(F.lit(0.0), -F.col("cusum")) / -limit)})
    return out.drop(*[c for c in out.columns if c.startswith("__")])
