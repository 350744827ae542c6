"""Evidence tables over predictions: by set, month, state, confidence, and under trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.metrics import log_loss, squared_error


def scored(pred: DataFrame) -> DataFrame:
    """Adds losses, squared errors and their benchmark-minus-candidate differences."""
    y = F.col("target_up").cast("double")
    one = pred.withColumns({**{f"{n}_loss": log_loss(F.col(f"{n}_probability"), y) for n in ("candidate", "benchmark")}, **{f"{n}_sq": squared_error(F.col(f"{n}_probability"), y) for n in ("candidate", "benchmark")}})
    return one.withColumn("incremental_log_loss", F.col("benchmark_loss") - F.col("candidate_loss"))


def event_study(frame: DataFrame, positions: dict[str, str], cost_rate: float) -> DataFrame:
    """Per signal: events, sides, mean net signed return and win rate; two one-way costs an event."""
    long = frame.select("symbol", "ts", "future_return", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(c).alias("position")) for s, c in positions.items()])))
    net = F.when(F.col("position") != 0, F.col("position") * F.col("future_return") - 2 * cost_rate)
    one = long.where("future_return is not null").withColumn("net", net)
    return one.groupBy("symbol", "signal").agg(F.count_if(F.col("position") != 0).alias("event_count"), F.count_if(F.col("position") > 0).alias("long_events"), F.count_if(F.col("position") < 0).alias("short_events"), F.avg("net").alias("mean_net_signed_return"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate_after_cost"))


def regime_summary(pred: DataFrame, keys: list[str], regime: str) -> DataFrame:
    return pred.groupBy(*keys, regime).agg(F.count("*").alias("observations"), *[F.avg(c).alias(f"mean_{c}") for c in ("incremental_log_loss", "incremental_net_edge", "signal_net_return", "baseline_net_return")])


def calibration_sets(pred: DataFrame, keys: list[str], part: str = "subperiod") -> DataFrame:
    """Counts, mean losses and Brier scores overall and per part, in one pass of grouping sets."""
    agg = [F.count("*").alias("n"), F.avg("target_up").alias("mean_outcome"), F.avg("candidate_probability").alias("mean_probability"), *[F.avg(f"{n}_{m}").alias(f"{n}_{m}") for n in ("candidate", "benchmark") for m in ("loss", "sq")]]
    sets = pred.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col(part)]], *keys, part).agg(*agg)
    return sets.withColumn(part, F.coalesce(F.col(part), F.lit("OVERALL")))


def monthly(pred: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, month, rows, mean, total, share): shares of all positive months; 0 for others."""
    m = pred.groupBy(*keys, F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    up = F.greatest(F.col("total"), F.lit(0.0))
    return m.withColumn("share", F.coalesce(up / F.nullif(F.sum(up).over(W.partitionBy(*keys)), F.lit(0.0)), F.lit(0.0)))


def leave_one_out(pred: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """(keys, group, rows, mean_without): from group sums, one pass."""
    s = pred.groupBy(*keys, group.alias("left_out")).agg(F.count(value).alias("rows"), F.sum(value).alias("total"))
    w = W.partitionBy(*keys)
    return s.select(*keys, "left_out", "rows", ((F.sum("total").over(w) - F.col("total")) / F.nullif(F.sum("rows").over(w) - F.col("rows"), F.lit(0))).alias("mean_without"))


def joint_trim(pred: DataFrame, keys: list[str], a: str, b: str, fractions: list[float]) -> DataFrame:
    """(keys, fraction, rows, means) of rows inside both columns' inclusive quantile ranges."""
    edges = pred.groupBy(*keys).agg(*[F.percentile(c, F.array(*[F.lit(q) for f in fractions for q in (f, 1 - f)])).alias(f"__{c}") for c in (a, b)])
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(i).alias("i")) for i, f in enumerate(fractions)]))
    rows = pred.select(*keys, a, b).join(F.broadcast(edges), keys).withColumn("f", every)
    inside = lambda c: F.col(c).between(F.element_at(f"__{c}", 2 * F.col("f.i") + 1), F.element_at(f"__{c}", 2 * F.col("f.i") + 2))
    keep = (F.col("f.fraction") == 0) | (inside(a) & inside(b))
    return rows.where(keep).groupBy(*keys, F.col("f.fraction").alias("fraction")).agg(F.count("*").alias("rows"), F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"))


def stratify_states(pred: DataFrame, keys: list[str], state: str, values: list[str], least: int = 30) -> DataFrame:
    s = pred.groupBy(*keys, state).agg(F.count("*").alias("rows"), *[F.avg(c).alias(f"mean_{c}") for c in values])
    return s.withColumns({"share": F.col("rows") / F.sum("rows").over(W.partitionBy(*keys)), "interpretable": F.col("rows") >= least})


def confidence_terciles(pred: DataFrame, keys: list[str], confidence: str, values: list[str]) -> DataFrame:
    """Active rows by thirds of confidence: linear quantile edges, closed on the right."""
    active = pred.where("candidate_active")
    edges = active.groupBy(*keys).agg(F.percentile(confidence, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__e"))
    c, e = F.col(confidence), F.col("__e")
    name = F.when(c <= e[0], "Q1").when(c <= e[1], "Q2").otherwise("Q3")
    return active.join(F.broadcast(edges), keys).groupBy(*keys, name.alias("stratum")).agg(F.count("*").alias("rows"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def component_modes(rows: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """(keys, component, mode, count, share, stability); ties go to the smaller value."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("string").alias("value")) for c in components])))
    n = long.groupBy(*keys, "component", "value").agg(F.count("*").alias("count"))
    w = W.partitionBy(*keys, "component")
    top = n.withColumns({"share": F.col("count") / F.sum("count").over(w), "__r": F.row_number().over(w.orderBy(F.desc("count"), F.asc("value")))}).where("__r = 1")
    kind = F.when(F.col("share") >= 0.8, "STABLE").when(F.col("share") >= 0.6, "MODERATELY_STABLE").otherwise("DIFFUSE")
    return top.select(*keys, "component", F.col("value").alias("mode"), "count", "share", kind.alias("stability"))


def cumulative(pred: DataFrame, keys: list[str], value: str) -> DataFrame:
    return pred.withColumn(f"cumulative_{value}", F.sum(value).over(W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)))


def rolling_edge(pred: DataFrame, keys: list[str], value: str, rows: int) -> DataFrame:
    """Rolling mean over min(180, max(30, rows // 20)) rows, from max(15, a third of that) on."""
    size = min(180, max(30, rows // 20))
    frame = W.partitionBy(*keys).orderBy("ts").rowsBetween(1 - size, 0)
    return pred.withColumn(f"rolling_{value}", F.when(F.count(value).over(frame) >= max(15, size // 3), F.avg(value).over(frame)))


def regime_matrix(summary: DataFrame, regimes: list[str], value: str) -> DataFrame:
    """Signals by regimes, a column each."""
    return summary.groupBy("signal").pivot("regime", regimes).agg(F.first(value))
