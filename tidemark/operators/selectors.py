"""Deterministic selections: aggregate, keep the eligible, sort by several keys, take the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.metrics import standard_error

BRIER_TOLERANCE, ECE_TOLERANCE = 0.0025, 0.02


def first_by(rows: DataFrame, context: list[str], order: list[Column]) -> DataFrame:
    """The first row of each context."""
    w = W.partitionBy(*context) if context else W.partitionBy(F.lit(1))
    return rows.withColumn("__r", F.row_number().over(w.orderBy(*order))).where("__r = 1").drop("__r")


def _gains(name: str = "positive_inner_folds") -> list[Column]:
    g = F.col("incremental_log_loss")
    return [F.count("*").alias("evaluation_rows"), F.avg(g).alias("mean_incremental_log_loss"), standard_error(g).alias("standard_error"), F.count_if(g > 0).alias(name)]


def _means(*names: str) -> list[Column]:
    return [F.avg(n).alias(f"mean_{n}") for n in names]


def complete_ids(rows: DataFrame, context: list[str], ident: str, fold: str, needed: int) -> DataFrame:
    """Evaluated rows of ids that have every fold."""
    whole = rows.where("status = 'EVALUATED'")
    ids = whole.groupBy(*context, ident).agg(F.countDistinct(fold).alias("__n")).where(F.col("__n") == needed)
    return whole.join(ids, [*context, ident], "left_semi")


def screening(inner: DataFrame, context: list[str], tolerance: float = BRIER_TOLERANCE) -> DataFrame:
    """The signal with the greatest mean gain among those whose Brier score is not worse; all if none."""
    g = inner.groupBy(*context, "signal_spec_id").agg(*_gains(), *_means("candidate_brier", "benchmark_brier"))
    g = g.withColumn("eligible", F.col("mean_candidate_brier") <= F.col("mean_benchmark_brier") + tolerance)
    return first_by(g, context, [F.desc("eligible"), F.desc("mean_incremental_log_loss"), F.desc("positive_inner_folds"), F.asc("standard_error"), F.asc("signal_spec_id")])


def structural(inner: DataFrame, context: list[str], tolerance: float = BRIER_TOLERANCE, ece: float = ECE_TOLERANCE) -> DataFrame:
    g = inner.groupBy(*context, "pipeline_id").agg(*_gains(), *_means("candidate_brier", "benchmark_brier", "candidate_ece", "benchmark_ece"), F.min("complexity_rank").alias("complexity_rank"))
    g = g.withColumn("eligible", (F.col("mean_candidate_brier") <= F.col("mean_benchmark_brier") + tolerance) & (F.col("mean_candidate_ece") <= F.col("mean_benchmark_ece") + ece))
    return first_by(g, context, [F.desc("eligible"), F.desc("mean_incremental_log_loss"), F.desc("positive_inner_folds"), F.asc("standard_error"), F.asc("complexity_rank"), F.asc("pipeline_id")])


def calibration(inner: DataFrame, context: list[str]) -> DataFrame:
    """Only methods all of whose rows are eligible; none is simpler than sigmoid."""
    g = inner.groupBy(*context, "calibration_method").agg(*_gains(), *_means("candidate_brier", "candidate_ece"), F.bool_and("eligible_for_selection").alias("eligible"))
    simple = F.when(F.col("calibration_method") == "none", 0).when(F.col("calibration_method") == "sigmoid", 1).otherwise(9)
    return first_by(g.where("eligible"), context, [F.desc("mean_incremental_log_loss"), F.desc("positive_inner_folds"), F.asc("mean_candidate_brier"), F.asc("mean_candidate_ece"), simple.asc()])


def abstention(inner: DataFrame, context: list[str], coverage: float = 0.10, decisions: int = 100) -> DataFrame:
    """The threshold with the greatest mean net edge among those used enough; 0 if none is."""
    g = inner.groupBy(*context, "threshold").agg(F.avg("coverage").alias("mean_coverage"), F.sum("nonzero_decisions").alias("total_nonzero_decisions"), F.avg("mean_net_edge").alias("mean_net_edge"), F.count_if(F.col("mean_net_edge") > 0).alias("positive_inner_folds"))
    g = g.withColumn("eligible", (F.col("mean_coverage") >= coverage) & (F.col("total_nonzero_decisions") >= decisions))
    g = g.where(F.col("eligible") | (F.col("threshold") == 0))
    return first_by(g, context, [F.desc("eligible"), F.desc("mean_net_edge"), F.desc("positive_inner_folds"), F.desc("mean_coverage"), F.asc("threshold")])


def family_horizon(admission: DataFrame) -> DataFrame:
    """The best admitted horizon of each family, or why none was."""
    best = first_by(admission.where("development_admission_pass"), ["signal_family"], [F.desc("mean_incremental_log_loss"), F.desc("positive_outer_folds"), F.asc("concentration"), F.asc("mean_candidate_brier"), F.asc("horizon")])
    best = best.select("signal_family", F.col("horizon").alias("selected_horizon"), F.col("mean_incremental_log_loss").alias("selected_gain"))
    why = admission.groupBy("signal_family").agg(F.array_sort(F.collect_list(F.struct("horizon", F.concat(F.lit("h"), F.col("horizon"), F.lit(":"), F.when(F.col("failure_reasons") == "", "UNSPECIFIED").otherwise(F.col("failure_reasons"))).alias("text")))).alias("r"))
    reasons = F.array_join(F.transform("r", lambda x: x["text"]), ";")
    admitted = F.col("selected_horizon").isNotNull()
    return why.join(best, "signal_family", "left").select(
        "signal_family",
        F.when(admitted, "PIPELINE_ADMITTED").otherwise("NO_PIPELINE_ADMITTED").alias("family_decision"),
        "selected_horizon",
        "selected_gain",
        F.when(admitted, "").otherwise(reasons).alias("rejection_reasons"),
    )


def component(inner: DataFrame, context: list[str], ident: list[str], needed: int | None = None, simplest: list[str] | None = None) -> DataFrame:
    """A final component: complete over all folds (`needed` rows, if given), then gain, positive rows, error,
    simplicity, id."""
    extra = [c for c in ("candidate_brier", "benchmark_brier", "candidate_ece", "benchmark_ece") if c in inner.columns]
    g = inner.groupBy(*context, *ident).agg(*_gains("positive_evaluations"), *_means(*extra))
    g = g if needed is None else g.where(F.col("evaluation_rows") == needed)
    if "benchmark_brier" in extra:
        g = g.where(F.col("mean_candidate_brier") <= F.col("mean_benchmark_brier") + BRIER_TOLERANCE)
    if "benchmark_ece" in extra:
        g = g.where(F.col("mean_candidate_ece") <= F.col("mean_benchmark_ece") + ECE_TOLERANCE)
    return first_by(g, context, [F.desc("mean_incremental_log_loss"), F.desc("positive_evaluations"), F.asc("standard_error"), *[F.asc(c) for c in simplest or []], *[F.asc(c) for c in ident]])


def evenly_spaced(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows of a group at even positions, first and last among them."""
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    numbered = rows.withColumns({"__n": n, "__i": F.row_number().over(w.orderBy("ts")) - 1})
    # Row i is taken if some k of 0..most-1 falls on it: floor(k * (n - 1) / (most - 1)) = i.
    k = F.ceil(F.col("__i") * F.lit(most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = F.floor(k * (F.col("__n") - 1) / F.lit(most - 1)) == F.col("__i")
    return numbered.where((F.col("__n") <= most) | hit).drop("__n", "__i")
