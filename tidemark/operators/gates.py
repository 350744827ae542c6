"""Gates, decisions and statuses as case expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metrics import positive_concentration, standard_error

GATES = {"outer_folds": 5, "positive_folds": 3, "concentration": 0.60, "brier": 0.0025, "ece": 0.02, "coverage": 0.10, "decisions": 100}


def family_summary(outer: DataFrame, brier: float = GATES["brier"]) -> DataFrame:
    """Per family and horizon: gains, concentration, and the preliminary and stability gates."""
    g = F.col("incremental_log_loss")
    s = outer.groupBy("signal_family", "horizon").agg(
        F.countDistinct("outer_fold").alias("outer_folds"),
        F.avg(g).alias("mean_incremental_log_loss"),
        standard_error(g).alias("standard_error"),
        F.count_if(g > 0).alias("positive_outer_folds"),
        positive_concentration(g).alias("concentration"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("candidate_brier", "benchmark_brier", "candidate_ece", "benchmark_ece", "policy_coverage", "policy_mean_net_edge")],
        F.sum("policy_nonzero_decisions").alias("total_decisions"),
    )
    gate = (F.col("mean_incremental_log_loss") > 0) & (F.col("positive_outer_folds") >= GATES["positive_folds"]) & (F.col("concentration") <= GATES["concentration"])
    return s.withColumns({"preliminary_gate": gate, "stability_gate": gate & (F.col("mean_candidate_brier") <= F.col("mean_benchmark_brier") + brier)})


def admission(outer: DataFrame, gates: dict = GATES, contexts: int | None = None) -> DataFrame:
    """Eight checks per family and horizon, and the names of those that fail.

    contexts: how many pairs of family and horizon there must be; a result with fewer is refused.
    """
    s = family_summary(outer)
    if contexts is not None and (got := s.count()) != contexts:
        raise ValueError(f"{got} of {contexts} families and horizons were evaluated")
    c = F.col
    checks = {
        "COMPLETE_OUTER_FOLDS": c("outer_folds") == gates["outer_folds"],
        "POSITIVE_MEAN_INCREMENTAL_LOG_LOSS": c("mean_incremental_log_loss") > 0,
        "MINIMUM_POSITIVE_OUTER_FOLDS": c("positive_outer_folds") >= gates["positive_folds"],
        "FOLD_CONCENTRATION_CONTROL": c("concentration") <= gates["concentration"],
        "BRIER_NON_DOMINANCE": c("mean_candidate_brier") <= c("mean_benchmark_brier") + gates["brier"],
        "ECE_NON_DOMINANCE": c("mean_candidate_ece") <= c("mean_benchmark_ece") + gates["ece"],
        "MINIMUM_POLICY_COVERAGE": c("mean_policy_coverage") >= gates["coverage"],
        "MINIMUM_POLICY_DECISIONS": c("total_decisions") >= gates["decisions"],
    }
    failed = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))
    return s.withColumn("failure_reasons", F.array_join(failed, "|")).withColumn("development_admission_pass", c("failure_reasons") == "")


def established(gain: Column, edge: Column, positive: Column, folds: Column) -> Column:
    return (gain > 0) & (edge > 0) & (positive >= F.greatest(F.lit(1).cast("long"), F.ceil(folds * 0.6)))


def status(is_established: Column, alarm: Column, gain: Column, lower: Column, upper: Column) -> Column:
    """NOT_ESTABLISHED, SUSPENDED, ACTIVE or REDUCED."""
    return F.when(~is_established, "NOT_ESTABLISHED").when(alarm & (gain <= 0) & (upper <= 0), "SUSPENDED").when(~alarm & (gain > 0) & (lower > 0), "ACTIVE").otherwise("REDUCED")


def event_verdict(events: Column, lower: Column, upper: Column, p: Column) -> Column:
    return F.when(events < 30, "INSUFFICIENT_EVENTS").when((lower > 0) & (p < 0.05), "DESCRIPTIVE_EDGE").when(upper <= 0, "NO_DESCRIPTIVE_EDGE").otherwise("INCONCLUSIVE")


#: The names of grades, determinations and fragility classes.
NO_EVIDENCE, PREDICTIVE_ONLY = "NO_INCREMENTAL_EVIDENCE", "PREDICTIVE_EVIDENCE_ONLY"
DETERMINATIONS = ("LOCKED_EVALUATION_PREDICTIVE_GATE_FAILED", "PREDICTIVE_GATE_PASSED_ECONOMIC_GATE_FAILED", "PREDICTIVE_AND_ECONOMIC_GATES_PASSED_ROBUSTNESS_PENDING")
ROBUSTNESS = ("FAVOURABLE_MEANS_NOT_CONFIDENCE_ROBUST", "MIXED_DIAGNOSTIC_STABILITY", "BROAD_DIAGNOSTIC_STABILITY")
FRAGILITY = ("UNCERTAINTY_AND_PARAMETER_SPECIFICATION_SENSITIVE", "MODERATE_DIAGNOSTIC_FRAGILITY", "LOW_OBSERVED_DIAGNOSTIC_FRAGILITY")


def evidence_grade(predictive: Column) -> Column:
    """No grade rises above predictive evidence before robustness is known."""
    return F.when(predictive, PREDICTIVE_ONLY).otherwise(NO_EVIDENCE)


def determination(predictive: Column, economic: Column) -> Column:
    return F.when(~predictive, DETERMINATIONS[0]).when(~economic, DETERMINATIONS[1]).otherwise(DETERMINATIONS[2])


def diagnostic_class(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) counts of PASS, CAUTION and FAIL over diagnostics, the class and the fragility they give."""
    n = matrix.groupBy(*(keys or [])).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "CAUTION", "FAIL")])
    pick = lambda names: F.when(F.col("fail") > 0, names[0]).when(F.col("caution") > 0, names[1]).otherwise(names[2])
    return n.withColumns({"robustness_class": pick(ROBUSTNESS), "fragility_class": pick(FRAGILITY)})
