"""Nested selection: screen signals, choose structure, calibration and threshold, evaluate outside.

The loops of folds and settings are data: a task table of (fold, setting) is joined to the rows and
fitted in one grouped call, and every selection is a window over results.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators import gates, grids, inference, models, newton, policy, selectors, splits, states, summaries
from tidemark.operators import structures as structure
from tidemark.sources import sinks
from tidemark.sources.saved import save

STATE_COLUMNS = ["state_p_range", "state_p_trend", "state_p_stress"]
CROSSED = [f"score_x_{s}" for s in states.STATES]
FOLD = ["horizon", "outer_fold", "inner_fold"]
BASE = ["pri_ret_1", "pri_ret_3", "ctx_ret_1", "ctx_ret_3", "trend_12", "vol_20", "range_12", "volume_z"]


def with_states(frame: DataFrame, train_until: str, starts: int = states.STARTS) -> DataFrame:
    """Adds filtered state probabilities of a model fitted on rows up to a time."""
    return frame.join(states.forward_filter(frame, states.fit(frame.where(F.col("ts") <= F.lit(train_until).cast(frame.schema["ts"].dataType)), starts)), ["symbol", "ts"], "left")


def fold_rows(frame: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Training and test rows of every fold of a nested plan (inner_fold 0 is the outer fold), with the
    states of a model fitted on that fold's training rows and the targets of that horizon."""
    numbered = frame.drop("future_return", "target_up").withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1)
    part = F.when(F.col("rn") < F.col("n_train"), "train").when(F.col("rn") < F.col("test_start"), "purge").otherwise("test")
    rows = numbered.join(F.broadcast(plan), F.col("rn") <= F.col("test_end")).withColumn("part", part).where("part <> 'purge'").select("symbol", "ts", *FOLD, "part", *dict.fromkeys([*BASE, *states.INPUTS]))
    facts = targets.select("symbol", "ts", "horizon", "future_return", F.col("direction").alias("target_up")).where("future_return is not null")
    return rows.join(states.fold_states(rows, FOLD), [*FOLD, "symbol", "ts"]).join(facts, ["symbol", "ts", "horizon"])


def scored_rows(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Fold rows with a score and its products with the state probabilities."""
    return rows.join(scores, ["symbol", "ts"]).withColumns({f"score_x_{s}": F.col("score") * F.col(f"state_p_{s}") for s in states.STATES})


def complete_scores(scores: DataFrame) -> DataFrame:
    """(symbol, ts) of the bars at which every specification of the table has a score."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    n = scores.select("spec_id").distinct().count()
    return scores.where(finite).groupBy("symbol", "ts").agg(F.count("*").alias("n")).where(F.col("n") == n).select("symbol", "ts")


def screen(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Every signal specification's one-step screen on every inner fold, on rows complete in all of them.

    The benchmarks of all folds are fitted at once by keyed Newton steps, once for all specifications.
    """
    inner = rows.where("inner_fold > 0").select("symbol", "ts", *FOLD, "part", *BASE, *STATE_COLUMNS, "target_up").na.drop()
    whole = save(inner.join(complete_scores(scores), ["symbol", "ts"]), "screened")
    based = save(newton.probabilities(newton.enough(whole, FOLD, "target_up"), FOLD, [*BASE, *STATE_COLUMNS], "target_up", name="p0"), "benchmark")
    return newton.offset_screens(based, FOLD, scores.select("symbol", "ts", "spec_id", "score"), "p0", STATE_COLUMNS, "target_up")


def structure_tasks(spark) -> DataFrame:
    """The whole grid of structures with its windows' lengths, uncalibrated."""
    return grids.structures(spark).join(F.broadcast(grids.dated_windows(spark)), "window").withColumn("method", F.lit("none"))


def structures(rows: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Scored test rows (keys, pipeline_id, method, ...) of tasks on rows with scores."""
    base = [*BASE, *STATE_COLUMNS]
    rows = save(rows.select(*dict.fromkeys([*keys, "horizon", "ts", "part", *base, "score", *CROSSED, *structure.FACTS])), "task-rows")
    smooth = structure.fit_tasks(rows, tasks.where("model <> 'boosting'"), keys, base, ["score"], CROSSED)
    trees = models.matched_tasks(rows, tasks.where("model = 'boosting'"), keys, base, ["score"], CROSSED)
    return summaries.scored(smooth.unionByName(trees))


def fold_results(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Per pipeline and fold: gain, Brier scores, calibration errors."""
    return pred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("incremental_log_loss").alias("incremental_log_loss"),
        *[F.avg(f"{n}_sq").alias(f"{n}_brier") for n in ("candidate", "benchmark")],
        *[M.ece(F.col(f"{n}_probability"), F.col("target_up")).alias(f"{n}_ece") for n in ("candidate", "benchmark")],
    )


def pipeline_hash(payload: dict) -> str:
    """The sha256 of a frozen pipeline, over all fields but the hash itself."""
    body = {k: v for k, v in payload.items() if k != "pipeline_hash"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class HoldoutGuard:
    """Lets the locked period be read once, and only for the frozen pipeline.

    The approval names the pipeline's hash; a family listed as barred, a changed pipeline, a second
    reading, or an output folder that exists already (of an earlier run) is refused.
    """

    frozen: dict
    approval: dict
    barred: tuple[str, ...] = ()
    output: str | None = None
    used: bool = False

    def open(self, rows: DataFrame, start: str, end: str) -> DataFrame:
        want = pipeline_hash(self.frozen)
        if self.frozen.get("pipeline_hash") != want or self.approval.get("pipeline_hash") != want:
            raise PermissionError("the pipeline is not the one approved")
        if not self.approval.get("approved"):
            raise PermissionError("no approval")
        if self.frozen.get("signal_family") in self.barred:
            raise PermissionError("the family was not admitted")
        if self.used or (self.output and sinks.exists(rows.sparkSession, self.output)):
            raise PermissionError("the locked period was read before")
        self.used = True
        return splits.between(rows, start, end)


def nested_selection(frame: DataFrame, targets: DataFrame, scores: DataFrame, n: int, horizons: tuple[int, ...] = splits.HORIZONS, outer: int = 5, inner: int = 3) -> dict[str, DataFrame]:
    """Per horizon, outer fold and family: signal, structure, calibration and threshold chosen on the
    inner folds, evaluated on the outer fold, and the admission that follows. n: rows of frame.

    Folds too short for a fit (120 training, 20 test rows) give no rows.
    """
    spark, context = frame.sparkSession, ["horizon", "outer_fold", "signal_family"]
    keys = [*context, "inner_fold"]
    rows, scores = save(fold_rows(frame, targets, splits.nested_plan(spark, n, horizons, outer, inner)), "folds"), save(scores, "scores")
    family = F.element_at(F.split("spec_id", "-"), 1).alias("signal_family")
    inner_rows = save(screen(rows, scores).select("horizon", "outer_fold", family, F.col("spec_id").alias("signal_spec_id"), "inner_fold", "incremental_log_loss", "candidate_brier", "benchmark_brier"), "inner_rows")
    signals = save(selectors.screening(inner_rows, context), "signals")
    chosen = save(scored_rows(rows.join(F.broadcast(signals.select(*context, F.col("signal_spec_id").alias("spec_id"))), ["horizon", "outer_fold"]), scores.withColumnRenamed("spec_id", "__s")).where("spec_id = __s").drop("__s"), "chosen")
    within = chosen.where("inner_fold > 0")

    grid = save(structure_tasks(spark), "grid")
    pred = save(structures(within, grid, keys), "pred")
    structural = save(fold_results(pred, [*keys, "pipeline_id"]).join(F.broadcast(grid.select("pipeline_id", "complexity_rank")), "pipeline_id"), "structural")
    pipelines = save(selectors.structural(structural, context, ece=0.01), "pipelines")

    picked = pipelines.select(*context, "pipeline_id").join(F.broadcast(grid.drop("method")), "pipeline_id")
    methods = picked.withColumn("method", F.explode(F.array(*[F.lit(m) for m in ("none", "sigmoid", "isotonic")])))
    cal_pred = save(structures(within, methods, keys), "cal_pred")
    calibrations = save(fold_results(cal_pred, [*keys, "method"]).withColumnRenamed("method", "calibration_method").withColumn("eligible_for_selection", F.col("calibration_method") != "isotonic"), "calibrations")
    # A method that a short fold could not hold out rows for is not compared on fewer folds than the others.
    folds = F.count("*").over(W.partitionBy(*context, "calibration_method"))
    complete = calibrations.withColumn("__n", folds).withColumn("__m", F.max("__n").over(W.partitionBy(*context))).where("__n = __m").drop("__n", "__m")
    fixed = save(selectors.calibration(complete, context), "fixed")

    method = fixed.select(*context, F.col("calibration_method").alias("method"))
    thresholds, cost = grids.policies(spark).select("threshold"), spark.createDataFrame([(10.0,)], "bps double")
    policies = save(policy.policy_metrics(cal_pred.join(F.broadcast(method), [*context, "method"]), keys, thresholds, cost), "policies")
    limits = save(selectors.abstention(policies, context), "limits")

    final = save(structures(chosen.where("inner_fold = 0"), picked.join(F.broadcast(method), context), context), "final")
    names = signals.select(*context, "signal_spec_id").join(pipelines.select(*context, "pipeline_id"), context).join(fixed.select(*context, "calibration_method"), context).join(limits.select(*context, "threshold"), context)
    used = policy.policy_metrics(final, context, thresholds, cost).select(*context, "threshold", *[F.col(c).alias(f"policy_{c}") for c in ("coverage", "nonzero_decisions", "mean_net_edge")])
    evaluated = save(fold_results(final, context).join(names, context).join(used, [*context, "threshold"]), "evaluated")
    admitted = gates.admission(evaluated)
    return {"inner": inner_rows, "selected": signals, "structural": structural, "pipelines": pipelines, "calibrations": calibrations, "calibrated": fixed, "policies": policies, "thresholds": limits, "outer": evaluated, "admission": admitted, "decisions": selectors.family_horizon(admitted)}
