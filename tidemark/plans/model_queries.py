"""Queries that fit, resample or recurse: no SQL twin; tests hold them to properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import selectors, splits, states
from tidemark.plans import evidence_queries, first_generation, locked_evidence, second_generation
from tidemark.plans import inputs as N
from tidemark.sources.saved import is_saved, save


def _nested_frame(s, d):
    """Complete rows for the nested job, their number, and the targets of every horizon."""
    rows = I.complete_rows(N.features(s, d), [*dict.fromkeys([*second_generation.BASE, *states.INPUTS])])
    rows = save(rows, "rows")
    return rows, rows.count(), I.horizon_targets(N.panel(s, d))


def screen(s, d):
    rows, n, targets = _nested_frame(s, d)
    return N.out(second_generation.screen(second_generation.fold_rows(rows, targets, splits.nested_plan(s, n)), evidence_queries.scores(s, d)))


_NESTED: dict[tuple[str, str], dict] = {}


def nested(s, d) -> dict:
    """The nested job's tables; a session runs the job once for a folder and rereads what it wrote."""
    key = (s.sparkContext.applicationId, d)
    if key not in _NESTED or not all(map(is_saved, _NESTED[key].values())):
        rows, n, targets = _nested_frame(s, d)
        found = second_generation.nested_selection(rows, targets, evidence_queries.scores(s, d), n)
        _NESTED[key] = {name: save(df, name) for name, df in found.items() if name in ("outer", "admission", "decisions", "structural", "inner")}
    return _NESTED[key]


def components(s, d):
    """The final signal and structure of every family and horizon over all inner folds that were fitted."""
    context, t = ["signal_family", "horizon"], nested(s, d)
    kinds = []
    for table, ident in (("inner", "signal_spec_id"), ("structural", "pipeline_id")):
        rows = t[table]
        most = rows.groupBy(*context, ident).count().groupBy(*context).agg(F.max("count").alias("needed"))
        whole = rows.join(rows.groupBy(*context, ident).count().join(most, context).where(F.col("count") == F.col("needed")), [*context, ident], "left_semi")
        kept = selectors.component(whole, context, [ident])
        kinds.append(kept.select(*context, F.lit(ident).alias("component"), F.col(ident).alias("selected"), "evaluation_rows", "mean_incremental_log_loss", "positive_evaluations"))
    return N.out(kinds[0].unionByName(kinds[1]))


def robustness(s, d):
    """Fifteen diagnostics of every signal; what the development folds chose comes from the nested job."""
    pred, matched = N.predictions(s, d), save(N.matched(s, d), "matched")
    picks = nested(s, d)["outer"].where("horizon = 1").select(F.col("signal_family").alias("signal"), F.element_at(F.split("pipeline_id", "-"), 1).alias("model_family"), "signal_spec_id")
    evidence = locked_evidence.locked_evidence(matched, ["signal"], 0, (), 2000)
    return N.out(locked_evidence.robustness_matrix(pred, matched, evidence, picks, ["signal"], N.PRED_KEYS, 0.05))


def fold_states(s, d):
    """Shares and sums of the filtered states of every fold of the nested plan."""
    rows, n, targets = _nested_frame(s, d)
    folds = second_generation.fold_rows(rows, targets, splits.nested_plan(s, n)).withColumn("state_label", F.expr("CASE WHEN state_p_range >= state_p_trend AND state_p_range >= state_p_stress THEN 'range' WHEN state_p_trend >= state_p_stress THEN 'trend' ELSE 'stress' END"))
    return N.out(locked_evidence.state_summary(locked_evidence.require_state_sums(save(folds, "folds")), second_generation.FOLD))


def _three_folds(s, d):
    """Rows of three folds of one horizon, with one score."""
    rows, n, targets = _nested_frame(s, d)
    plan = splits.fold_table(s, n, 3, 1).select(F.lit(1).alias("horizon"), F.lit(1).alias("outer_fold"), F.col("fold").alias("inner_fold"), (F.col("train_end") + 1).alias("n_train"), "test_start", "test_end")
    score = rows.select("symbol", "ts", F.col("bb_reversal_score").alias("score"))
    return second_generation.scored_rows(second_generation.fold_rows(rows, targets, plan), score)


def structures(s, d):
    pred = save(second_generation.structures(_three_folds(s, d), second_generation.structure_tasks(s), second_generation.FOLD), "pred")
    return N.out(second_generation.fold_results(pred.withColumnRenamed("inner_fold", "fold"), ["pipeline_id", "fold"]))


def calibrations(s, d):
    """The simplest structure under every calibration, each fitted ahead of a gap before its calibration rows."""
    first = second_generation.structure_tasks(s).orderBy("complexity_rank").limit(1)
    tasks = first.withColumn("method", F.explode(F.array(*[F.lit(m) for m in ("none", "sigmoid", "isotonic")])))
    out = second_generation.structures(_three_folds(s, d), tasks, second_generation.FOLD)
    return N.out(out.groupBy("method", F.col("inner_fold").alias("fold")).agg(F.count("*").alias("n"), F.avg("candidate_probability").alias("mean_candidate"), F.avg("benchmark_probability").alias("mean_benchmark"), F.avg("incremental_log_loss").alias("incremental_log_loss")))


ENTRIES = {
    "inf_locked_evidence": (lambda s, d: N.out(locked_evidence.locked_evidence(save(N.matched(s, d), "matched"), ["signal"])), None),
    "gat_robustness_matrix": (robustness, None),
    "gat_admission_fitted": (lambda s, d: N.out(nested(s, d)["admission"]), None),
    "gat_family_decision_fitted": (lambda s, d: N.out(nested(s, d)["decisions"]), None),
    "sel_component_fitted": (components, None),
    "agg_state_shares": (fold_states, None),
    "mod_offset_screen": (screen, None),
    "mod_structures": (structures, None),
    "mod_calibrations": (calibrations, None),
    "sel_nested": (lambda s, d: N.out(nested(s, d)["outer"]), None),
    "v1_verdicts": (lambda s, d: N.out(first_generation.run(N.panel(s, d), first_generation.Config())["verdicts"]), None),
}
