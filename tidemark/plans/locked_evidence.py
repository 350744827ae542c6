"""The locked period's evidence: measures, tests, intervals, gates, grades and the robustness matrix.

All tables are per key (a signal). Matched rows are those of `policy.matched_returns`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators import gates, inference, policy, resampling, summaries
from tidemark.sources.saved import save

#: Fixed values of the protocol.
ALPHA, POSITIVE_PARTS = 0.05, 2
BRIER, ECE = 0.001, 0.01
COVERAGE, DECISIONS, MONTH_SHARE = 0.10, 100, 0.40
BLOCKS, COSTS, TRIMS = (21, 14, 28), (10.0, 5.0, 20.0), (0.0, 0.01, 0.025, 0.05)
STABLE_SHARE, STATE_ROWS = 0.80, 100


def measures(matched: DataFrame, keys: list[str], part: str = "subperiod") -> DataFrame:
    """Twelve measures and the accuracy, overall and per part, in one pass of grouping sets."""
    y, active = F.col("target_up"), F.col("candidate_active")
    names = ("benchmark", "candidate")
    agg = [
        F.count("*").alias("rows"),
        *[F.avg(f"{n}_loss").alias(f"{n}_log_loss") for n in names],
        F.avg("incremental_log_loss").alias("incremental_log_loss"),
        *[F.avg(f"{n}_sq").alias(f"{n}_brier") for n in names],
        *[M.ece(F.col(f"{n}_probability"), y).alias(f"{n}_ece") for n in names],
        F.avg(active.cast("double")).alias("decision_coverage"),
        F.count_if(active).alias("nonzero_decisions"),
        F.coalesce(F.avg(F.when(active, F.col("candidate_net_return"))), F.lit(0.0)).alias("mean_net_edge_active"),
        F.sum("candidate_net_return").alias("cumulative_net_return"),
        M.accuracy(F.col("candidate_probability"), y).alias("accuracy"),
    ]
    sets = matched.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col(part)]], *keys, part).agg(*agg)
    return sets.withColumn(part, F.coalesce(F.col(part), F.lit("OVERALL")))


def month_shares(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month_share): the greatest month's part of all positive months' net returns; 1 if there is none."""
    m = summaries.monthly(matched, keys, "incremental_net_return")
    return m.groupBy(*keys).agg(F.when(F.max("share") > 0, F.max("share")).otherwise(1.0).alias("month_share"))


def checks(matched: DataFrame, keys: list[str], lag: int = 0, barred: tuple[str, ...] = ()) -> DataFrame:
    """The tests and the checks that need no resampling, one row a key."""
    test = inference.predictive_test(matched, keys, "incremental_log_loss", lag, barred)
    m = measures(matched, keys)
    gap = lambda n: F.col(f"candidate_{n}") - F.col(f"benchmark_{n}")
    whole = m.where("subperiod = 'OVERALL'").select(*keys, gap("brier").alias("brier_gap"), gap("ece").alias("ece_gap"), F.col("decision_coverage").alias("coverage"), F.col("nonzero_decisions").alias("decisions"))
    parts = m.where("subperiod <> 'OVERALL'").groupBy(*keys).agg(F.count_if(F.col("incremental_log_loss") > 0).alias("positive_parts"), F.count("*").alias("parts"), F.max(gap("brier")).alias("worst_part_brier_gap"))
    net = matched.groupBy(*keys).agg(F.avg("incremental_net_return").alias("mean_net_return"))
    row = test.join(whole, keys).join(parts, keys).join(net, keys).join(month_shares(matched, keys), keys)
    c = F.col
    return row.withColumns(
        {
            "positive_mean": c("mean") > 0,
            "holm_below_alpha": c("p_holm") < ALPHA,
            "enough_positive_parts": c("positive_parts") >= POSITIVE_PARTS,
            "calibration_gate": (c("brier_gap") <= BRIER) & (c("ece_gap") <= ECE),
            "positive_net_mean": c("mean_net_return") > 0,
            "enough_coverage": c("coverage") >= COVERAGE,
            "enough_decisions": c("decisions") >= DECISIONS,
            "spread_over_months": c("month_share") <= MONTH_SHARE,
        }
    )


def intervals(matched: DataFrame, keys: list[str], samples: int = 5000, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Intervals of the mean gain and net return for every block length."""
    return resampling.bootstrap_means(matched, keys, ["incremental_log_loss", "incremental_net_return"], blocks, samples)


def cost_sensitivity(pred: DataFrame, keys: list[str], slice_: list[str], threshold: float, costs: tuple[float, ...] = COSTS) -> DataFrame:
    """Coverage, decisions, turnover and sums of candidate and benchmark for every cost; slice_: where positions start."""
    table = pred.sparkSession.createDataFrame([(c,) for c in costs], "bps double")
    every = policy.matched_returns(pred.join(F.broadcast(table), F.lit(True)), [*slice_, "bps"], threshold, F.col("bps"))
    names = ("candidate", "benchmark")
    return every.groupBy(*keys, "bps").agg(
        F.count("*").alias("rows"),
        *[F.avg(F.col(f"{n}_active").cast("double")).alias(f"{n}_coverage") for n in names],
        *[F.count_if(f"{n}_active").alias(f"{n}_decisions") for n in names],
        *[F.sum(f"{n}_{m}").alias(f"{n}_{m}") for n in names for m in ("turnover", "gross_return", "net_return")],
        F.avg("incremental_net_return").alias("mean_incremental_net_return"),
        F.sum("incremental_net_return").alias("cumulative_incremental_net_return"),
    )


def locked_evidence(matched: DataFrame, keys: list[str], lag: int = 0, barred: tuple[str, ...] = (), samples: int = 5000, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Per key: tests, intervals of the first block length and the least bounds over all, gates and grade."""
    spans = save(intervals(matched, keys, samples, blocks), "intervals")
    row = checks(matched, keys, lag, barred)
    for value, name in (("incremental_log_loss", "gain"), ("incremental_net_return", "net")):
        mine = spans.where(F.col("value") == value)
        first = F.max(F.when(F.col("block") == blocks[0], F.struct("lower", "upper")))
        row = row.join(mine.groupBy(*keys).agg(first.alias("f"), F.min("lower").alias(f"{name}_least_lower")).select(*keys, F.col("f.lower").alias(f"{name}_lower"), F.col("f.upper").alias(f"{name}_upper"), f"{name}_least_lower"), keys)
    c = F.col
    predictive = c("positive_mean") & c("holm_below_alpha") & (c("gain_lower") > 0) & c("enough_positive_parts") & c("calibration_gate")
    economic = c("positive_net_mean") & (c("net_lower") > 0) & c("enough_coverage") & c("enough_decisions")
    row = row.withColumns({"predictive_gate": predictive, "economic_gate": economic})
    return row.withColumns({"evidence_grade": gates.evidence_grade(c("predictive_gate")), "determination": gates.determination(c("predictive_gate"), c("economic_gate"))})


def _bound(rows: DataFrame, keys: list[str], name: str, *values: str) -> DataFrame:
    """(keys, name): the least of the values over the rows."""
    return rows.groupBy(*keys).agg(F.min(F.least(*values) if len(values) > 1 else F.col(values[0])).alias(name))


def robustness_matrix(pred: DataFrame, matched: DataFrame, evidence: DataFrame, picks: DataFrame, keys: list[str], slice_: list[str], threshold: float, state: str = "regime") -> DataFrame:
    """(keys, diagnostic, status, observed, reference): fifteen diagnostics, each measured here.

    picks: (keys, model_family, signal_spec_id), what each outer fold of the development chose.
    """
    costs = cost_sensitivity(pred, keys, slice_, threshold).groupBy(*keys).agg(F.avg((F.col("mean_incremental_net_return") > 0).cast("double")).alias("costs"))
    month = F.date_format("ts", "yyyy-MM")
    both = ("incremental_log_loss", "incremental_net_return")
    left = [_bound(summaries.leave_one_out(matched, keys, month, v), keys, f"without_{i}", "mean_without") for i, v in enumerate(both)]
    trims = summaries.joint_trim(matched, keys, *both, list(TRIMS)).groupBy(*keys).agg(F.min(F.least(*[F.col(f"mean_{v}") for v in both])).alias("trimmed"), F.max_by("mean_incremental_log_loss", "fraction").alias("most_trimmed"))
    modes = summaries.component_modes(picks, keys, ["model_family", "signal_spec_id"]).groupBy(*keys).agg(*[F.max(F.when(F.col("component") == n, F.col("share"))).alias(f"share_{n}") for n in ("model_family", "signal_spec_id")])
    stress = matched.groupBy(*keys).agg(F.count_if(F.col(state) == "stress").cast("double").alias("stress"))
    terciles = _bound(summaries.confidence_terciles(matched, keys, "candidate_confidence", ["incremental_net_return"]), keys, "confidence", "mean_incremental_net_return")
    row = evidence
    for part in (costs, *left, trims, modes, stress, terciles):
        row = row.join(part, keys, "left")
    c = F.col
    one = lambda name, ok, observed, reference, otherwise: F.struct(F.lit(name).alias("diagnostic"), F.when(ok, "PASS").otherwise(otherwise).alias("status"), observed.cast("double").alias("observed"), F.lit(reference).cast("double").alias("reference"))
    rows = [
        one("confirmatory_multiplicity", c("p_holm") < ALPHA, c("p_holm"), ALPHA, "FAIL"),
        one("predictive_bootstrap_lower_bounds", c("gain_least_lower") > 0, c("gain_least_lower"), 0, "FAIL"),
        one("economic_bootstrap_lower_bounds", c("net_least_lower") > 0, c("net_least_lower"), 0, "FAIL"),
        one("cost_sensitivity_mean_sign", c("costs") == 1, c("costs"), 1, "CAUTION"),
        one("chronological_subperiod_sign", c("positive_parts") >= POSITIVE_PARTS, c("positive_parts"), POSITIVE_PARTS, "FAIL"),
        one("all_subperiods_positive", c("positive_parts") == c("parts"), c("positive_parts") / c("parts"), 1, "CAUTION"),
        one("overall_calibration_non_dominance", c("calibration_gate"), c("brier_gap"), BRIER, "FAIL"),
        one("subperiod_calibration_consistency", c("worst_part_brier_gap") <= 0, c("worst_part_brier_gap"), 0, "CAUTION"),
        one("monthly_positive_concentration", c("spread_over_months"), c("month_share"), MONTH_SHARE, "FAIL"),
        one("leave_one_month_out_mean_sign", (c("without_0") > 0) & (c("without_1") > 0), F.least("without_0", "without_1"), 0, "CAUTION"),
        one("joint_tail_trim_mean_sign", c("trimmed") > 0, c("most_trimmed"), 0, "CAUTION"),
        one("development_model_family_stability", c("share_model_family") >= STABLE_SHARE, c("share_model_family"), STABLE_SHARE, "CAUTION"),
        one("development_exact_signal_specification_stability", c("share_signal_spec_id") >= STABLE_SHARE, c("share_signal_spec_id"), STABLE_SHARE, "CAUTION"),
        one("stress_state_sample_sufficiency", c("stress") >= STATE_ROWS, c("stress"), STATE_ROWS, "CAUTION"),
        one("active_confidence_economic_consistency", c("confidence") > 0, c("confidence"), 0, "CAUTION"),
    ]
    return row.select(*keys, F.inline(F.array(*rows)))


def subperiod_economics(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Each third's predictive mean, and its net returns where there are any."""
    by = [*keys, "subperiod"]
    gain = matched.groupBy(*by).agg(F.count("*").alias("rows"), F.avg("incremental_log_loss").alias("mean_incremental_log_loss"))
    net = matched.groupBy(*by).agg(F.avg("incremental_net_return").alias("mean_incremental_net_return"), F.sum("incremental_net_return").alias("cumulative_incremental_net_return"))
    return gain.join(net, by, "left").withColumn("positive", F.col("mean_incremental_log_loss") > 0)


def fold_lookup(plan: DataFrame, wanted: DataFrame) -> DataFrame:
    """The plan's row of every wanted (level, horizon, outer_fold, inner_fold); each must have exactly one."""
    keys = ["level", "horizon", "outer_fold", "inner_fold"]
    found = wanted.join(F.broadcast(plan), keys, "left")
    n = found.groupBy(*keys).agg(F.count("n_train").alias("n")).where("n <> 1").count()
    if n:
        raise ValueError(f"{n} folds are not in the plan exactly once")
    return found


def state_summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per fold: rows, shares of the states, least probability, greatest error of their sum."""
    p = [F.col(f"state_p_{s}") for s in ("range", "trend", "stress")]
    return states.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[F.avg((F.col("state_label") == s).cast("double")).alias(f"{s}_share") for s in ("range", "trend", "stress")],
        F.min(F.least(*p)).alias("least_probability"),
        F.max(F.abs(p[0] + p[1] + p[2] - 1.0)).alias("sum_error"),
    )


def require_state_sums(states: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The states as they are, or an error where probabilities do not add up to 1."""
    bad = states.where(F.abs(F.col("state_p_range") + F.col("state_p_trend") + F.col("state_p_stress") - 1.0) > tolerance).count()
    if bad:
        raise ValueError(f"state probabilities of {bad} rows do not add up to 1")
    return states
