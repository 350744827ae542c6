"""The second generation's jobs, stage after stage: each gives named tables, written with a manifest.

scaffold -> causal_engine -> selection -> freeze -> locked -> inference -> robustness; `run` does them
all under one folder and checks every stage against its manifest. Fixed dates come from a registry.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import checks, gates, grids, policy, selectors, splits, states, summaries
from tidemark.plans import locked_evidence, second_generation
from tidemark.sources import sinks
from tidemark.sources.saved import save

NEEDED = [*dict.fromkeys([*second_generation.BASE, *states.INPUTS])]
CONTEXT = ["signal_family", "horizon"]


def development_partition(panel: DataFrame, registry: dict) -> DataFrame:
    """The development period's rows; an empty period, or one that reaches the locked one, is refused."""
    rows = splits.between(panel, registry["development"]["start"], registry["development"]["end"])
    checks.require_before(rows, registry["locked"]["start"])
    checks.require_rows(rows, 1, "development period")
    return rows


def require_unique_times(frame: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The frame, or an error if a series has a time twice or none."""
    bad = frame.groupBy(*keys, "ts").agg(F.count("*").alias("n")).where("n > 1 or ts is null")
    if not bad.isEmpty():
        raise ValueError("a series has missing or repeated times")
    return frame


def scaffold(panel: DataFrame, registry: dict) -> dict[str, DataFrame]:
    """Partition, targets of every horizon, fold plan, inventories."""
    spark, rows = panel.sparkSession, require_unique_times(development_partition(panel, registry))
    n = I.complete_rows(I.feature_frame(rows), NEEDED).count()
    v = registry["validation"]
    return {
        "partition": rows,
        "targets": I.horizon_targets(rows, tuple(registry["horizons"])),
        "fold_plan": splits.nested_plan(spark, n, tuple(registry["horizons"]), v["outer"], v["inner"]),
        "candidates": grids.candidates(spark),
        "specifications": grids.signal_specs(spark).drop("ordinal"),
    }


def prefix_audit(build: Callable[[DataFrame], DataFrame], panel: DataFrame, until: str) -> DataFrame:
    """(spec_id, max_error, null_mismatches): scores and events of a cut series against those of the whole one."""
    cut = F.col("ts") <= F.lit(until).cast(panel.schema["ts"].dataType)
    part = build(panel.where(cut)).select("symbol", "ts", "spec_id", F.col("score").alias("s"), F.col("event").alias("e"))
    both = build(panel).where(cut).join(part, ["symbol", "ts", "spec_id"], "left")
    gap = F.greatest(F.abs(F.col("score") - F.col("s")), F.abs(F.col("event") - F.col("e")))
    return both.groupBy("spec_id").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("max_error"), F.count_if((F.col("score").isNull() != F.col("s").isNull()) | (F.col("event").isNull() != F.col("e").isNull())).alias("null_mismatches"))


def fold_parameters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameters, sha256, least_eigenvalue, transition_error) of every fold's state model."""
    found = states.parameter_text(states.fit_folds(rows, keys), keys)
    schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys) + ", parameters string, least_eigenvalue double, transition_error double"
    fitted = rows.sparkSession.createDataFrame([(*fold, *rest) for fold, *rest in found], schema)
    return fitted.withColumn("sha256", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "parameters"), 256))


def causal_engine(tables: dict[str, DataFrame], build: Callable[[DataFrame], DataFrame], until: str) -> dict[str, DataFrame]:
    """Features, the audit of all specifications, every fold's states and their parameters."""
    panel = tables["partition"]
    features = save(I.complete_rows(I.feature_frame(panel), NEEDED), "features")
    folds = save(second_generation.fold_rows(features, tables["targets"], tables["fold_plan"]), "folds")
    label = F.array_max(F.array(*[F.struct(F.col(f"state_p_{s}").alias("p"), F.lit(s).alias("s")) for s in states.STATES]))["s"]
    labelled = locked_evidence.require_state_sums(folds.withColumn("state_label", label))
    return {"features": features, "scores": build(panel), "prefix_audit": prefix_audit(build, panel, until), "folds": folds, "state_summary": locked_evidence.state_summary(labelled, second_generation.FOLD), "state_parameters": fold_parameters(folds, second_generation.FOLD)}


def freeze(tables: dict[str, DataFrame], decisions: DataFrame) -> list[dict]:
    """A record of each admitted family's pipeline, chosen over all its inner folds; with its hash.

    decisions: (signal_family, family_decision, selected_horizon); there is one row a family.
    """
    admitted = decisions.where("family_decision = 'PIPELINE_ADMITTED'").select("signal_family", F.col("selected_horizon").cast("int").alias("horizon"))
    if admitted.isEmpty():
        return []
    of = lambda name: tables[name].join(F.broadcast(admitted), CONTEXT, "left_semi")
    grid = second_generation.structure_tasks(decisions.sparkSession)
    signal = selectors.component(_whole(of("inner"), "signal_spec_id"), CONTEXT, ["signal_spec_id"])
    structure = selectors.component(_whole(of("structural"), "pipeline_id"), CONTEXT, ["pipeline_id"]).select(*CONTEXT, "pipeline_id").join(F.broadcast(grid), "pipeline_id")
    chosen = [signal.select(*CONTEXT, "signal_spec_id"), structure.select(*CONTEXT, "pipeline_id", "model", "setting", "window", "rows", "regime_conditioned"), selectors.calibration(of("calibrations"), CONTEXT).select(*CONTEXT, "calibration_method"), selectors.abstention(of("policies"), CONTEXT).select(*CONTEXT, "threshold")]
    row = chosen[0]
    for part in chosen[1:]:
        row = row.join(part, CONTEXT)
    records = [{**r.asDict(), "target": "future_return_direction", "locked_period_read": False} for r in row.orderBy(*CONTEXT).collect()]
    return [{**r, "pipeline_hash": second_generation.pipeline_hash(r)} for r in records]


def _whole(rows: DataFrame, ident: str) -> DataFrame:
    """Rows of the ids that were evaluated on as many folds as any other of their context."""
    n = F.count("*").over(W.partitionBy(*CONTEXT, ident))
    return rows.withColumn("__n", n).withColumn("__m", F.max("__n").over(W.partitionBy(*CONTEXT))).where("__n = __m").drop("__n", "__m")


def locked(panel: DataFrame, build: Callable[[DataFrame], DataFrame], record: dict, approval: dict, registry: dict, barred: tuple[str, ...] = (), output: str | None = None) -> dict[str, DataFrame]:
    """The frozen pipeline fitted on all development rows and read once on the locked period's.

    A target counts only if both its bar and the bar it looks at lie in one period, so no row is judged
    by bars beyond the locked end, however far the panel goes on.
    """
    horizon = record["horizon"]
    guard = second_generation.HoldoutGuard(record, approval, barred, output)
    both = registry["development"]["start"], registry["locked"]["end"]
    rows = save(I.complete_rows(I.feature_frame(guard.open(panel, *both)), NEEDED), "locked-rows")
    until, start = F.lit(registry["development"]["end"]).cast("timestamp"), F.lit(registry["locked"]["start"]).cast("timestamp")
    n_train = rows.where(F.col("ts").cast("timestamp") <= until).count() - horizon
    first, last = rows.where(F.col("ts").cast("timestamp") < start).count(), rows.count() - 1
    plan = panel.sparkSession.createDataFrame([(horizon, 0, 0, n_train, first, last)], "horizon int, outer_fold int, inner_fold int, n_train long, test_start long, test_end long")
    scores = build(panel).where(F.col("spec_id") == record["signal_spec_id"]).select("symbol", "ts", "score")
    spans = [(registry[k]["start"], registry[k]["end"]) for k in ("development", "locked")]
    targets = I.bounded_targets(I.horizon_targets(panel, (horizon,)), spans)
    folds = second_generation.scored_rows(second_generation.fold_rows(rows, targets, plan), scores)
    task = panel.sparkSession.createDataFrame([(record["pipeline_id"], record["model"], record["setting"], record["rows"], record["regime_conditioned"], record["calibration_method"])], "pipeline_id string, model string, setting string, rows int, regime_conditioned boolean, method string")
    pred = second_generation.structures(folds, task, second_generation.FOLD)
    facts = folds.select("ts", "state_p_range", "state_p_trend", "state_p_stress").withColumn("regime", F.array_max(F.array(*[F.struct(F.col(f"state_p_{s}").alias("p"), F.lit(s).alias("s")) for s in states.STATES]))["s"]).select("ts", "regime")
    pred = splits.thirds(pred.join(facts, "ts", "left").withColumn("signal", F.lit(record["signal_family"])), ["signal"])
    pred = save(pred, "locked-predictions")
    matched = save(policy.matched_returns(pred, ["signal"], record["threshold"]), "locked-matched")
    return {"predictions": pred, "matched": matched, "measures": locked_evidence.measures(matched, ["signal"])}


def inference_and_robustness(tables: dict[str, DataFrame], record: dict, outer: DataFrame, barred: tuple[str, ...] = (), samples: int = 5000) -> dict[str, DataFrame]:
    """Tests, intervals, costs, gates and grade of the locked rows; then the diagnostics and their class."""
    pred, matched = tables["predictions"], tables["matched"]
    evidence = save(locked_evidence.locked_evidence(matched, ["signal"], record["horizon"] - 1, barred, samples), "evidence")
    picks = outer.where((F.col("signal_family") == record["signal_family"]) & (F.col("horizon") == record["horizon"])).select(F.col("signal_family").alias("signal"), F.element_at(F.split("pipeline_id", "-"), 1).alias("model_family"), "signal_spec_id")
    matrix = save(locked_evidence.robustness_matrix(pred, matched, evidence, picks, ["signal"], ["signal"], record["threshold"]), "matrix")
    return {"evidence": evidence, "intervals": locked_evidence.intervals(matched, ["signal"], samples), "costs": locked_evidence.cost_sensitivity(pred, ["signal"], ["signal"], record["threshold"]), "subperiods": locked_evidence.subperiod_economics(matched, ["signal"]), "months": summaries.monthly(matched, ["signal"], "incremental_net_return"), "matrix": matrix, "classes": gates.diagnostic_class(matrix, ["signal"])}


def load_frozen(spark: SparkSession, path: str, registry: dict) -> list[dict]:
    """The frozen pipelines of a file, each checked against its hash, and the file against the registry."""
    body = sinks.read_json(spark, path)
    if set(body) != {"pipelines", "registry"}:
        raise ValueError("not a file of frozen pipelines")
    if body["registry"] != sinks.json_sha256(registry):
        raise PermissionError("the pipelines were frozen under another registry")
    families = [r.get("signal_family") for r in body["pipelines"]]
    if len(set(families)) != len(families):
        raise ValueError("a family was frozen twice")
    for r in body["pipelines"]:
        if r.get("pipeline_hash") != second_generation.pipeline_hash(r):
            raise PermissionError(f"the pipeline of {r.get('signal_family')} is not the one frozen")
        if r.get("horizon") not in registry["horizons"]:
            raise ValueError("a horizon that the registry does not have")
    return body["pipelines"]


def verify_locked(tables: dict[str, DataFrame], evidence: DataFrame, registry: dict) -> list[str]:
    """What is wrong with a locked stage: rows that repeat or lie outside the period, numbers that are not
    finite, probabilities and p-values out of range, flags that contradict what they are made from."""
    pred, wrong = tables["predictions"], []
    kind = pred.schema["ts"].dataType
    start, end = (F.lit(registry["locked"][k]).cast(kind) for k in ("start", "end"))
    p = [F.col(f"{n}_probability") for n in ("benchmark", "candidate")]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    checks = {
        "rows outside the locked period": ~F.col("ts").between(start, end),
        "probabilities out of range": ~(finite(p[0]) & finite(p[1]) & (F.least(*p) > 0) & (F.greatest(*p) < 1)),
        "returns that are not finite": ~finite(F.col("future_return")),
        "outcomes that contradict the return": (F.col("future_return") > 0).cast("int") != F.col("target_up"),
        "gains that contradict the losses": F.abs(F.col("incremental_log_loss") - (F.col("benchmark_loss") - F.col("candidate_loss"))) > 1e-12,
    }
    found = pred.agg(F.count("*").alias("rows"), F.countDistinct("ts").alias("bars"), *[F.count_if(c).alias(name) for name, c in checks.items()]).first()
    wrong += [name for name in checks if found[name]]
    wrong += ["rows that repeat"] if found["rows"] != found["bars"] else []
    wrong += ["no rows"] if not found["rows"] else []
    row = evidence.first()
    numbers = [row[c] for c in ("mean", "p_value", "p_holm", "gain_lower", "net_lower")]
    if any(v is None or v != v or abs(v) == float("inf") for v in numbers):
        wrong.append("evidence that is not finite")
    elif not (0 <= row["p_value"] <= row["p_holm"] <= 1):
        wrong.append("p-values out of range")
    elif row["n"] != found["rows"]:
        wrong.append("evidence of other rows")
    return wrong


def model_card(record: dict, evidence: dict) -> str:
    """Identity, admission, determination and limits of a frozen pipeline, as Markdown."""
    lines = ["# Frozen pipeline", "", "## Identity", ""]
    lines += [f"- {k.replace('_', ' ')}: `{record[k]}`" for k in ("signal_family", "signal_spec_id", "horizon", "model", "setting", "window", "regime_conditioned", "calibration_method", "threshold", "pipeline_hash")]
    lines += ["", "## Locked period", ""] + [f"- {k.replace('_', ' ')}: `{evidence[k]}`" for k in ("mean", "p_value", "p_holm", "positive_parts", "mean_net_return", "net_lower", "evidence_grade", "determination")]
    return "\n".join([*lines, "", "## Limits", "", "Admission in development is no claim about the locked period. Means do not override adjusted tests, intervals or gates. The pipeline was not changed after the locked period was read.", ""])


def evidence_report(evidence: list[dict], classes: list[dict], unadmitted: list[str]) -> str:
    """The determination of every family and the evidence behind it, as Markdown."""
    head = ["# Evidence report", "", "| family | mean gain | p | adjusted p | lower bound | net lower bound | coverage | decisions | grade |", "|-|-|-|-|-|-|-|-|-|"]
    rows = [f"| {e['signal']} | {e['mean']:.9f} | {e['p_value']:.6f} | {e['p_holm']:.6f} | {e['gain_lower']:.9f} | {e['net_lower']:.9f} | {e['coverage']:.2%} | {e['decisions']} | {e['evidence_grade']} |" for e in evidence]
    rows += [f"| {f} | | 1 | 1 | | | | | {gates.NO_EVIDENCE} (not admitted) |" for f in unadmitted]
    tail = [f"Robustness of {c['signal']}: {c['robustness_class']}, {c['fragility_class']} ({c['pass']} passed, {c['caution']} with caution, {c['fail']} failed)." for c in classes]
    return "\n".join([*head, *rows, "", *tail, ""])


def run(panel: DataFrame, build: Callable[[DataFrame], DataFrame], registry: dict, path: str, approve: Callable[[dict], dict], audit_until: str, samples: int = 5000) -> dict:
    """All stages, written under path and checked against their manifests; the locked ones only for
    admitted families that `approve` approves."""
    spark, v = panel.sparkSession, registry["validation"]
    manifests: dict = {}

    def stage(name: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        manifests[name] = sinks.write_stage(tables, f"{path}/{name}")
        if wrong := sinks.verify_stage(spark, f"{path}/{name}"):
            raise ValueError(f"{name}: {', '.join(wrong)} changed after they were written")
        return {t: spark.read.schema(df.schema).parquet(f"{path}/{name}/{t}") for t, df in tables.items()}

    base = stage("scaffold", scaffold(panel, registry))
    engine = stage("causal", causal_engine(base, build, audit_until))
    if not engine["prefix_audit"].where("max_error > 1e-9 or null_mismatches > 0").isEmpty():
        raise ValueError("a feature changes when later bars are added")
    found = second_generation.nested_selection(engine["features"], base["targets"], engine["scores"].select("symbol", "ts", "spec_id", "score"), engine["features"].count(), tuple(registry["horizons"]), v["outer"], v["inner"])
    chosen = stage("selection", found)
    records = freeze(chosen, chosen["decisions"])
    sinks.write_json(spark, {"pipelines": records, "registry": sinks.json_sha256(registry)}, f"{path}/frozen")
    records = load_frozen(spark, f"{path}/frozen", registry)
    families = sorted(r["signal_family"] for r in chosen["decisions"].select("signal_family").collect())
    barred = tuple(f for f in families if f not in {r["signal_family"] for r in records})
    evidence, classes = [], []
    for r in records:  # one record a family
        name = f"locked-{r['signal_family']}"
        tables = stage(name, locked(panel, build, r, approve(r), registry, barred, f"{path}/{name}"))
        done = stage(f"inference-{r['signal_family']}", inference_and_robustness(tables, r, chosen["outer"], barred, samples))
        if wrong := verify_locked(tables, done["evidence"], registry):
            raise ValueError(f"{name}: {'; '.join(wrong)}")
        row = done["evidence"].first().asDict()
        evidence.append(row)
        classes += [c.asDict() for c in done["classes"].collect()]
        sinks.write_json(spark, {"card": model_card(r, row)}, f"{path}/card-{r['signal_family']}")
    sinks.write_json(spark, {"report": evidence_report(evidence, classes, list(barred))}, f"{path}/report")
    return {"manifests": manifests, "pipelines": records, "evidence": evidence, "not_admitted": list(barred)}


def main(argv: list[str] | None = None) -> int:
    """Command line: a folder of raw tables, a registry and an output folder; approvals from a JSON file."""
    from tidemark.plans import evidence_queries
    from tidemark.sources import bars as B

    args = argparse.ArgumentParser(description="The second generation's stages.")
    for name in ("tables", "registry", "out", "audit-until"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--approvals"), args.add_argument("--samples", type=int, default=5000)
    a = args.parse_args(argv)
    try:
        registry = sinks.ExperimentRegistry.load(open(a.registry).read()).payload
        approvals = json.load(open(a.approvals)) if a.approvals else {}
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        panel = B.aligned(B.index_bars(B.event_ticks(spark, a.tables)))
        done = run(panel, evidence_queries.spec_scores, registry, a.out, lambda r: approvals.get(r["signal_family"], {}), a.audit_until, a.samples)
        print(json.dumps({"pipelines": [r["pipeline_hash"] for r in done["pipelines"]], "not_admitted": done["not_admitted"]}, sort_keys=True))
        return 0
    except Exception as e:  # the command line reports and exits with 1
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
