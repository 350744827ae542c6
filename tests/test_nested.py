"""The nested job covers every horizon, fold, structure, calibration and threshold."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates
from tidemark.plans import evidence_queries, inputs, model_queries, second_generation, stages
from tidemark.sources import sinks


def test_nested_job_is_whole(spark):
    d = "/root/testdata/sf0.01"
    rows, n, targets = model_queries._nested_frame(spark, d)
    t = second_generation.nested_selection(rows, targets, evidence_queries.scores(spark, d), n, (1, 6), 2, 2)
    assert {tuple(r) for r in t["selected"].select("horizon", "outer_fold").collect()} == {(h, o) for h in (1, 6) for o in (1, 2)}
    assert t["inner"].groupBy("horizon", "outer_fold", "inner_fold").count().where("count <> 84").isEmpty()
    assert t["structural"].groupBy("horizon", "outer_fold", "inner_fold", "signal_family").count().where("count <> 90").isEmpty()
    assert {r[0] for r in t["calibrations"].select("calibration_method").collect()} == {"none", "sigmoid", "isotonic"}
    assert t["policies"].select("threshold").distinct().count() == 4
    outer = t["outer"].collect()
    assert len(outer) == 8 and all(r["n"] >= 20 and r["signal_spec_id"].startswith(r["signal_family"]) for r in outer)
    gains = {(r["outer_fold"], r["signal_family"]): set() for r in outer}
    for r in outer:
        gains[r["outer_fold"], r["signal_family"]].add(r["incremental_log_loss"])
    assert all(len(g) == 2 for g in gains.values())  # a horizon's result is its own
    with pytest.raises(ValueError, match="4 of 8"):
        gates.admission(t["outer"], contexts=8)
    frozen_and_locked(spark, d, t)


def frozen_and_locked(spark, d, t):
    """One family taken as admitted: frozen, read once on later rows, tested, put into words."""
    decisions = spark.createDataFrame([("bollinger", "PIPELINE_ADMITTED", 1), ("rsi", "NO_PIPELINE_ADMITTED", None)], "signal_family string, family_decision string, selected_horizon int")
    assert stages.freeze(t, decisions.where("selected_horizon is null")) == []
    (record,) = stages.freeze(t, decisions)
    assert record["pipeline_hash"] == second_generation.pipeline_hash(record) and record["signal_spec_id"].startswith("bollinger") and record["threshold"] in (0.0, 0.02, 0.05, 0.1)
    registry = {"development": {"start": "2024-01-01", "end": "2024-01-24 00:00:00"}, "locked": {"start": "2024-01-24 01:00:00", "end": "2024-01-28 12:00:00"}, "horizons": [1, 6]}
    panel = inputs.panel(spark, d)
    assert not panel.where("ts > timestamp '2024-01-28 12:00:00'").isEmpty()  # the panel goes on
    with pytest.raises(PermissionError):
        stages.locked(panel, evidence_queries.spec_scores, record, {}, registry)
    tables = stages.locked(panel, evidence_queries.spec_scores, record, {"approved": True, "pipeline_hash": record["pipeline_hash"]}, registry, ("rsi",))
    assert tables["predictions"].where("ts <= timestamp '2024-01-24 00:00:00'").isEmpty() and tables["measures"].count() == 4
    assert tables["predictions"].where("ts >= timestamp '2024-01-28 12:00:00'").isEmpty()  # the last row's target lies beyond the end
    done = stages.inference_and_robustness(tables, record, t["outer"], ("rsi",), 200)
    evidence = done["evidence"].first().asDict()
    assert 0 < evidence["p_value"] <= evidence["p_holm"] <= 1 and done["matrix"].count() == 15 and done["intervals"].count() == 6
    assert record["pipeline_hash"] in stages.model_card(record, evidence)
    assert stages.verify_locked(tables, done["evidence"], registry) == []
    bad = tables["predictions"].unionByName(tables["predictions"].limit(1).withColumn("candidate_probability", F.lit(1.5)))
    assert set(stages.verify_locked(tables | {"predictions": bad}, done["evidence"], registry)) == {"probabilities out of range", "rows that repeat", "evidence of other rows"}
    early = {**registry, "locked": {**registry["locked"], "start": "2024-01-26"}}
    assert stages.verify_locked(tables, done["evidence"], early) == ["rows outside the locked period"]
    assert "| rsi |" in stages.evidence_report([evidence], [r.asDict() for r in done["classes"].collect()], ["rsi"])


def test_frozen_files_are_checked(spark, tmp_path):
    registry = {"horizons": [1, 2], "locked": {}}
    record = {"signal_family": "rsi", "horizon": 1, "threshold": 0.05}
    record["pipeline_hash"] = second_generation.pipeline_hash(record)
    write = lambda name, body: sinks.write_json(spark, body, f"{tmp_path}/{name}") or f"{tmp_path}/{name}"
    own = sinks.json_sha256(registry)
    assert stages.load_frozen(spark, write("good", {"pipelines": [record], "registry": own}), registry) == [record]
    assert stages.load_frozen(spark, write("none", {"pipelines": [], "registry": own}), registry) == []
    other = {**record, "horizon": 3}
    other["pipeline_hash"] = second_generation.pipeline_hash(other)
    for name, body, error in (
        ("changed", {"pipelines": [{**record, "threshold": 0.1}], "registry": own}, PermissionError),
        ("elsewhere", {"pipelines": [record], "registry": "0" * 64}, PermissionError),
        ("twice", {"pipelines": [record, record], "registry": own}, ValueError),
        ("horizon", {"pipelines": [other], "registry": own}, ValueError),
        ("shape", {"pipelines": [record]}, ValueError),
    ):
        with pytest.raises(error):
            stages.load_frozen(spark, write(name, body), registry)


def test_scaffold_and_causal_engine(spark):
    registry = {"horizons": [1], "validation": {"outer": 2, "inner": 1}, "development": {"start": "2024-01-01", "end": "2024-01-24 00:00:00"}, "locked": {"start": "2024-01-24 01:00:00", "end": "2024-02-01"}}
    panel = inputs.panel(spark, "/root/testdata/sf0.01")
    base = stages.scaffold(panel, registry)
    assert base["candidates"].count() == 6048 and base["fold_plan"].count() == 4 and base["partition"].where("ts > timestamp '2024-01-24 00:00:00'").isEmpty()
    engine = stages.causal_engine(base, evidence_queries.spec_scores, "2024-01-12 00:00:00")
    assert engine["prefix_audit"].count() == 84 and engine["prefix_audit"].where("max_error > 1e-9 or null_mismatches > 0").isEmpty()
    shares = engine["state_summary"].collect()
    assert all(abs(r["range_share"] + r["trend_share"] + r["stress_share"] - 1) < 1e-9 and r["least_probability"] >= 0 for r in shares)
    assert all(r["least_eigenvalue"] > 0 and r["transition_error"] < 1e-12 and len(r["sha256"]) == 64 for r in engine["state_parameters"].collect())
    with pytest.raises(ValueError):
        stages.scaffold(panel.union(panel.limit(1)), registry)
    with pytest.raises(ValueError):
        stages.development_partition(panel, {**registry, "locked": {"start": "2024-01-02"}})
