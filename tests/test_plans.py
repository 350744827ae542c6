"""Plans: streams against batches, guards, hashes, the command line, small end-to-end runs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.plans import first_generation, inputs, registry, second_generation
from tidemark.sources import bars as B
from tidemark.sources import sinks
from tidemark.streaming import bars as S


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streaming_bars_equal_batch_bars(spark, sf_dir):
    schema = B.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    run_stream(S.streaming_bars(stream), "bars_out")
    got = {(r["symbol"], str(r["ts"])): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.sql("select * from bars_out").collect()}
    want = {(r["symbol"], str(r["ts"])): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in inputs.hourly(spark, sf_dir).collect()}
    assert len(got) > 0.8 * len(want) and all(want[k] == v for k, v in got.items())


def test_streaming_relative_strength_equals_batch(spark, sf_dir, tmp_path):
    bars = inputs.index(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    bars.coalesce(1).write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    run_stream(S.monitor(stream, 7), "rsi_out")
    got = {(r["symbol"], r["ts"]): r["rsi"] for r in spark.sql("select * from rsi_out").collect()}
    want = {(r["symbol"], r["ts"]): r["rsi"] for r in I.relative_strength(bars, 7, "close").collect()}
    assert got.keys() == want.keys()
    assert all((v is None) == (want[k] is None) and (v is None or abs(v - want[k]) < 1e-9) for k, v in got.items())


def test_holdout_guard(spark):
    rows = spark.createDataFrame([("2025-07-02",), ("2025-06-01",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    frozen = {"signal_family": "bollinger", "horizon": 1, "threshold": 0.05}
    frozen["pipeline_hash"] = second_generation.pipeline_hash(frozen)
    yes = {"approved": True, "pipeline_hash": frozen["pipeline_hash"]}
    span = ("2025-07-01", "2025-12-31")
    guard = second_generation.HoldoutGuard(frozen, yes)
    assert guard.open(rows, *span).count() == 1
    with pytest.raises(PermissionError):
        guard.open(rows, *span)
    with pytest.raises(PermissionError):
        second_generation.HoldoutGuard(frozen, yes, (), "file:///tmp").open(rows, *span)
    for bad in (second_generation.HoldoutGuard({**frozen, "threshold": 0.1}, yes), second_generation.HoldoutGuard(frozen, {**yes, "approved": False}), second_generation.HoldoutGuard(frozen, yes, ("bollinger",))):
        with pytest.raises(PermissionError):
            bad.open(rows, *span)


def test_hash_ignores_key_order_and_itself():
    a = second_generation.pipeline_hash({"b": 1, "a": [1, 2], "pipeline_hash": "x"})
    assert a == second_generation.pipeline_hash({"a": [1, 2], "b": 1}) != second_generation.pipeline_hash({"a": [2, 1], "b": 1})


def test_command_line_needs_both_files(spark, tmp_path, capsys):
    assert first_generation.main(["--primary", "x.csv", "--out", str(tmp_path)]) == 1
    assert "both" in capsys.readouterr().err


def test_first_generation_end_to_end(spark, tmp_path):
    panel = inputs.panel(spark, "/root/testdata/sf0.01")
    tables = first_generation.run(panel, first_generation.Config(folds=3, samples=100, least_rows=500))
    counts = first_generation.write(tables, str(tmp_path / "out"))
    assert counts["events"] == 3 and counts["verdicts"] == 3 and counts["folds"] > 0
    rows = tables["verdicts"].collect()
    assert {r["status"] for r in rows} <= {"NOT_ESTABLISHED", "SUSPENDED", "ACTIVE", "REDUCED"}
    assert first_generation.report(rows).count("\n") == 4
    text = first_generation.report(rows, tables["regimes"].collect())
    assert all(first_generation.wording(r["signal"], r["status"]) in text for r in rows) and "mean state probability" in text
    manifest = sinks.read_json(spark, str(tmp_path / "out/manifest"))
    assert manifest["rows"] == counts and set(manifest["signals"]) == {"rsi", "bollinger", "combined"} and manifest["config"]["folds"] == 5
    with pytest.raises(ValueError):
        first_generation.run(panel, first_generation.Config(least_rows=10_000))


@pytest.mark.parametrize("name", ["sta_filter", "mod_calibrations", "inf_bootstrap"])
def test_model_queries_give_sound_rows(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert rows
    for r in rows:
        if name == "sta_filter" and r["state_p_range"] is not None:
            assert abs(r["state_p_range"] + r["state_p_trend"] + r["state_p_stress"] - 1) < 1e-5
        if name == "inf_bootstrap":
            assert r["lower"] <= r["mean"] <= r["upper"]
        if name == "mod_calibrations":
            assert 0 < r["mean_candidate"] < 1


def test_stage_files(spark, sf_dir, tmp_path):
    from tidemark.sources import sinks

    bars = inputs.index(spark, sf_dir)
    manifest = sinks.write_stage({"bars": bars}, str(tmp_path / "stage"), {"bars": ["symbol", "ts"]})
    assert manifest["bars"]["rows"] == bars.count()
    assert sinks.verify_stage(spark, str(tmp_path / "stage"), {"bars": ["symbol", "ts"]}) == []
    bars.limit(3).write.mode("overwrite").parquet(str(tmp_path / "stage/bars"))
    assert sinks.verify_stage(spark, str(tmp_path / "stage"), {"bars": ["symbol", "ts"]}) == ["bars"]
    with pytest.raises(ValueError):
        sinks.write_json(spark, {"a": ["/root/x"]}, str(tmp_path / "j"))
    bars.where("symbol = 'PRI'").select(F.col("ts").alias("Timestamp"), "close").sort("Timestamp").write.option("header", True).csv(str(tmp_path / "csv"))
    assert sinks.read_indexed_csv(spark, str(tmp_path / "csv")).count() == bars.where("symbol = 'PRI'").count()
    bars.where("symbol = 'PRI'").select(F.col("ts").alias("Timestamp"), "close").orderBy(F.desc("ts")).coalesce(1).write.option("header", True).csv(str(tmp_path / "falling"))
    with pytest.raises(ValueError, match="fall"):
        sinks.read_indexed_csv(spark, str(tmp_path / "falling"))
    bars.select(F.col("ts").alias("Timestamp"), "close").write.option("header", True).csv(str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        sinks.read_indexed_csv(spark, str(tmp_path / "twice"))


def test_registry_checks():
    import json

    from tidemark.sources.sinks import ExperimentRegistry

    good = {"version": "1", "freeze_status": "FROZEN", "horizons": [1], "development": {"start": "2021-01-01", "end": "2025-06-30"}, "locked": {"start": "2025-07-01", "end": "2026-01-01"}, "validation": {}}
    assert len(ExperimentRegistry.load(json.dumps(good)).sha256) == 64
    own = {"tag": "v1", "commit": "abc"}
    assert ExperimentRegistry.load(json.dumps({**good, "parent": own}), own).payload["parent"] == own
    with pytest.raises(ValueError):
        ExperimentRegistry.load(json.dumps(good), own)
    for bad in ({**good, "freeze_status": "DRAFT"}, {**good, "locked": {"start": "2025-06-01"}}, {k: v for k, v in good.items() if k != "horizons"}):
        with pytest.raises(ValueError):
            ExperimentRegistry.load(json.dumps(bad))
