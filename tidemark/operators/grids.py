"""Specification grids as DataFrames: signals, structures, candidates, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HORIZONS = [1, 2, 3, 6]
RSI_PERIODS, RSI_BOUNDS, MODES = [7, 14, 21, 28], [(20.0, 80.0), (25.0, 75.0), (30.0, 70.0), (35.0, 65.0)], ["continuous", "contrarian", "continuation"]
BB_PERIODS, BB_WIDTHS = [10, 20, 30, 40], [1.5, 2.0, 2.5]
MODELS = ["regularized_linear", "spline_regularized", "shallow_boosting"]
WINDOWS = ["expanding", "rolling_1y", "rolling_2y"]
CALIBRATIONS = ["none", "sigmoid"]
THRESHOLDS = [0.0, 0.02, 0.05, 0.10]


def short(c: Column) -> Column:
    """A number without a needless decimal part: 2.0 as 2, 1.5 as 1.5."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def signal_specs(spark: SparkSession) -> DataFrame:
    """The distinct signal specifications with their ids, in grid order."""
    rows = [("rsi", p, lo, hi, None, m) for p in RSI_PERIODS for lo, hi in RSI_BOUNDS for m in MODES] + [("bollinger", p, None, None, k, m) for p in BB_PERIODS for k in BB_WIDTHS for m in MODES]
    rows = [(i + 1, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "ordinal int, family string, period int, lower double, upper double, width double, mode string")
    rsi = F.concat_ws("-", F.lit("rsi"), F.concat(F.lit("p"), F.col("period")), F.concat(F.lit("l"), short(F.col("lower"))), F.concat(F.lit("u"), short(F.col("upper"))), "mode")
    bb = F.concat_ws("-", F.lit("bollinger"), F.concat(F.lit("p"), F.col("period")), F.concat(F.lit("k"), short(F.col("width"))), "mode")
    return df.withColumn("spec_id", F.when(F.col("family") == "rsi", rsi).otherwise(bb))


def parsed_spec(spec_id: Column) -> Column:
    """period, width and mode read back from an id."""
    return F.struct(
        F.regexp_extract(spec_id, "-p([0-9]+)", 1).cast("int").alias("period"),
        F.regexp_extract(spec_id, "-k([0-9.]+)", 1).try_cast("double").alias("width"),
        F.element_at(F.split(spec_id, "-"), -1).alias("mode"),
    )


def _listed(spark: SparkSession, name: str, values: list, kind: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_i int, {name} {kind}")


def candidates(spark: SparkSession) -> DataFrame:
    """Every combination of signal, horizon, model, window and calibration, numbered in grid order."""
    grid = signal_specs(spark)
    for name, values, kind in (("horizon", HORIZONS, "int"), ("model", MODELS, "string"), ("window", WINDOWS, "string"), ("calibration", CALIBRATIONS, "string")):
        grid = grid.crossJoin(F.broadcast(_listed(spark, name, values, kind)))
    order = ["ordinal", "horizon_i", "model_i", "window_i", "calibration_i"]
    number = F.row_number().over(W.orderBy(*order))  # a fixed grid of some thousand rows
    return grid.withColumn("candidate_id", F.format_string("v2-candidate-%05d", number)).select("candidate_id", "spec_id", "family", "horizon", "model", "window", "calibration")


def structures(spark: SparkSession) -> DataFrame:
    """Model settings x windows x conditioning, ranked by complexity in grid order."""
    models = [("linear", f"c{c}") for c in ("0.1", "1", "10")] + [("spline", f"k{k}-c{c}") for k in (4, 6) for c in ("0.1", "1")] + [("boosting", f"l{leaf}-i{i}-r{r}") for leaf in (7, 15) for i in (100, 200) for r in (0, 1)]
    rows = [(m, s, w, bool(r)) for m, s in models for w in WINDOWS for r in (0, 1)]
    rows = [(i + 1, *x, f"{x[0]}-{x[1]}-{x[2]}-{'regime' if x[3] else 'plain'}".replace(".", "p")) for i, x in enumerate(rows)]
    return spark.createDataFrame(rows, "complexity_rank int, model string, setting string, window string, regime_conditioned boolean, pipeline_id string")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("always_on" if t == 0 else f"threshold_{t:g}", t) for t in THRESHOLDS], "policy string, threshold double")


def dated_windows(spark: SparkSession) -> DataFrame:
    """Training window lengths in bars of four hours; NULL keeps all."""
    return spark.createDataFrame([("rolling_1y", 2190), ("rolling_2y", 4380), ("expanding", None)], "window string, rows int")
