"""Chronological folds with purge gaps, and their assignment to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HORIZONS = (1, 2, 3, 6)


def expanding_folds(n: int, folds: int, gap: int) -> list[dict]:
    """Expanding training, a gap, then equal test stretches that end at row n (rows from 0)."""
    size = n // (folds + 1)
    if size <= gap:
        raise ValueError("the first training stretch is no longer than the gap")
    out = []
    for k in range(folds):
        start = n - (folds - k) * size
        out.append({"fold": k + 1, "train_start": 0, "train_end": start - gap - 1, "purge_start": start - gap, "purge_end": start - 1, "test_start": start, "test_end": n - 1 if k == folds - 1 else start + size - 1})
    return out


def fold_table(spark: SparkSession, n: int, folds: int, gap: int) -> DataFrame:
    rows = expanding_folds(n, folds, gap)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "fold int, train_start long, train_end long, purge_start long, purge_end long, test_start long, test_end long")


def nested_plan(spark: SparkSession, n: int, horizons: tuple[int, ...] = HORIZONS, outer: int = 5, inner: int = 3) -> DataFrame:
    """Per horizon (its purge): outer folds over all rows, inner folds over each outer training part."""
    rows = []
    for h in horizons:
        for o in expanding_folds(n, outer, h):
            spans = [("outer", 0, o)] + [("inner", i["fold"], i) for i in expanding_folds(o["train_end"] + 1, inner, h)]
            rows += [(level, h, o["fold"], number, s["train_end"] + 1, s["test_start"], s["test_end"], s["test_end"] - s["test_start"] + 1) for level, number, s in spans]
    return spark.createDataFrame(rows, "level string, horizon int, outer_fold int, inner_fold int, n_train long, test_start long, test_end long, n_test long")


def assign(frame: DataFrame, folds: DataFrame) -> DataFrame:
    """(rows, fold, part) with part train, purge or test; the fold table is a few rows."""
    numbered = frame.withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1)
    part = F.when(F.col("rn") <= F.col("train_end"), "train").when(F.col("rn") < F.col("test_start"), "purge").otherwise("test")
    return numbered.join(F.broadcast(folds), F.col("rn").between(F.col("train_start"), F.col("test_end"))).withColumn("part", part).drop("train_start", "train_end", "purge_start", "purge_end", "test_start", "test_end")


def training_window(frame: DataFrame, rows: int | None) -> DataFrame:
    """The last `rows` rows of each symbol; all if None."""
    if rows is None:
        return frame
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    return frame.withColumn("__r", rank).where(F.col("__r") <= rows).drop("__r")


def calibration_split(frame: DataFrame, gap: int, share: float = 0.2, least: int = 60) -> DataFrame:
    """part: calibrate for the last max(least, share * n) rows, purge for `gap` rows before, else fit."""
    n = F.count("*").over(W.partitionBy("symbol"))
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    size = F.greatest(F.lit(least).cast("long"), F.floor(n * share))
    return frame.withColumn("part", F.when(back <= size, "calibrate").when(back <= size + gap, "purge").otherwise("fit"))


def thirds(frame: DataFrame, keys: list[str] | None = None, name: str = "subperiod") -> DataFrame:
    """P1, P2, P3 in order of time, sizes differing by one at most."""
    return frame.withColumn(name, F.concat(F.lit("P"), F.ntile(3).over(W.partitionBy(*(keys or ["symbol"])).orderBy("ts")).cast("string")))


def between(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of an inclusive time range."""
    return frame.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
