"""Validation as aggregates, and prefix invariance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_columns(frame: DataFrame, names: list[str], label: str = "table") -> None:
    missing = sorted(set(names) - set(frame.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")


def require_rows(frame: DataFrame, least: int, label: str = "table") -> None:
    got = frame.limit(least).count()
    if got < least:
        raise ValueError(f"{label} has {got} rows, {least} are needed")


def require_before(frame: DataFrame, start: str) -> None:
    """No row may be at or after the locked period's start."""
    if not frame.where(F.col("ts") >= F.lit(start).cast("timestamp")).isEmpty():
        raise ValueError("rows of the locked period in development data")


def market_validation(bar_table: DataFrame, step_hours: int) -> DataFrame:
    """Per symbol: rows, range, repeated and incomplete rows, irregular steps, gaps, the largest gap."""
    w = W.partitionBy("symbol").orderBy("ts")
    steps = bar_table.withColumn("__h", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))) / 3600.0)
    bad = F.coalesce(F.least(*[F.col(c).isNotNull().cast("int") for c in ("open", "high", "low", "close", "volume")]), F.lit(0)) == 0
    wrong = (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0)
    return steps.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        (F.count("*") - F.countDistinct("ts")).alias("duplicates"),
        F.count_if(bad).alias("incomplete"),
        F.count_if(wrong).alias("invalid"),
        F.count_if(F.col("__h") != step_hours).alias("irregular_steps"),
        F.count_if(F.col("__h") > step_hours).alias("gaps"),
        F.coalesce(F.max("__h"), F.lit(0.0)).alias("largest_gap_hours"),
    )


def validation_status(summary: DataFrame, overlap: int, least: int = 500, strict: bool = False) -> DataFrame:
    gaps = F.col("gaps") > 0
    fail = F.lit(overlap < least) | (gaps if strict else F.lit(False)) | (F.col("duplicates") > 0)
    return summary.withColumn("status", F.when(fail, "FAIL").when(gaps, "PASS_WITH_WARNINGS").otherwise("PASS"))


def expectations(frame: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): all rules, SQL predicates that must hold, in one aggregate."""
    counts = frame.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(n) for n, e in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def prefix_invariance(build: Callable[[DataFrame], DataFrame], source: DataFrame, until: str, columns: list[str]) -> DataFrame:
    """(column, max_error, null_mismatches) of build(prefix) against build(all) on the prefix."""
    cut = F.col("ts") <= F.lit(until).cast(source.schema["ts"].dataType)
    part = build(source.where(cut)).select("symbol", "ts", *[F.col(c).alias(f"__{c}") for c in columns])
    both = build(source).where(cut).join(part, ["symbol", "ts"], "left")
    aggs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.max(F.abs(F.col(c) - F.col(f"__{c}"))), F.lit(0.0)).alias("max_error"), F.count_if(F.col(c).isNull() != F.col(f"__{c}").isNull()).alias("null_mismatches")) for c in columns]
    return both.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def feature_dictionary(whole: DataFrame, part: DataFrame, families: list[tuple[str, str]], state_inputs: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """(family, feature, rows, nulls, least, most, known_at_origin, state_input) of a table's features.

    part: the same features of the series up to some time. A feature is known at the forecast's origin if
    no value up to that time differs between the two; that is measured, not declared.
    """
    names = [c for _, c in families]
    early = part.select("symbol", "ts", *[F.col(c).cast("double").alias(f"__{c}") for c in names], F.lit(True).alias("__early"))
    both = whole.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in names]).join(early, ["symbol", "ts"], "left")

    def entry(family: str, c: str) -> Column:
        differs = F.col("__early") & ~(F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance, F.col(c).isNull() & F.col(f"__{c}").isNull()))
        return F.struct(F.lit(family).alias("family"), F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).alias("least"), F.max(c).alias("most"), (F.count_if(differs) == 0).alias("known_at_origin"), F.lit(c in state_inputs).alias("state_input"))

    return both.agg(F.array(*[entry(*x) for x in families]).alias("e")).select(F.inline("e"))
