"""Isotonic maps merged from ranges, and spline columns as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def pool(low: list[float], high: list[float], weight: list[float], total: list[float]) -> list[tuple[float, float, float, float]]:
    """Pool adjacent violators: blocks in order become blocks of rising means. Pooled blocks of neighbouring
    ranges may be pooled again: the result is that of all rows at once."""
    out: list[list[float]] = []
    for block in zip(low, high, weight, total):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, top, w, s = out.pop()
            out[-1][1] = top
            out[-1][2] += w
            out[-1][3] += s
    return [tuple(b) for b in out]


def isotonic_blocks(rows: DataFrame, keys: list[str], p: str, y: str, ranges: int = RANGES) -> DataFrame:
    """(keys, low, high, weight, value): the steps of each key's isotonic map of y on p (between 0 and 1).

    Equal p are added up first. Then every range of p pools its own violators, in parallel, and a key's
    pooled blocks, which are no more than the steps of its map and what the ranges cut, are pooled again.
    """
    points = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull() & ~F.isnan(p)).groupBy(*keys, F.col(p).cast("double").alias("low")).agg(F.count("*").cast("double").alias("weight"), F.sum(F.col(y).cast("double")).alias("total"))
    points = points.withColumns({"high": F.col("low"), "__range": F.least(F.floor(F.col("low") * ranges), F.lit(ranges - 1)).cast("int")})
    names = [*keys, "low", "high", "weight", "total"]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        out = pd.DataFrame(pool(*(pdf[c].tolist() for c in names[-4:])), columns=names[-4:])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[names]

    schema = points.select(*names).schema
    each = points.groupBy(*keys, "__range").applyInPandas(merge, schema)
    whole = each.groupBy(*keys).applyInPandas(merge, schema)
    return whole.select(*keys, "low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def isotonic_map(rows: DataFrame, keys: list[str], p: str, blocks: DataFrame, name: str = "calibrated", eps: float = 1e-9) -> DataFrame:
    """rows with the map's value at p: constant within a step and beyond the ends, linear between steps."""
    after = W.partitionBy(*keys).orderBy("low")
    steps = blocks.select(*keys, F.struct("low", "high", "value", F.lead("low").over(after).alias("next"), F.lead("value").over(after).alias("then")).alias("__step"), F.col("low").alias("__p"))
    named = rows.withColumns({"__p": F.col(p).cast("double"), "__step": F.lit(None).cast(steps.schema["__step"].dataType), "__row": F.lit(True)})
    both = named.unionByName(steps, allowMissingColumns=True)
    # A row at a step's own start comes after it; rows before the first step take the first one's value.
    along = W.partitionBy(*keys).orderBy("__p", F.col("__row").isNotNull())
    found = F.coalesce(F.last("__step", True).over(along.rowsBetween(W.unboundedPreceding, 0)), F.first("__step", True).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s, x = F.col("__found"), F.col("__p")
    between = s["value"] + (s["then"] - s["value"]) * (x - s["high"]) / (s["next"] - s["high"])
    value = F.when((x <= s["high"]) | s["next"].isNull(), s["value"]).otherwise(between)
    out = both.withColumn("__found", found).where("__row")
    return out.withColumn(name, F.when(x.isNotNull(), F.least(F.greatest(value, F.lit(eps)), F.lit(1 - eps)))).drop("__p", "__step", "__row", "__found")


def spline_place(x: Column, low: Column, high: Column, knots: int) -> Column:
    """Where x lies between `knots` even knots from low (0) to high (knots - 1); beyond them it is held at the ends."""
    top = F.when(high > low, high).otherwise(low + 1.0)
    inside = F.least(F.greatest(x, low), top - (top - low) * 1e-12)
    return (inside - low) / ((top - low) / (knots - 1))


def spline_columns(place: Column, knots: int) -> list[Column]:
    """Cubic B-spline columns at a place between the knots (best a column of its own); the first is left out.

    On even knots all columns are one bump of four cubic pieces, moved by one knot each.
    """

    def bump(u: Column) -> Column:
        v = 4.0 - u
        return F.when((u < 0) | (u >= 4), 0.0).when(u < 1, u * u * u / 6.0).when(u < 2, (((-3.0 * u + 12.0) * u - 12.0) * u + 4.0) / 6.0).when(u < 3, (((3.0 * u - 24.0) * u + 60.0) * u - 44.0) / 6.0).otherwise(v * v * v / 6.0)

    return [bump(place + (3.0 - j)) for j in range(1, knots + 2)]
