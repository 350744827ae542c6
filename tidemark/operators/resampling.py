"""Moving-block and event resampling with counter-based draws.

A draw is a hash of (seed, sample, number), so it depends on nothing that was drawn before: samples are
rows, spread over tasks, and any engine makes the same draws. Block sums are looked up by their start
(the frame of one window), so a sample costs as many lookups as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.saved import save

SEED = 42


def draw(n: Column, *counter: Column | int) -> Column:
    """A whole number from 0 to n - 1: the first 32 bits of md5(counter, joined by colons), scaled."""
    text = F.concat_ws(":", *[F.lit(str(c)) if isinstance(c, int) else c.cast("string") for c in counter])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.floor(bits * n / F.lit(4294967296.0)).cast("long")


def _finite(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, place, x): a group's finite values in time order, counted from 0."""
    x = F.col(value).cast("double")
    kept = rows.select(*keys, "ts", x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("ts")) - 1).drop("ts")


def block_means(series: DataFrame, keys: list[str], samples: int, block: int, seed: int = SEED) -> DataFrame:
    """(keys, sample, mean): means of moving-block resamples of series (keys, place, x).

    As many blocks as cover the length; starts are even draws, the last block is cut to length. A draw
    depends on the length alone, so it is made, and dealt to its starts, once for all groups of a length.
    """
    along = W.partitionBy(*keys).orderBy("place")
    size = series.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("b", F.least(F.col("n"), F.lit(block)).cast("long"))
    size = save(size.withColumn("per", F.ceil(F.col("n") / F.col("b"))).withColumn("cut", F.col("n") - (F.col("per") - 1) * F.col("b")), "sizes")
    total = F.sum("x").over(along.rowsBetween(W.unboundedPreceding, 0))
    sums = series.join(size, keys).withColumns({"__s": total, "__x": F.col("x")})
    ahead = lambda k: F.last("__s").over(along.rowsBetween(0, k - 1)) - F.col("__s") + F.col("__x")
    # The last block's length differs between groups, so its sum is taken from the running total at a join.
    starts = save(sums.select(*keys, "place", ahead(block).alias("whole"), (F.col("__s") - F.col("__x")).alias("before"), F.col("__s").alias("upto"), "cut", "n", "b"), "starts")
    lengths = size.select("n", "b", "per", "cut").distinct()
    drawn = lengths.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).repartition("n", "sample")
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("per") - 1)))
    drawn = drawn.select("sample", (F.col("j") == F.col("per") - 1).alias("last"), "cut", "n", draw(F.col("n") - F.col("b") + 1, seed, F.col("sample"), F.col("j")).alias("place"))
    whole = drawn.where("not last").join(starts.select(*keys, "n", "place", "whole"), ["n", "place"]).select(*keys, "sample", "n", F.col("whole").alias("v"))
    ends = drawn.where("last").select("sample", "n", "place", (F.col("place") + F.col("cut") - 1).alias("end"))
    late = ends.join(starts.select(*keys, "n", "place", "before"), ["n", "place"]).join(starts.select(*keys, "n", F.col("place").alias("end"), "upto"), [*keys, "n", "end"])
    both = whole.unionByName(late.select(*keys, "sample", "n", (F.col("upto") - F.col("before")).alias("v")))
    return both.groupBy(*keys, "sample").agg((F.sum("v") / F.first("n")).alias("mean"))


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, samples: int = 2000, block: int = 10, seed: int = SEED) -> DataFrame:
    """(keys, n, mean, lower, upper, p_not_positive) by moving blocks over each group's time order.

    Groups without a finite value have n 0 and nulls.
    """
    rows = save(rows.select(*keys, "ts", value), "values")
    series = save(_finite(rows, keys, value), "series")
    means = block_means(series, keys, samples, block, seed)
    spread = means.groupBy(*keys).agg(F.percentile("mean", 0.025).alias("lower"), F.percentile("mean", 0.975).alias("upper"), F.avg((F.col("mean") <= 0).cast("double")).alias("p_not_positive"))
    centre = series.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    every = rows.select(*keys).distinct()
    out = every.join(centre, keys, "left").join(spread, keys, "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "lower", "upper", "p_not_positive")


def bootstrap_means(rows: DataFrame, keys: list[str], values: list[str], blocks: tuple[int, ...], samples: int = 5000, seed: int = SEED) -> DataFrame:
    """(keys, value, block, n, mean, lower, upper, p_not_positive) of several values and block lengths."""
    long = save(rows.select(*keys, "ts", F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("__v")) for v in values]))), "values")
    parts = [bootstrap_mean(long, [*keys, "value"], "__v", samples, b, seed).withColumn("block", F.lit(b)) for b in blocks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0").select(*keys, "value", "block", "n", "mean", "lower", "upper", "p_not_positive")


def random_event_pvalue(rows: DataFrame, keys: list[str], position: str, ret: str, cost_rate: float, samples: int = 2000, seed: int = SEED) -> DataFrame:
    """(keys, events, observed, p_value): as many bars drawn at random, with replacement, for the same positions.

    Draws are independent of the events' order, so shuffling the positions besides would change nothing.
    """
    rows, r = save(rows.select(*keys, "ts", position, ret), "values"), F.col(ret).cast("double")
    pool = rows.select(*keys, "ts", r.alias("r"), F.col(position).alias("pos")).where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf")))
    along = W.partitionBy(*keys).orderBy("ts")
    pool = save(pool.withColumn("place", F.row_number().over(along) - 1).withColumn("event", F.sum((F.col("pos") != 0).cast("int")).over(along) - 1), "pool")
    events = pool.where("pos <> 0")
    seen = save(events.groupBy(*keys).agg(F.count("*").alias("events"), F.avg(F.col("pos") * F.col("r") - 2 * cost_rate).alias("observed")), "observed")
    size = pool.groupBy(*keys).agg(F.count("*").alias("n"))
    drawn = events.select(*keys, "event", "pos").join(size, keys).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = drawn.select(*keys, "sample", "pos", draw(F.col("n"), seed, F.col("sample"), F.col("event")).alias("place"))
    means = drawn.join(pool.select(*keys, "place", "r"), [*keys, "place"]).groupBy(*keys, "sample").agg(F.avg(F.col("pos") * F.col("r") - 2 * cost_rate).alias("mean"))
    hits = means.join(seen, keys).groupBy(*keys).agg(F.count_if(F.col("mean") >= F.col("observed") - 1e-12).alias("hits"))
    out = rows.select(*keys).distinct().join(seen, keys, "left").join(hits, keys, "left")
    return out.select(*keys, F.coalesce("events", F.lit(0)).cast("long").alias("events"), "observed", ((F.col("hits") + 1) / (samples + 1.0)).alias("p_value"))


def superior_ability(rows: DataFrame, keys: list[str], name: str, gain: str, samples: int = 1000, block: int = 10, seed: int = SEED) -> DataFrame:
    """(keys, candidates, best, statistic, p_consistent, p_upper): does the best of many candidates beat the benchmark?

    rows: (keys, name, ts, gain over the benchmark), every candidate on the same bars. All candidates are
    resampled with the same blocks, so their dependence is kept. A resample's maximum is taken of the
    studentised means recentred: by every candidate's own mean (upper), or only where it is not so far
    below 0 that it cannot matter (consistent: mean >= -sd * sqrt(2 log log n)). The spread of a mean is
    that of its resamples. Measured on 1500 sets of four worthless candidates over 80 bars: of the
    consistent p-values, 12 % are below 0.1 with blocks of one bar, 15 % with blocks of five (which
    few bars make too narrow).
    """
    who = [*keys, name]
    series = save(_finite(rows, who, gain), "series")
    means = save(block_means(series, who, samples, block, seed), "means")
    spread = means.groupBy(*who).agg(F.stddev_pop("mean").alias("sd"))
    centre = series.groupBy(*who).agg(F.count("*").alias("n"), F.avg("x").alias("d"))
    each = save(centre.join(spread, who).withColumn("low", -F.col("sd") * F.sqrt(2 * F.log(F.log(F.greatest(F.col("n"), F.lit(3)))))), "candidates")
    ratio = lambda x: F.when(F.col("sd") > 0, x / F.col("sd")).when(x > 0, float("inf")).otherwise(0.0)
    seen = each.groupBy(*keys).agg(F.count("*").alias("candidates"), F.max_by(name, "d").alias("best"), F.greatest(F.max(ratio(F.col("d"))), F.lit(0.0)).alias("statistic"))
    recentred = means.join(each, who).select(*keys, "sample", ratio(F.col("mean") - F.col("d")).alias("u"), ratio(F.col("mean") - F.when(F.col("d") >= F.col("low"), F.col("d")).otherwise(0.0)).alias("c"))
    tops = recentred.groupBy(*keys, "sample").agg(F.greatest(F.max("u"), F.lit(0.0)).alias("u"), F.greatest(F.max("c"), F.lit(0.0)).alias("c"))
    share = lambda c: F.avg((F.col(c) >= F.col("statistic") - 1e-12).cast("double"))
    p = tops.join(seen, keys).groupBy(*keys).agg(share("c").alias("p_consistent"), share("u").alias("p_upper"))
    return seen.join(p, keys)


def one_standard_error(rows: DataFrame, keys: list[str], name: str, complexity: str, loss: str) -> DataFrame:
    """(keys, name, complexity, mean_loss, limit): the simplest candidate within one standard error of the best.

    rows: (keys, name, complexity, fold, loss). Ties of complexity go to the smaller loss, then to the name.
    """
    each = rows.groupBy(*keys, name, complexity).agg(F.avg(loss).alias("mean_loss"), F.coalesce(F.stddev_samp(loss) / F.sqrt(F.count(loss)), F.lit(0.0)).alias("se"))
    best = W.partitionBy(*keys).orderBy("mean_loss", complexity, name).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = each.withColumn("limit", F.first(F.col("mean_loss") + F.col("se")).over(best)).where("mean_loss <= limit")
    order = W.partitionBy(*keys).orderBy(complexity, "mean_loss", name)
    return near.withColumn("__p", F.row_number().over(order)).where("__p = 1").select(*keys, name, complexity, "mean_loss", "limit")
