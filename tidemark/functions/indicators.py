"""Indicator and market-state columns over a panel (symbol, ts, pri_*, ctx_*).

Frames give NULL until they are full; flags are never NULL; all thresholds are lagged. Column
groups with one ordering are made in one select, so they share one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.scans import affine_scan
from tidemark.sources.bars import by_time

BASELINE = ["pri_ret_1", "pri_ret_3", "ctx_ret_1", "ctx_ret_3", "trend_12", "vol_20", "range_12", "volume_z", "regime_range", "regime_trend", "regime_stress"]
RSI = [*BASELINE, "rsi_norm", "rsi_slope", "rsi_reversal_score", "rsi_extreme", "rsi_x_trend", "rsi_x_volatility", "rsi_x_range", "rsi_x_stress"]
BOLLINGER = [*BASELINE, "bb_percent_b", "bb_bandwidth", "bb_reversal_score", "bb_extreme", "bb_distance_upper", "bb_distance_lower", "bb_x_trend", "bb_x_volatility", "bb_x_range", "bb_x_stress"]
COMBINED = sorted({*RSI, *BOLLINGER, "bridge_direction_agreement", "bridge_score_product", "bridge_score_difference"})
FEATURE_SETS = {"baseline": BASELINE, "rsi": RSI, "bollinger": BOLLINGER, "combined": COMBINED}


def full(agg: Column, counted: Column, n: int, w=None, end: int = 0) -> Column:
    """An aggregate over the n rows up to `end`, NULL unless all n are there."""
    frame = (w if w is not None else by_time()).rowsBetween(end - n + 1, end)
    return F.when(F.count(counted).over(frame) == n, agg.over(frame))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def returns_and_scale(panel: DataFrame) -> DataFrame:
    """Log returns over 1 and 3 bars, trend, realised scale, range, volume score."""
    w = by_time()
    log = lambda c: F.log(F.when(F.col(c) > 0, F.col(c)))
    diff = lambda c, k: log(c) - F.lag(log(c), k).over(w)
    one = panel.select("*", diff("pri_close", 1).alias("pri_ret_1"), diff("pri_close", 3).alias("pri_ret_3"), diff("ctx_close", 1).alias("ctx_ret_1"), diff("ctx_close", 3).alias("ctx_ret_3"), (diff("pri_close", 12) / 12.0).alias("trend_12"), F.log1p("pri_volume").alias("__lv"))
    ret, lv = F.col("pri_ret_1"), F.col("__lv")
    sd = full(F.stddev_samp(lv), lv, 30)
    return one.select(
        "*",
        (full(F.stddev_samp(ret), ret, 20) * F.sqrt(F.lit(20.0))).alias("vol_20"),
        (full(F.max("pri_high"), F.col("pri_high"), 12) / full(F.min("pri_low"), F.col("pri_low"), 12) - 1.0).alias("range_12"),
        ((lv - full(F.avg(lv), lv, 30)) / F.nullif(sd, F.lit(0.0))).alias("volume_z"),
    ).drop("__lv")


def regime_flags(frame: DataFrame, lookback: int = 180, level: float = 0.75) -> DataFrame:
    """Stress, trend and range flags against quantiles of the `lookback` rows before."""
    limit = lambda c: full(F.percentile(c, level), c, lookback, end=-1)
    size = F.abs("trend_12")
    one = frame.select("*", flag(F.col("vol_20") > limit(F.col("vol_20"))).alias("regime_stress"), flag(size > limit(size)).alias("__moving"))
    two = one.withColumn("regime_trend", F.when(F.col("regime_stress") == 0, F.col("__moving")).otherwise(0.0)).drop("__moving")
    return two.withColumn("regime_range", F.when((F.col("regime_stress") == 0) & (F.col("regime_trend") == 0), 1.0).otherwise(0.0))


def relative_strengths(frame: DataFrame, periods: dict[str, int], price: str = "pri_close") -> DataFrame:
    """Adds Wilder's index for several periods (name: period); NULL until `period` moves are there and
    wherever the mean loss is 0.

    The smoothed gains and losses are linear recurrences, so all of them are one scan over chunks of the
    series. A move that is missing leaves the means as they are, and the older moves weigh less by the
    bars that went by.
    """
    kept, w = frame.drop(*periods), by_time()
    moves = kept.withColumn("__m", F.col(price).cast("double") - F.lag(F.col(price).cast("double")).over(w))
    moves = moves.withColumns({"__m": F.when(~F.isnan("__m"), F.col("__m")), "__rn": F.row_number().over(w)})
    there = F.col("__m").isNotNull()
    seen = moves.withColumns({"__n": F.count("__m").over(w.rowsBetween(W.unboundedPreceding, 0)), "__was": F.last(F.when(there, F.col("__rn")), True).over(w.rowsBetween(W.unboundedPreceding, -1))})
    gain, loss = (F.when(F.col("__m").isNotNull(), F.greatest(sign * F.col("__m"), F.lit(0.0))) for sign in (1, -1))
    later, gap, steps = there & (F.col("__n") > 1), F.col("__rn") - F.col("__was"), []
    for name, period in periods.items():
        new = 1.0 / period
        if period == 1:
            continue
        old = F.pow(F.lit(1.0 - new), gap)
        share = F.when(later, new / (old + new)).when(there, 1.0).otherwise(0.0)
        steps.append((F.when(later, F.log(old / (old + new))).otherwise(0.0), {f"__{side}_{name}": share * F.coalesce(move, F.lit(0.0)) for side, move in (("g", gain), ("l", loss))}))
    means = affine_scan(seen, ["symbol"], "ts", steps) if steps else seen
    for name in [n for n, p in periods.items() if p == 1]:
        means = means.withColumns({f"__{side}_{name}": F.last(move, True).over(w) for side, move in (("g", gain), ("l", loss))})
    index = lambda n, p: F.when((F.col("__n") >= p) & (F.col(f"__l_{n}") != 0), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - 100.0 / (1.0 + F.col(f"__g_{n}") / F.col(f"__l_{n}")))))
    return means.select(*kept.columns, *[index(n, p).alias(n) for n, p in periods.items()])


def relative_strength(frame: DataFrame, period: int = 14, price: str = "pri_close", name: str = "rsi") -> DataFrame:
    return relative_strengths(frame, {name: period}, price)


def rsi_features(frame: DataFrame, lower: float = 30.0, upper: float = 70.0) -> DataFrame:
    """Features of a frame with rsi, trend_12, vol_20 and the regime flags."""
    w, rsi = by_time(), F.col("rsi")
    before, norm = F.lag("rsi").over(w), (rsi - 50.0) / 50.0
    long, short = flag((rsi < lower) & (before >= lower)), flag((rsi > upper) & (before <= upper))
    return frame.select(
        "*",
        norm.alias("rsi_norm"),
        ((rsi - F.lag("rsi", 3).over(w)) / 100.0).alias("rsi_slope"),
        (-norm).alias("rsi_reversal_score"),
        long.alias("rsi_long_event"),
        short.alias("rsi_short_event"),
        (long - short).alias("rsi_event_position"),
        flag((rsi < lower) | (rsi > upper)).alias("rsi_extreme"),
        *[(norm * F.col(c)).alias(f"rsi_x_{n}") for n, c in (("trend", "trend_12"), ("volatility", "vol_20"), ("range", "regime_range"), ("stress", "regime_stress"))],
    )


def bollinger_features(frame: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """Bands (population deviation), %B, bandwidth, crossings of the band against the lagged band."""
    w, c = by_time(), F.col("pri_close")
    mid, sd = full(F.avg(c), c, period), full(F.stddev_pop(c), c, period)
    one = frame.select("*", mid.alias("bb_middle"), (mid + width * sd).alias("bb_upper"), (mid - width * sd).alias("bb_lower"))
    up, low, span = F.col("bb_upper"), F.col("bb_lower"), F.nullif(F.col("bb_upper") - F.col("bb_lower"), F.lit(0.0))
    was = lambda x: F.lag(x).over(w)
    long, short = flag((c < low) & (was(c) >= was(low))), flag((c > up) & (was(c) <= was(up)))
    pct = (c - low) / span
    score = 0.5 - pct
    return one.select(
        "*",
        pct.alias("bb_percent_b"),
        (span / F.nullif(F.col("bb_middle"), F.lit(0.0))).alias("bb_bandwidth"),
        score.alias("bb_reversal_score"),
        long.alias("bb_long_event"),
        short.alias("bb_short_event"),
        (long - short).alias("bb_event_position"),
        flag((pct < 0.0) | (pct > 1.0)).alias("bb_extreme"),
        (c / up - 1.0).alias("bb_distance_upper"),
        (c / low - 1.0).alias("bb_distance_lower"),
        *[(score * F.col(x)).alias(f"bb_x_{n}") for n, x in (("trend", "trend_12"), ("volatility", "vol_20"), ("range", "regime_range"), ("stress", "regime_stress"))],
    )


def bridge_features(frame: DataFrame) -> DataFrame:
    """Where both indicators are extreme and point the same way; their product and difference."""
    r, b = F.col("rsi_reversal_score"), F.col("bb_reversal_score")
    agree = flag((F.signum(r) == F.signum(b)) & (F.col("rsi_extreme") == 1) & (F.col("bb_extreme") == 1))
    return frame.select("*", agree.alias("bridge_direction_agreement"), F.when(agree == 1, F.signum(r)).otherwise(0.0).alias("bridge_event_position"), (r * b).alias("bridge_score_product"), (r - b).alias("bridge_score_difference"))


def target(frame: DataFrame, horizon: int = 1, price: str = "pri_close") -> DataFrame:
    """future_return over `horizon` bars and target_up (0 counts as down, NULL at the end)."""
    ahead = F.log(F.lead(price, horizon).over(by_time()) / F.col(price))
    return frame.select("*", ahead.alias("future_return")).withColumn("target_up", (F.col("future_return") > 0).cast("int"))


def feature_steps(lookback: int = 180, horizon: int = 1, rsi_period: int = 14, bb_period: int = 20, bb_width: float = 2.0) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The builders of the first generation's features in order, each with the family of the columns it adds."""
    return [
        ("benchmark", returns_and_scale),
        ("benchmark", lambda f: regime_flags(f, lookback)),
        ("rsi", lambda f: rsi_features(relative_strength(f, rsi_period))),
        ("bollinger", lambda f: bollinger_features(f, bb_period, bb_width)),
        ("bridge", bridge_features),
        ("target", lambda f: target(f, horizon)),
    ]


def feature_frame(panel: DataFrame, **settings) -> DataFrame:
    """All features of the first generation, incomplete rows and all."""
    frame = panel
    for _, build in feature_steps(**settings):
        frame = build(frame)
    return frame


def feature_families(panel: DataFrame, **settings) -> list[tuple[str, str]]:
    """(family, column) of every column that the builders add to a panel, in order: read off the builders' output."""
    frame, found = panel, []
    for family, build in feature_steps(**settings):
        made = build(frame)
        found += [(family, c) for c in made.columns if c not in frame.columns]
        frame = made
    return found


def complete_rows(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite and NaN values become NULL, then rows with a NULL in `columns` go."""
    numbers = [c for c, t in frame.dtypes if t == "double" and (columns is None or c in columns)]
    clean = frame.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in numbers})
    return clean.na.drop(subset=columns)


def event_persistence(frame: DataFrame, event: str, max_age: int = 6, name: str = "persistence") -> DataFrame:
    """The last event's sign, fading linearly to 0 over `max_age` bars; a new event starts again."""
    w = by_time()
    numbered = frame.withColumn("__rn", F.row_number().over(w))
    happened = F.col(event).isNotNull() & ~F.isnan(event) & (F.col(event) != 0)
    last = F.last(F.when(happened, F.struct("__rn", F.signum(event).alias("sign"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    age = F.col("__rn") - F.col("__last.__rn")
    value = F.when(age < max_age, F.col("__last.sign") * (1.0 - age / float(max_age))).otherwise(0.0)
    return numbered.withColumn("__last", last).withColumn(name, F.coalesce(value, F.lit(0.0))).drop("__rn", "__last")


def horizon_targets(frame: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 6), price: str = "pri_close") -> DataFrame:
    """Long form: (symbol, ts, horizon, target_ts, future_return, direction)."""
    w, long = by_time(), None
    wide = frame.select("symbol", "ts", *[F.struct(F.lit(h).alias("horizon"), F.lead("ts", h).over(w).alias("target_ts"), F.log(F.lead(price, h).over(w) / F.col(price)).alias("future_return")).alias(f"h{h}") for h in horizons])
    long = wide.select("symbol", "ts", F.inline(F.array(*[f"h{h}" for h in horizons])))
    return long.withColumn("direction", (F.col("future_return") > 0).cast("int"))


def bounded_targets(targets: DataFrame, spans: list[tuple[str, str]]) -> DataFrame:
    """Targets whose row and target time lie in one of the spans; others become NULL."""
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | (F.col("ts").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")) & (F.col("target_ts") <= F.lit(b).cast("timestamp")))
    keep = lambda c: F.when(inside, F.col(c)).alias(c)
    return targets.select("symbol", "ts", "horizon", *[keep(c) for c in ("target_ts", "future_return", "direction")])


def large_move(frame: DataFrame, train_rows: int, level: float = 0.9) -> DataFrame:
    """large_move: |future_return| above the training rows' quantile."""
    numbered = frame.withColumn("__rn", F.row_number().over(by_time()))
    limit = numbered.where(F.col("__rn") <= train_rows).groupBy("symbol").agg(F.percentile(F.abs("future_return"), level).alias("limit"))
    return numbered.join(F.broadcast(limit), "symbol").withColumn("large_move", (F.abs("future_return") > F.col("limit")).cast("int")).drop("__rn")


