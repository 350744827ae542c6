"""Streaming bars: tumbling windows over raw ticks, late rows cut by a watermark.

The batch form is `sources.bars.bars`; both give the same rows once the watermark has passed.
`monitor` carries a symbol's smoothed gains and losses from bar to bar in keyed state, so the
relative strength of a stream is that of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.bars import symbol_of_event


def streaming_bars(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of an events stream; repeated events count once."""
    ticks = events.where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    seq = F.struct("ts", "event_id")
    grouped = ticks.groupBy(symbol_of_event().alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", seq).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", seq).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return grouped.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def monitor(bars: DataFrame, period: int = 14) -> DataFrame:
    """(symbol, ts, rsi) of a stream of bars, in the order in which bars are closed."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gain, loss, n = state.get if state.exists else (None, None, None, 0)
        bars_ = pd.concat(list(rows)).sort_values("ts")
        out = []
        for close in bars_["close"]:
            if last is not None:
                up, down = max(close - last, 0.0), max(last - close, 0.0)
                gain, loss = (up, down) if n == 0 else (gain + (up - gain) / period, loss + (down - loss) / period)
                n += 1
            last = close
            out.append(min(100.0, max(0.0, 100.0 - 100.0 / (1.0 + gain / loss))) if n >= period and loss else None)
        state.update((last, gain, loss, n))
        yield pd.DataFrame({"symbol": key[0], "ts": bars_["ts"].to_numpy(), "rsi": pd.Series(out, dtype=object)})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, rsi double", "last double, gain double, loss double, n long", "append", GroupStateTimeout.NoTimeout)
