"""Bar sources: files of open/high/low/close/volume, and bars built from raw rows.

A bar table has symbol, ts, open, high, low, close, volume; order is never assumed, every window
restates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")
KEYS = ("date", "datetime", "timestamp")
PLACE = "__place"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_time(symbol: str = "symbol", ts: str = "ts") -> W:
    return W.partitionBy(symbol).orderBy(ts)


def read_ohlcv_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bar file with a header; every column as text, and each row's place in the file, for `standardize`."""
    rows = spark.read.option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("*", place.alias(PLACE))


def standardize(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """(ts, open, high, low, close, volume) of raw bar rows.

    Names are trimmed and their case ignored; the first of date, datetime, timestamp is the key.
    Rows with an unreadable key go, then all but the last row of a key (by `order`, or by its place in
    the file where that was read), then rows with an unreadable or missing number. A repeated key whose
    last row is bad therefore loses its bar. A table has no order of its own: without either, repeated
    keys are refused.
    """
    names = {c.strip().lower(): c for c in rows.columns}
    key = next((names[k] for k in KEYS if k in names), None)
    missing = [c for c in OHLCV if c not in names]
    if key is None or missing:
        raise ValueError(f"bar table lacks {missing or 'a time column'}")
    number = [F.col(f"`{names[c]}`").cast("string").try_cast("double").alias(c) for c in OHLCV]
    ts = F.try_to_timestamp(F.col(f"`{key}`").cast("string")).alias("ts")
    rank = order if order is not None else F.col(PLACE) if PLACE in rows.columns else F.lit(0)
    last = rows.select(ts, rank.alias("__order"), F.struct(*number).alias("v")).where("ts is not null")
    known = order is not None or PLACE in rows.columns
    kept = F.max_by("v", "__order") if known else F.when(F.count("*") == 1, F.first("v")).otherwise(F.raise_error(F.lit("repeated keys need an order")).cast(last.schema["v"].dataType))
    last = last.groupBy("ts").agg(kept.alias("v")).select("ts", "v.*")
    return last.replace(float("nan"), None).na.drop()


def symbol_of_event() -> Column:
    return F.when(F.col("event_type").isin("click", "view", "error"), "PRI").otherwise("CTX")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, bar, at, seq, value) of the events table, hourly; values must be positive."""
    ev = table(spark, sf_dir, "events").where("value > 0")
    return ev.select(symbol_of_event().alias("symbol"), F.window("ts", "1 hour").getField("start").alias("bar"), F.struct("ts", "event_id").alias("seq"), "value")


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the orders table, daily."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    od = table(spark, sf_dir, "orders")
    return od.select(F.when(urgent, "PRI").otherwise("CTX").alias("symbol"), F.col("o_orderdate").alias("bar"), F.struct("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))


def bars(ticks: DataFrame) -> DataFrame:
    """One pre-aggregated pass: first, greatest, least, last value and number of ticks a bar."""
    return ticks.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min_by("value", "seq").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "seq").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def index_bars(ticks: DataFrame) -> DataFrame:
    """Index bars with two-sided moves: the standardised mean tick of a bar is its log return."""
    mean = ticks.groupBy("symbol", F.col("bar").alias("ts")).agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("volume"))
    whole, run = W.partitionBy("symbol"), by_time().rowsBetween(W.unboundedPreceding, 0)
    step = mean.withColumn("r", F.lit(0.02) * (F.col("x") - F.avg("x").over(whole)) / F.stddev_samp("x").over(whole))
    px = step.select("symbol", "ts", "volume", (F.lit(100.0) * F.exp(F.sum("r").over(run))).alias("close"))
    px = px.withColumn("open", F.coalesce(F.lag("close").over(by_time()), "close"))
    return px.select("symbol", "ts", "open", (F.greatest("open", "close") * 1.005).alias("high"), (F.least("open", "close") * 0.995).alias("low"), "close", "volume")


def aligned(bar_table: DataFrame, primary: str = "PRI", context: str = "CTX") -> DataFrame:
    """The panel of two symbols, joined on time, with prefixed columns."""
    one = lambda s, p, cols: bar_table.where(F.col("symbol") == s).select("ts", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return one(primary, "pri", OHLCV).join(one(context, "ctx", ("close", "volume")), "ts").select(F.lit(primary).alias("symbol"), "*")


BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV]])
