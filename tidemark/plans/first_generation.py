"""The one-shot framework: event study, chronological validation, monitor, verdicts."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import checks, drift, gates, newton, policy, resampling, splits, states, summaries
from tidemark.sources import bars as B
from tidemark.sources import sinks
from tidemark.sources.saved import save

SIGNALS = {"rsi": ("rsi_event_position", I.RSI), "bollinger": ("bb_event_position", I.BOLLINGER), "combined": ("bridge_event_position", I.COMBINED)}


@dataclass(frozen=True)
class Config:
    horizon: int = 1
    cost_bps: float = 10.0
    folds: int = 5
    samples: int = 2000
    block: int = 10
    monitor_window: int = 180
    least_rows: int = 500


def event_table(frame: DataFrame, config: Config) -> DataFrame:
    """Counts, mean net signed return with its interval, the random-event p-value, the verdict."""
    cost = config.cost_bps / 10000.0
    long = frame.where("future_return is not null").select("ts", "future_return", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(c).alias("position")) for s, (c, _) in SIGNALS.items()])))
    one = summaries.event_study(frame, {s: c for s, (c, _) in SIGNALS.items()}, cost).drop("symbol")
    net = long.where("position <> 0").withColumn("net", F.col("position") * F.col("future_return") - 2 * cost)
    ci = resampling.bootstrap_mean(net, ["signal"], "net", config.samples, config.block).select("signal", F.col("lower").alias("ci_lower"), F.col("upper").alias("ci_upper"))
    p = resampling.random_event_pvalue(long, ["signal"], "position", "future_return", cost, config.samples).select("signal", "p_value")
    out = one.join(ci, "signal", "left").join(p, "signal", "left")
    return out.withColumn("verdict", gates.event_verdict(F.col("event_count"), F.col("ci_lower"), F.col("ci_upper"), F.col("p_value")))


STATE_STARTS = 20


def predictions(frame: DataFrame, config: Config) -> DataFrame:
    """Matched probabilities of every signal's test rows, with losses, positions, returns and the latent
    regime: each fold's state model is fitted on its training rows and filtered onto its test rows."""
    rows = save(I.complete_rows(frame, [*I.COMBINED, "future_return"]), "rows")
    if rows.select("symbol").distinct().count() > 1:
        raise ValueError("one primary symbol a run")
    folds = splits.fold_table(frame.sparkSession, rows.count(), config.folds, config.horizon)
    parts = splits.assign(rows, folds)
    extra = {signal: [c for c in columns if c not in I.BASELINE] for signal, (_, columns) in SIGNALS.items()}
    out = newton.matched_folds(newton.enough(parts, ["fold"], "target_up"), ["fold"], I.BASELINE, extra, "target_up", balance=True)
    latent = states.fold_states(parts, ["fold"], STATE_STARTS)
    p_state = [f"state_p_{s}" for s in states.STATES]
    facts = parts.where("part = 'test'").select("symbol", "fold", "ts", "future_return", "target_up").join(latent, ["symbol", "fold", "ts"]).select("fold", "ts", "future_return", "target_up", F.col("state_label").alias("regime"), *p_state, F.greatest(*p_state).alias("regime_probability"))
    return policy.banded_returns(summaries.scored(out.join(facts, ["fold", "ts"])), ["signal", "fold"], config.cost_bps)


def regimes(pred: DataFrame) -> DataFrame:
    """Evidence by latent regime, with the mean filtered probability of the assigned state."""
    p = pred.groupBy("signal", "regime").agg(F.avg("regime_probability").alias("mean_filtered_probability"))
    return summaries.regime_summary(pred, ["signal"], "regime").join(p, ["signal", "regime"])


def verdicts(pred: DataFrame, config: Config) -> DataFrame:
    """One row a signal: gains, positive folds, current window, alarm, status, best regime."""
    monitored = drift.cusum(pred, ["signal"], config.monitor_window)
    by_fold = pred.groupBy("signal", "fold").agg(F.avg("incremental_log_loss").alias("g"))
    folds = by_fold.groupBy("signal").agg(F.count_if(F.col("g") > 0).alias("positive_folds"), F.count("*").alias("folds"))
    overall = pred.groupBy("signal").agg(F.avg("incremental_log_loss").alias("gain"), F.avg("incremental_net_edge").alias("edge"))
    now = splits.training_window(monitored.withColumn("symbol", F.col("signal")), config.monitor_window)
    current = now.groupBy("signal").agg(F.avg("incremental_log_loss").alias("current_gain"), F.max_by("structural_change_alarm", "ts").alias("alarm"), F.max_by("change_index", "ts").alias("change_index"))
    ci = resampling.bootstrap_mean(now, ["signal"], "incremental_net_edge", config.samples, config.block).select("signal", "lower", "upper")
    best = summaries.regime_summary(pred, ["signal"], "regime").groupBy("signal").agg(F.max_by("regime", "mean_incremental_net_edge").alias("best_regime"))
    row = overall.join(folds, "signal").join(current, "signal").join(ci, "signal").join(best, "signal")
    c = F.col
    row = row.withColumn("established", gates.established(c("gain"), c("edge"), c("positive_folds"), c("folds")))
    return row.withColumn("status", gates.status(c("established"), c("alarm"), c("current_gain"), c("lower"), c("upper")))


def run(panel: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """All tables of one run."""
    frame = I.feature_frame(panel, horizon=config.horizon)
    frame = save(frame, "features")
    checks.require_rows(I.complete_rows(frame, [*I.COMBINED, "future_return"]), config.least_rows, "feature table")
    pred = save(predictions(frame, config), "predictions")
    return {"events": event_table(frame, config), "predictions": pred, "folds": pred.groupBy("signal", "fold").agg(F.count("*").alias("n"), F.avg("incremental_log_loss").alias("gain"), F.avg("incremental_net_edge").alias("edge")), "regimes": regimes(pred), "verdicts": verdicts(pred, config)}


def write(tables: dict[str, DataFrame], path: str, config: Config = Config()) -> dict:
    """Each table as Parquet under path, and a manifest: row counts, settings, bounds and rows of every signal."""
    spark, manifest = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest[name] = spark.read.parquet(f"{path}/{name}").count()
    pred = spark.read.parquet(f"{path}/predictions")
    bounds = pred.groupBy("signal").agg(F.count("*").alias("rows"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last")).orderBy("signal").collect()
    record = {"rows": manifest, "config": asdict(config), "spark": spark.version, "signals": {r["signal"]: {"rows": r["rows"], "first": r["first"], "last": r["last"]} for r in bounds}}
    sinks.write_json(spark, record, f"{path}/manifest")
    return manifest


def wording(signal: str, status: str) -> str:
    """What a status says of a signal."""
    return {
        "NOT_ESTABLISHED": f"{signal} has not shown a stable predictive and economic contribution beyond the benchmark: NOT_ESTABLISHED.",
        "ACTIVE": f"{signal} was established and stays ACTIVE by its current window and monitor.",
        "REDUCED": f"{signal} was established, but its current evidence is uncertain or weaker: REDUCED.",
        "SUSPENDED": f"{signal} was established; its monitor is in alarm and its current window has lost: SUSPENDED.",
    }[status]


def report(verdict_rows: list, regime_rows: list | None = None) -> str:
    """Markdown: the verdicts, what they say, and the evidence by regime if it is given."""
    head = "| signal | status | mean gain | mean edge | positive folds | best regime |\n|-|-|-|-|-|-|\n"
    text = head + "\n".join(f"| {r['signal']} | {r['status']} | {r['gain']:.6f} | {r['edge']:.6f} | {r['positive_folds']}/{r['folds']} | {r['best_regime']} |" for r in verdict_rows)
    if regime_rows is None:
        return text
    said = "\n".join(f"- {wording(r['signal'], r['status'])}" for r in verdict_rows)
    table = "\n".join(f"| {r['signal']} | {r['regime']} | {r['observations']} | {r['mean_incremental_log_loss']:.6f} | {r['mean_incremental_net_edge']:.6f} | {r['mean_filtered_probability']:.3f} |" for r in sorted(regime_rows, key=lambda r: (r["signal"], r["regime"])))
    return f"{text}\n\n{said}\n\n| signal | regime | rows | mean gain | mean edge | mean state probability |\n|-|-|-|-|-|-|\n{table}"


def main(argv: list[str] | None = None) -> int:
    """Command line: two bar files (both or neither) or a folder of raw tables."""
    args = argparse.ArgumentParser(description="Signal validity over two bar series.")
    args.add_argument("--primary"), args.add_argument("--context"), args.add_argument("--tables"), args.add_argument("--out", required=True)
    args.add_argument("--horizon", type=int, default=1), args.add_argument("--cost-bps", type=float, default=10.0), args.add_argument("--samples", type=int, default=2000)
    a = args.parse_args(argv)
    try:
        if bool(a.primary) != bool(a.context):
            raise ValueError("give both bar files or neither")
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.primary:
            one = lambda p, s: B.standardize(B.read_ohlcv_csv(spark, p)).select(F.lit(s).alias("symbol"), "ts", *B.OHLCV)
            panel = B.aligned(one(a.primary, "PRI").unionByName(one(a.context, "CTX")))
        else:
            panel = B.aligned(B.index_bars(B.event_ticks(spark, a.tables)))
        config = Config(horizon=a.horizon, cost_bps=a.cost_bps, samples=a.samples)
        tables = run(panel, config)
        print(json.dumps(write(tables, a.out, config), sort_keys=True))
        print(report(tables["verdicts"].collect(), tables["regimes"].collect()))
        return 0
    except Exception as e:  # the command line reports and exits with 1
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
