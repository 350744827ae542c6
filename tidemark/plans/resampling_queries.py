"""Resampled intervals and tests, and their DuckDB twins: the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import resampling
from tidemark.plans import first_generation, locked_evidence
from tidemark.plans import inputs as N
from tidemark.plans.oracle import MATCHED, PREDICTIONS, r6, sql

SEED = resampling.SEED


def _draw(n: str, counter: str) -> str:
    return f"CAST(floor(CAST('0x' || substr(md5('{SEED}:' || {counter}), 1, 8) AS BIGINT) * ({n}) / 4294967296.0) AS BIGINT)"


def _boot(tag: str, source: str, keys: str, value: str, samples: int, block: int) -> str:
    """Tables {tag}m (keys, sample, mean) and {tag} (keys, n, mean, bounds) of a source."""
    on = " AND ".join(f"d.{k} = {{0}}.{k}" for k in keys.split(", "))
    return f"""
{tag}s AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS place, {value} AS x FROM {source} WHERE isfinite({value})),
{tag}n AS MATERIALIZED (SELECT {keys}, n, b, (n + b - 1) // b AS per, n - ((n + b - 1) // b - 1) * b AS cut FROM (SELECT {keys}, count(*) AS n, least(count(*), {block}) AS b FROM {tag}s GROUP BY {keys})),
{tag}c AS MATERIALIZED (SELECT {keys}, place, sum(x) OVER (PARTITION BY {keys} ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM {tag}s),
{tag}d AS MATERIALIZED (SELECT {keys}, sample, n, CASE WHEN j = per - 1 THEN cut ELSE b END AS size, {_draw('n - b + 1', "sample || ':' || j")} AS place FROM (SELECT *, unnest(range(per)) AS j FROM {tag}n, (SELECT unnest(range({samples})) AS sample))),
{tag}m AS MATERIALIZED (SELECT {', '.join('d.' + k for k in keys.split(', '))}, sample, sum(e.upto - coalesce(f.upto, 0)) / any_value(n) AS mean FROM {tag}d AS d JOIN {tag}c AS e ON {on.format('e')} AND e.place = d.place + size - 1 LEFT JOIN {tag}c AS f ON {on.format('f')} AND f.place = d.place - 1 GROUP BY ALL),
{tag}q AS (SELECT {keys}, quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper, avg(CAST(mean <= 0 AS DOUBLE)) AS p_not_positive FROM {tag}m GROUP BY {keys}),
{tag} AS MATERIALIZED (SELECT {keys}, n, mean, lower, upper, p_not_positive FROM (SELECT {keys}, count(*) AS n, avg(x) AS mean FROM {tag}s GROUP BY {keys}) JOIN {tag}q USING ({keys}))"""


BOUNDS = r6("mean", "lower", "upper", "p_not_positive")
EVENTS = (
    PREDICTIONS
    + """,
ev0 AS (SELECT ts, future_return, unnest(['rsi', 'bollinger', 'combined']) AS signal, unnest([rsi_event_position, bb_event_position, bridge_event_position]) AS p FROM feat WHERE future_return IS NOT NULL),
ev1 AS (SELECT *, p * future_return - 0.002 AS net FROM ev0 WHERE p <> 0),"""
    + _boot("eb", "ev1", "signal", "net", 2000, 10)
    + f""",
rp AS MATERIALIZED (SELECT signal, p, future_return AS r, row_number() OVER w - 1 AS place, sum(CAST(p <> 0 AS INTEGER)) OVER w - 1 AS event FROM ev0 WINDOW w AS (PARTITION BY signal ORDER BY ts)),
ro AS (SELECT signal, count(*) AS events, avg(p * r - 0.002) AS observed FROM rp WHERE p <> 0 GROUP BY signal),
rd AS (SELECT signal, sample, p, {_draw('n', "sample || ':' || event")} AS place FROM (SELECT signal, p, CAST(event AS BIGINT) AS event, n, sample FROM rp JOIN (SELECT signal, count(*) AS n FROM rp GROUP BY signal) USING (signal), (SELECT unnest(range(2000)) AS sample) WHERE p <> 0)),
rm AS (SELECT rd.signal AS signal, sample, avg(rd.p * rp.r - 0.002) AS mean FROM rd JOIN rp ON rp.signal = rd.signal AND rp.place = rd.place GROUP BY rd.signal, sample),
rv AS (SELECT signal, (count(*) FILTER (mean >= observed - 1e-12) + 1) / 2001.0 AS p_value FROM rm JOIN ro USING (signal) GROUP BY signal),
es AS (SELECT signal, count(*) FILTER (p <> 0) AS event_count, count(*) FILTER (p > 0) AS long_events, count(*) FILTER (p < 0) AS short_events, avg(CASE WHEN p <> 0 THEN p * future_return - 0.002 END) AS mean_net_signed_return, avg(CASE WHEN p <> 0 THEN CAST(p * future_return - 0.002 > 0 AS DOUBLE) END) AS win_rate_after_cost FROM ev0 GROUP BY signal)"""
)


def intervals_sql() -> str:
    values = ("incremental_log_loss", "incremental_net_return")
    parts = [(f"b{i}{b}", v, b) for i, v in enumerate(values) for b in locked_evidence.BLOCKS]
    chain = MATCHED + "," + ",".join(_boot(tag, "matched", "signal", v, 5000, b) for tag, v, b in parts)
    return sql(chain, " UNION ALL ".join(f"SELECT signal, '{v}' AS value, {b} AS block, n, {BOUNDS} FROM {tag}" for tag, v, b in parts))


def superior(s, d):
    """The best of the three signals against the benchmark, fold by fold, all resampled with the same blocks."""
    return N.out(resampling.superior_ability(N.predictions(s, d), ["fold"], "signal", "incremental_log_loss"))


SUPERIOR = (
    PREDICTIONS
    + ","
    + _boot("sb", "pred", "fold, signal", "incremental_log_loss", 1000, 10)
    + """,
sp1 AS MATERIALIZED (SELECT sb.fold, sb.signal, n, sb.mean AS d, sd, -sd * sqrt(2 * ln(ln(greatest(n, 3)))) AS low FROM sb JOIN (SELECT fold, signal, stddev_pop(mean) AS sd FROM sbm GROUP BY fold, signal) USING (fold, signal)),
sp2 AS (SELECT fold, count(*) AS candidates, arg_max(signal, d) AS best, greatest(max(d / sd), 0.0) AS statistic FROM sp1 GROUP BY fold),
sp3 AS (SELECT fold, sample, greatest(max((mean - d) / sd), 0.0) AS u, greatest(max((mean - CASE WHEN d >= low THEN d ELSE 0.0 END) / sd), 0.0) AS c FROM sbm JOIN sp1 USING (fold, signal) GROUP BY fold, sample),
sp4 AS (SELECT fold, avg(CAST(c >= statistic - 1e-12 AS DOUBLE)) AS p_consistent, avg(CAST(u >= statistic - 1e-12 AS DOUBLE)) AS p_upper FROM sp3 JOIN sp2 USING (fold) GROUP BY fold)"""
)


def simplest(s, d):
    """Per subperiod, the simplest signal whose mean candidate loss over the folds is within one standard error of the least."""
    p = N.predictions(s, d).groupBy("subperiod", "signal", "fold").agg(F.avg("candidate_loss").alias("loss"))
    rank = F.when(F.col("signal") == "rsi", 1).when(F.col("signal") == "bollinger", 2).otherwise(3)
    return N.out(resampling.one_standard_error(p.withColumn("complexity", rank), ["subperiod"], "signal", "complexity", "loss"))


SIMPLEST = """, so1 AS (SELECT subperiod, signal, fold, avg(candidate_loss) AS loss FROM pred GROUP BY ALL),
so2 AS (SELECT subperiod, signal, CASE signal WHEN 'rsi' THEN 1 WHEN 'bollinger' THEN 2 ELSE 3 END AS complexity, avg(loss) AS mean_loss, coalesce(stddev_samp(loss) / sqrt(count(loss)), 0.0) AS se FROM so1 GROUP BY ALL),
so3 AS (SELECT *, first_value(mean_loss + se) OVER (PARTITION BY subperiod ORDER BY mean_loss, complexity, signal) AS "limit" FROM so2)"""

ENTRIES = {
    "inf_bootstrap": (lambda s, d: N.out(resampling.bootstrap_mean(N.predictions(s, d), ["signal"], "incremental_net_edge", 2000, 10)), sql(PREDICTIONS + "," + _boot("bo", "pred", "signal", "incremental_net_edge", 2000, 10), f"SELECT signal, n, {BOUNDS} FROM bo")),
    "inf_bootstrap_blocks": (lambda s, d: N.out(resampling.bootstrap_mean(N.matched(s, d), ["signal"], "incremental_log_loss", 5000, 21)), sql(MATCHED + "," + _boot("bo", "matched", "signal", "incremental_log_loss", 5000, 21), f"SELECT signal, n, {BOUNDS} FROM bo")),
    "inf_intervals": (lambda s, d: N.out(locked_evidence.intervals(N.matched(s, d), ["signal"])), intervals_sql()),
    "inf_event_table": (
        lambda s, d: N.out(first_generation.event_table(N.features(s, d), first_generation.Config())),
        sql(EVENTS, f"""SELECT signal, event_count, long_events, short_events, {r6('mean_net_signed_return', 'win_rate_after_cost', 'ci_lower', 'ci_upper', 'p_value')},
CASE WHEN event_count < 30 THEN 'INSUFFICIENT_EVENTS' WHEN ci_lower > 0 AND p_value < 0.05 THEN 'DESCRIPTIVE_EDGE' WHEN ci_upper <= 0 THEN 'NO_DESCRIPTIVE_EDGE' ELSE 'INCONCLUSIVE' END AS verdict
FROM es LEFT JOIN (SELECT signal, lower AS ci_lower, upper AS ci_upper FROM eb) USING (signal) LEFT JOIN rv USING (signal)"""),
    ),
    "inf_superior_ability": (superior, sql(SUPERIOR, f"SELECT fold, candidates, best, {r6('statistic', 'p_consistent', 'p_upper')} FROM sp2 JOIN sp4 USING (fold)")),
    "sel_one_standard_error": (simplest, sql(PREDICTIONS + SIMPLEST, f"SELECT subperiod, signal, complexity, {r6('mean_loss', '\"limit\"')} FROM so3 WHERE mean_loss <= \"limit\" QUALIFY row_number() OVER (PARTITION BY subperiod ORDER BY complexity, mean_loss, signal) = 1")),
}
