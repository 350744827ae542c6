"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells by their margin columns (source, language, topic). The cells' token sums
are raked: margin after margin, cells are scaled until each margin's sums meet its target shares.
A cell's weight is its raked over its observed tokens. Documents are then sampled: a document is
kept with probability min(1, c * weight), c being such that the expected tokens are the wanted
part of the corpus; the draw is a hash of doc_id, so it is the same in every run.

Scale: one pre-aggregated pass gives the cells; a hot source is one row per task. The steps are the
same at every size: rounds of raking until no margin share is off by more than TOLERANCE (targets that
contradict one another on empty cells never get there: after ROUNDS the worst share's error is what the
column raking_error says), then c by steps from below that end at its exact value. Up to MAX_CELLS cells (the size is
checked) they run on arrays and are broadcast back, beyond that as DataFrame aggregates and joins;
the results agree but for the rounding of sums.

Defined results: a null in a margin column is a value of its own; a null text has no tokens; cells
without tokens have weight 1, or 0 if a given target leaves them out; a value without a target has target
0; targets for values that do not occur are left out and the rest scaled up; a null doc_id is
drawn like the text 'null'; repeated rows are kept or dropped together; an empty table gives an
empty result; extra columns are kept unless they are named like a result column (n_tokens, weight,
probability, raking_error, kept), which then replaces them; margin columns keep their type.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, save

MARGINS = ("source", "lang", "topic")
MAX_CELLS = 200_000
ROUNDS, TOLERANCE = 2000, 1e-12
TEMPER = 0.7
PART = 0.8


def topic(text: Column) -> Column:
    """A stand-in for a topic label, read off the shape of the text."""
    return (
        F.when(text.isNull(), "none")
        .when(F.instr(text, "|") > 0, "table")
        .when(F.instr(text, "!!") > 0, "shout")
        .when(text.rlike("[%&#$*]{3}"), "marks")
        .when(F.length(text) < 600, "short")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(tokens: np.ndarray, power: float = TEMPER) -> np.ndarray:
    """Shares proportional to a power of the token sums; below 1 it lifts the small."""
    t = np.power(tokens.astype(np.float64), power)
    return t / t.sum() if t.sum() else t


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(raked cells, worst error of a margin share): margins in turn, until no margin share is off by more than the tolerance."""
    x, total, worst = tokens.astype(np.float64), float(tokens.sum()), 0.0
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, x, len(target))
            goal = target * total
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(now - goal)[now > 0].max(initial=0)) / max(total, 1))
            x = x * factor[code]
        if worst < TOLERANCE:
            break
    return x, worst


def rake_frame(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """The same on a DataFrame of cells with `tokens`, which gets `raked`. targets: (value, share) of each margin.

    A cell carries the worst error of its margins through a round, so one small aggregate tells when to stop.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    x, worst = save(cells.withColumn("raked", F.col("tokens").cast("double")), "cells"), 0.0
    for _ in range(rounds):
        x = x.withColumn("__off", F.lit(0.0))
        for m in margins:
            now = x.groupBy(m).agg(F.sum("raked").alias("now"))
            goal = now.join(targets[m], now[m].eqNullSafe(targets[m]["value"]), "left").select(F.col(m).alias("__v"), F.coalesce(F.when(F.col("now") > 0, F.col("share") * total / F.col("now")), F.lit(0.0)).alias("factor"), F.when(F.col("now") > 0, F.abs(F.col("now") - F.coalesce("share", F.lit(0.0)) * total)).otherwise(0.0).alias("off"))
            x = x.join(goal, x[m].eqNullSafe(goal["__v"])).withColumns({"raked": F.col("raked") * F.col("factor"), "__off": F.greatest("__off", "off")}).drop("__v", "factor", "off")
        x = save(x, "cells")
        worst = (x.agg(F.max("__off")).first()[0] or 0.0) / max(total, 1)
        x = x.drop("__off")
        if worst < tolerance:
            break
    return x, worst


def keep_factor(want: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """c such that the sum of tokens * min(1, c * weight) is `want` tokens.

    sums(c): tokens of the cells that c keeps for sure, and tokens * weight of the others. c grows
    from 0; each step is right unless it makes more cells sure, so the steps end at the exact value.
    If all cells with a weight are wanted whole, c is infinite.
    """
    c = 0.0
    while True:
        sure, rest = sums(c)
        new = (want - sure) / rest if rest > 0 else np.inf
        if not new > c * (1 + 1e-15):
            return c
        if not np.isfinite(new):
            return np.inf
        c = new


def _kept(weight: Column, c: float) -> Column:
    return (weight > 0).cast("double") if np.isinf(c) else F.least(F.lit(1.0), weight * float(c))


def _solve(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, dict] | None, part: float) -> DataFrame:
    """Cells with weight and probability, raked on the driver."""
    rows = cells.orderBy(*margins).collect()
    tokens = np.array([r["tokens"] for r in rows], np.int64)
    codes, goals = [], []
    for m in margins:
        values = sorted({r[m] for r in rows}, key=lambda v: (v is None, str(v)))
        place = {v: i for i, v in enumerate(values)}
        code = np.array([place[r[m]] for r in rows], np.int64)
        if targets is None:
            goal = tempered(np.bincount(code, tokens, len(values)))
        else:
            goal = np.array([targets[m].get(v, 0.0) for v in values], np.float64)
            goal = goal / goal.sum() if goal.sum() else goal
        codes.append(code)
        goals.append(goal)
    raked, worst = rake(tokens, codes, goals) if rows else (np.zeros(0), 0.0)
    allowed = np.all([(g[c] > 0) | (targets is None) for g, c in zip(goals, codes)], axis=0) if rows else np.zeros(0, bool)
    weight = np.divide(raked, tokens, out=np.where(allowed, 1.0, 0.0), where=tokens > 0)

    def sums(c: float) -> tuple[float, float]:
        sure = c * weight >= 1
        return float(tokens[sure].sum()), float((tokens * weight)[~sure].sum())

    c = keep_factor(min(part * float(tokens.sum()), float(tokens[weight > 0].sum())), sums)
    schema = ", ".join(f"`{m}` string" for m in margins) + ", weight double"
    made = cells.sparkSession.createDataFrame([(*(r[m] for m in margins), float(w)) for r, w in zip(rows, weight)], schema)
    return made.withColumns({"probability": _kept(F.col("weight"), c), "raking_error": F.lit(float(worst))})


def _solve_frame(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, dict] | None, part: float) -> DataFrame:
    """The same for any number of cells; a step of c is one aggregate."""
    spark, goals = cells.sparkSession, {}
    for m in margins:
        sums = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("t"))
        if targets is None:
            share = F.pow(F.col("t"), F.lit(TEMPER))
        else:
            given = spark.createDataFrame([(v, float(s)) for v, s in targets[m].items()], "v string, s double")
            sums = sums.join(given, sums["value"].eqNullSafe(given["v"]), "left")
            share = F.coalesce("s", F.lit(0.0))
        sums = sums.select("value", share.alias("share"))
        whole = sums.agg(F.sum("share")).first()[0] or 1.0
        goals[m] = save(sums.select("value", (F.col("share") / whole).alias("share")), "targets")
    x, worst = rake_frame(cells, margins, goals)
    allowed = F.lit(True)
    for m, shares in (targets or {}).items():
        given = [v for v, s in shares.items() if s > 0 and v is not None]
        allowed = allowed & F.coalesce(F.col(m).isin(given), F.lit(shares.get(None, 0) > 0))
    x = save(x.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(allowed.cast("double"))), "weights")
    t, w = F.col("tokens"), F.col("weight")

    def sums(c: float) -> tuple[float, float]:
        sure = w * float(c) >= 1
        return tuple(float(v or 0) for v in x.agg(F.sum(F.when(sure, t)), F.sum(F.when(~sure, t * w))).first())

    total, able = (float(v or 0) for v in x.agg(F.sum(t), F.sum(F.when(w > 0, t))).first())
    c = keep_factor(min(part * total, able), sums)
    return x.select(*margins, "weight", _kept(w, c).alias("probability"), F.lit(float(worst)).alias("raking_error"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of doc_id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, margins: tuple[str, ...] = MARGINS, targets: dict[str, dict] | None = None, part: float = PART, seed: int = 7, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs and the columns n_tokens, weight, probability, raking_error, kept.

    docs has doc_id, text and the margin columns. targets: share of each value by margin; None
    takes the tempered shares of the corpus itself.
    """
    plain = docs.drop("n_tokens", "weight", "probability", "raking_error", "kept").withColumn("n_tokens", n_words(F.col("text")))
    narrow = plain.select("n_tokens", *(F.col(m).cast("string").alias(m) for m in margins))
    cells = save(narrow.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "cells")
    small = cells.count() <= max_cells
    solved = (_solve if small else _solve_frame)(cells, margins, targets, part)
    own = fresh(plain.columns, *margins)
    solved = solved.select(*(F.col(m).alias(own[m]) for m in margins), "weight", "probability", "raking_error")
    same = [plain[m].cast("string").eqNullSafe(solved[own[m]]) for m in margins]
    joined = plain.join(F.broadcast(solved) if small else solved, same).drop(*own.values())
    return joined.withColumn("kept", uniform(F.col("doc_id"), seed) < F.col("probability"))
