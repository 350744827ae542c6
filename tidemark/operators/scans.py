"""Recurrences along a series as scans over chunks.

A step of a linear recurrence is an operator; operators compose, and composing is associative. So a
series is cut in chunks of bounded length, every chunk is reduced to one operator on its own, the few
chunk operators of a series are folded in order, and every chunk is filled from the value that enters
it. Chunks are spread over tasks; only one small row a chunk meets the others of its series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a chunk, and how far the logarithm of a chunk's coefficients may fall: exp(-SPAN) and its inverse are plain doubles.
ROWS, SPAN = 512, 300.0


def affine_scan(frame: DataFrame, keys: list[str], order: str, steps: list[tuple[Column, dict[str, Column]]], rows: int = ROWS) -> DataFrame:
    """Adds y of y = exp(log_a) * (y before) + b for every (log_a, {y: b}); the first y before is 0.

    log_a is at most 0 and finite, b never null. Within a chunk, y is exp(R) times (what enters + the sum
    of b exp(-R)), where R is the running sum of log_a from the chunk's second row on.
    """
    names = [y for _, made in steps for y in made]
    own = frame.withColumns({f"__l{i}": log_a for i, (log_a, _) in enumerate(steps)} | {f"__b_{y}": b for _, made in steps for y, b in made.items()})
    fall = F.greatest(*[-F.col(f"__l{i}") for i in range(len(steps))], F.lit(0.0))
    along = W.partitionBy(*keys).orderBy(order)
    cut = own.withColumn("__chunk", F.floor(F.sum(fall / SPAN + 1.0 / rows).over(along)))
    dealt = cut.repartition(*keys, "__chunk")
    inside = W.partitionBy(*keys, "__chunk").orderBy(order)
    run = dealt.withColumns({f"__f{i}": F.first(f"__l{i}").over(inside) for i in range(len(steps))} | {f"__r{i}": F.sum(f"__l{i}").over(inside.rowsBetween(W.unboundedPreceding, 0)) for i in range(len(steps))})
    run = run.withColumns({f"__r{i}": F.col(f"__r{i}") - F.col(f"__f{i}") for i in range(len(steps))})
    run = run.withColumns({f"__s_{y}": F.sum(F.col(f"__b_{y}") * F.exp(-F.col(f"__r{i}"))).over(inside.rowsBetween(W.unboundedPreceding, 0)) for i, (_, made) in enumerate(steps) for y in made})

    last = lambda c: F.max_by(c, F.col(order))
    pairs = {y: i for i, (_, made) in enumerate(steps) for y in made}
    operator = [F.struct(last(F.exp(F.col(f"__f{i}") + F.col(f"__r{i}"))).alias("a"), last(F.exp(F.col(f"__r{i}")) * F.col(f"__s_{y}")).alias("b")).alias(y) for y, i in pairs.items()]
    chunks = run.groupBy(*keys, "__chunk").agg(*operator)
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    enters = {f"__in_{y}": F.aggregate(F.collect_list(y).over(before), F.lit(0.0), lambda v, m: m["a"] * v + m["b"]) for y in names}
    entered = chunks.withColumns(enters).select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate([*keys, "__chunk"])], *enters)
    same = [run[k].eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate([*keys, "__chunk"])]
    filled = run.join(entered, same)
    value = {y: F.exp(F.col(f"__r{i}")) * (F.exp(F.col(f"__f{i}")) * F.col(f"__in_{y}") + F.col(f"__s_{y}")) for y, i in pairs.items()}
    return filled.select(*[c for c in frame.columns if c not in value], *[v.alias(y) for y, v in value.items()])


def filter_scan(rows: DataFrame, keys: list[str], order: str, densities: list[str], start: str, transition: str, size: int = ROWS) -> DataFrame:
    """Adds `posterior`: the states' probabilities of every row given the rows up to it.

    densities: columns with a row's density under each state, scaled as one likes (one of them
    positive); start (array) and transition (array of all states' rows, one after the other) are
    constant along a series. A chunk's operator is the product of its rows' transitions, each weighted
    by the densities and divided by its greatest entry, so nothing underflows.
    """
    k = len(densities)
    at = lambda m, i, j: m[i * k + j]
    along = W.partitionBy(*keys).orderBy(order)
    others = [c for c in rows.columns if c not in {*keys, start, transition}]
    cut = rows.withColumn("__rn", F.row_number().over(along) - 1).withColumn("__chunk", F.floor(F.col("__rn") / size))
    packed = F.sort_array(F.collect_list(F.struct("__rn", F.array(*densities).alias("__e"), *others)))
    chunks = cut.groupBy(*keys, "__chunk").agg(F.first(start).alias("__start"), F.first(transition).alias("__t"), packed.alias("__rows"))
    t = F.col("__t")

    def moved(v: Column, i: int, j: int, first: Column) -> Column:
        """Entry (i, j) of v times the transition; the series' first row has none."""
        return F.when(first, at(v, i, j)).otherwise(sum((at(v, i, m) * at(t, m, j) for m in range(1, k)), at(v, i, 0) * at(t, 0, j)))

    def compose(m: Column, x: Column) -> Column:
        top = F.array_max(m)
        return F.array(*[moved(m, i, j, x["__rn"] == 0) * x["__e"][j] / top for i in range(k) for j in range(k)])

    one = F.array(*[F.lit(float(i == j)) for i in range(k) for j in range(k)])
    reduced = chunks.withColumn("__m", F.aggregate("__rows", one, compose))
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)

    def enter(v: Column, m: Column) -> Column:
        entries = [sum((v[i] * at(m, i, j) for i in range(1, k)), v[0] * at(m, 0, j)) for j in range(k)]
        return F.array(*[e / sum(entries[1:], entries[0]) for e in entries])

    entered = reduced.withColumn("__v", F.aggregate(F.collect_list("__m").over(before), F.col("__start"), enter)).drop("__m")

    def fill(acc: Column, x: Column) -> Column:
        v = acc["v"]
        entries = [moved(v, 0, j, x["__rn"] == 0) * x["__e"][j] for j in range(k)]
        # Divided by the sum of the row before last: the next line makes it exact, and nothing underflows meanwhile.
        new = F.array(*[e / F.array_max(v) for e in entries])
        return F.struct(new.alias("v"), F.concat(acc["out"], F.array(new)).alias("out"))

    empty = F.struct(F.col("__v").alias("v"), F.array().cast("array<array<double>>").alias("out"))
    spread = entered.repartition(*keys, "__chunk")
    filled = spread.withColumn("__p", F.aggregate("__rows", empty, fill, lambda acc: acc["out"]))
    long = filled.select(*keys, "__start", "__t", F.explode(F.arrays_zip(F.col("__rows").alias("row"), F.col("__p").alias("p"))).alias("x"))
    total = F.aggregate(F.col("x.p"), F.lit(0.0), lambda a, b: a + b)
    return long.select(*keys, *[F.col(f"x.row.{c}").alias(c) for c in others], F.transform("x.p", lambda e: e / total).alias("posterior"))
