"""Linear and spline structures of many folds, windows and calibrations, all fitted at once.

Tasks are rows: a fold, a model setting, a training window, columns and a calibration. What they have in
common is fitted once: a fit is a distinct (fold, columns, knots, penalty, rows). The coefficients of all
fits are the state of one keyed Newton loop (`operators.newton`), those of all sigmoid calibrations of a
second, and isotonic maps are merged from ranges (`operators.curves`). Fold rows meet fits in joins, so no
fold is gathered in one task; the driver holds a few numbers a fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import newton
from tidemark.operators.curves import isotonic_blocks, isotonic_map, spline_columns, spline_place
from tidemark.sources.saved import save

FACTS = ["target_up", "future_return"]
HELD, LEAST_HELD = 0.2, 60
EPS = 1e-9


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.log(q / (1 - q))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows of a small table (of fits or tasks) with numbers from 0, in the order of all columns."""
    rows = [tuple(r) for r in df.distinct().orderBy(*df.columns).collect()]
    schema = T.StructType([T.StructField(name, T.IntegerType()), *df.schema.fields])
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def _finite(df: DataFrame, columns: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    return df.where(ok)


def _moments(x: DataFrame, key: str) -> DataFrame:
    """(key, mean, sd): arrays, place by place; what does not vary has sd 1."""
    each = x.select(key, F.posexplode("wide").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    each = each.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    packed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("a"))
    return packed.select(key, F.col("a.m").alias("mean"), F.col("a.s").alias("sd"))


def plan(rows: DataFrame, tasks: DataFrame, keys: list[str], horizon: str, least_train: int, least_test: int) -> DataFrame:
    """A row a fold, task and side: window, held-out rows, and what identifies its fit."""
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"), F.first(horizon).alias("gap"))
    on = [k for k in keys if k in tasks.columns]
    every = sizes.join(F.broadcast(tasks), on) if on else sizes.crossJoin(F.broadcast(tasks))  # folds x settings: both are plans, not data
    size = F.least(F.col("n_train"), F.coalesce(F.col("rows"), F.col("n_train")))
    every = every.withColumn("size", size).withColumn("held", F.when(F.col("method") == "none", 0).otherwise(F.greatest(F.lit(LEAST_HELD), F.floor(F.col("size") * HELD)).cast("int")))
    every = every.withColumn("n_fit", F.col("size") - F.when(F.col("held") > 0, F.col("held") + F.col("gap")).otherwise(0))
    every = every.where((F.col("n_fit") >= least_train) & (F.col("n_test") >= least_test))
    knots = F.when(F.col("model") == "spline", F.regexp_extract("setting", "k([0-9]+)", 1).cast("int")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.lit("benchmark").alias("side"), F.lit(0).alias("kind"), F.lit(0).alias("knots")), F.struct(F.lit("candidate").alias("side"), F.when(F.col("regime_conditioned"), 2).otherwise(1).alias("kind"), knots.alias("knots"))))
    c = F.regexp_extract("setting", "c([0-9.]+)", 1).cast("double")
    return every.withColumn("__side", sides).select(*keys, "pipeline_id", "method", "held", F.col("__side.side").alias("side"), F.col("__side.kind").alias("kind"), F.col("__side.knots").alias("knots"), c.alias("penalty"), F.col("size").cast("int").alias("size"), F.col("n_fit").cast("int").alias("n_fit"))


def fit_tasks(rows: DataFrame, tasks: DataFrame, keys: list[str], base: list[str], signal: list[str], crossed: list[str], horizon: str = "horizon", least_train: int = 120, least_test: int = 20) -> DataFrame:
    """(keys, pipeline_id, method, ts, target_up, future_return, benchmark_probability, candidate_probability) of the test rows of every task.

    tasks: some of the keys, model (linear or spline), setting, pipeline_id, rows (of the training window;
    NULL for all), regime_conditioned (adds the crossed columns), method. Calibrated tasks fit on the
    window's rows but the last fifth (60 at least) and `horizon` rows before it. Both models see the same
    rows; a task with too few of them, or with one outcome alone to fit or calibrate on, gives none.
    """
    spark = rows.sparkSession
    columns = [*base, *signal, *crossed]
    used = list(dict.fromkeys([*keys, horizon, "ts", "part", *columns, *FACTS]))
    whole = _finite(rows.where(F.col("part").isin("train", "test")).select(*used), [*columns, *FACTS])
    whole = save(whole.withColumn("back", F.row_number().over(W.partitionBy(*keys, "part").orderBy(F.desc("ts")))), "complete")
    sides = save(plan(whole, tasks, keys, horizon, least_train, least_test), "plan")
    types = dict(whole.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", pipeline_id string, method string, ts {types['ts']}, target_up int, future_return double, benchmark_probability double, candidate_probability double"
    identity = [*keys, "kind", "knots", "penalty", "size", "n_fit"]
    fits = save(_numbered(sides.select(*identity), "fit_id"), "fits")

    joined = whole.join(F.broadcast(fits), keys)
    inputs = [*signal, *crossed]
    inside = (F.col("part") == "train") & (F.col("back") <= F.col("size")) & (F.col("back") > F.col("size") - F.col("n_fit"))
    ends = joined.where(inside).groupBy("fit_id").agg(F.sum("target_up").alias("ups"), F.count("*").alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(inputs) for n, f in (("low", F.min), ("high", F.max))])
    ends = save(ends.where("ups > 0 and ups < n").select("fit_id", *[F.col(f"{n}{i}") for i in range(len(inputs)) for n in ("low", "high")]), "ends")
    known = save(fits.join(ends, "fit_id"), "known")
    shapes = [tuple(r) for r in known.select("kind", "knots").distinct().collect()]
    if not shapes:
        return spark.createDataFrame([], schema)

    def wide(kind: int, knots: int) -> Column:
        """The columns of a kind of fit, a plain array; spline places were made before."""
        extra = {0: [], 1: signal, 2: inputs}[kind]
        made = [F.array(F.col(c).cast("double")) if not knots else F.array(*spline_columns(F.col(f"__{knots}_{inputs.index(c)}"), knots)) for c in extra]
        return F.concat(F.array(*[F.col(c).cast("double") for c in base]), *made)

    late = (F.col("part") == "test") | (F.col("back") <= F.col("size") - F.col("n_fit"))
    facing = whole.join(F.broadcast(known), keys).where(inside | late).withColumn("fitted", inside)
    places = {f"__{k}_{i}": spline_place(F.col(c), F.col(f"low{i}"), F.col(f"high{i}"), k) for k in sorted({k for _, k in shapes if k}) for i, c in enumerate(inputs)}
    facing = facing.withColumns(places)
    # One shape of columns after the other: a plan of short expressions.
    parts = [facing.where((F.col("kind") == kind) & (F.col("knots") == knots)).select("fit_id", "ts", "part", "back", *FACTS, "fitted", wide(kind, knots).alias("wide")) for kind, knots in shapes]
    facing = parts[0]
    for part in parts[1:]:
        facing = facing.unionByName(part)
    facing = save(facing, "facing")
    moments = save(_moments(facing.where("fitted"), "fit_id"), "moments")
    z = F.transform(F.arrays_zip("wide", "mean", "sd"), lambda v: (v["wide"] - v["mean"]) / v["sd"])
    scaled = facing.join(moments, "fit_id").withColumn("x", z).drop("wide", "mean", "sd")
    fitting = save(scaled.where("fitted").select("fit_id", "x", F.col("target_up").cast("double").alias("y"), F.lit(1.0).alias("w")), "fitting")
    cost = {(r["fit_id"],): r["penalty"] for r in known.select("fit_id", "penalty").collect()}
    beta = newton.table(newton.fit(fitting, ["fit_id"], cost), fitting, ["fit_id"])
    raw = scaled.where("not fitted").join(F.broadcast(beta), "fit_id").select("fit_id", "ts", "part", "back", *FACTS, newton.sigmoid(newton.score(F.col("beta"), F.col("x"))).alias("p"))
    raw = save(raw, "raw")

    who = [*keys, "pipeline_id", "method"]
    placed = save(sides.join(F.broadcast(known.select("fit_id", *identity)), identity).select(*who, "held", "side", "fit_id"), "placed")
    maps = save(_numbered(placed.where("method <> 'none'").select("fit_id", "method", "held"), "map_id"), "maps")
    tested = raw.where("part = 'test'")
    plain = placed.where("method = 'none'").join(tested, "fit_id").select(*who, "side", "ts", *FACTS, "p")
    if not maps.isEmpty():
        held = raw.where("part = 'train'").join(F.broadcast(maps), "fit_id").where(F.col("back") <= F.col("held"))
        mixed = held.groupBy("map_id").agg(F.sum("target_up").alias("ups"), F.count("*").alias("n")).where("ups > 0 and ups < n").select("map_id")
        held = save(held.join(mixed, "map_id").select("map_id", "method", "p", "target_up"), "held")
        usable = save(maps.join(held.select("map_id").distinct(), "map_id"), "usable")
        asked = save(usable.join(tested, "fit_id").select("map_id", "method", "ts", *FACTS, "p"), "asked")
        curve = held.where("method = 'sigmoid'").select("map_id", F.array(_logit(F.col("p"))).alias("x"), F.col("target_up").cast("double").alias("y"), F.lit(1.0).alias("w"))
        gain = newton.table(newton.fit(save(curve, "curve"), ["map_id"], 1e6), held, ["map_id"])
        smooth = asked.where("method = 'sigmoid'").join(F.broadcast(gain), "map_id").withColumn("p", newton.sigmoid(F.col("beta")[0] + F.col("beta")[1] * _logit(F.col("p")))).drop("beta")
        blocks = isotonic_blocks(held.where("method = 'isotonic'"), ["map_id"], "p", "target_up")
        stepped = isotonic_map(asked.where("method = 'isotonic'"), ["map_id"], "p", save(blocks, "blocks")).drop("p").withColumnRenamed("calibrated", "p")
        fixed = smooth.unionByName(stepped).join(F.broadcast(usable.select("map_id", "fit_id", "held")), "map_id").drop("map_id")
        plain = plain.unionByName(placed.join(fixed, ["fit_id", "held", "method"]).select(*who, "side", "ts", *FACTS, "p"))
    plain = plain.withColumn("p", F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS)))
    mark = plain.where("side = 'benchmark'").select(*who, "ts", *FACTS, F.col("p").alias("benchmark_probability"))
    own = plain.where("side = 'candidate'").select(*who, "ts", F.col("p").alias("candidate_probability"))
    return mark.join(own, [*who, "ts"]).select(*who, "ts", F.col("target_up").cast("int").alias("target_up"), "future_return", "benchmark_probability", "candidate_probability")
