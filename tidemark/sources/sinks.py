"""Stage files: strict re-reading, tables with manifests, JSON records, hashes."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL = re.compile(r"^(?:/|[A-Za-z]:[\\/]|file:)")


def read_indexed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stage's CSV: its time column (Timestamp, or the first) parsed strictly, no time twice.

    Times must rise within each part of a file that Spark reads at once; a table has no order beyond that.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    key = "Timestamp" if "Timestamp" in raw.columns else raw.columns[0]
    out = raw.withColumn("ts", F.try_to_timestamp(F.col(key))).drop(*([key] if key != "ts" else []))
    bad, n, distinct = out.agg(F.count_if(F.col("ts").isNull()), F.count("*"), F.countDistinct("ts")).first()
    if bad or n != distinct:
        raise ValueError(f"{path}: {bad} unreadable and {n - bad - distinct} repeated times")
    part = W.partitionBy("part").orderBy("at")
    placed = out.select("ts", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    if falls := placed.withColumn("was", F.lag("ts").over(part)).where("ts < was").count():
        raise ValueError(f"{path}: times fall {falls} times")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _check_paths(value: object) -> None:
    if isinstance(value, dict):
        for v in value.values():
            _check_paths(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            _check_paths(v)
    elif isinstance(value, str) and _LOCAL.match(value):
        raise ValueError("a record must not hold a local path")


def canonical_json(payload: object) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def json_sha256(payload: object) -> str:
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON document as a text dataset, keys sorted; local paths inside are refused."""
    _check_paths(payload)
    text = json.dumps(payload, sort_keys=True)  # one line
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def table_sha256(df: DataFrame, keys: list[str]) -> str:
    """A hash of a table's rows in key order; rows are hashed where they are, then folded by group.

    The driver gets one hash for each of 256 groups of rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    part = F.pmod(F.xxhash64(*keys), F.lit(256)).alias("p")
    parts = df.select(part, row.alias("h")).groupBy("p").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"))
    return hashlib.sha256(",".join(r["h"] for r in parts.orderBy("p").collect()).encode()).hexdigest()


def write_stage(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None) -> dict:
    """Each table as Parquet under the stage's path; the manifest of rows and hashes beside them."""
    manifest: dict = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = df.sparkSession.read.parquet(f"{path}/{name}")
        manifest[name] = {"rows": back.count(), "columns": back.columns, "sha256": table_sha256(back, (keys or {}).get(name, back.columns[:1]))}
    if tables:
        write_json(next(iter(tables.values())).sparkSession, manifest, f"{path}/manifest")
    return manifest


def verify_stage(spark: SparkSession, path: str, keys: dict[str, list[str]] | None = None) -> list[str]:
    """Names of tables that no longer agree with the manifest."""
    wrong = []
    for name, want in read_json(spark, f"{path}/manifest").items():
        back = spark.read.parquet(f"{path}/{name}")
        if back.count() != want["rows"] or table_sha256(back, (keys or {}).get(name, back.columns[:1])) != want["sha256"]:
            wrong.append(name)
    return wrong


@dataclass(frozen=True)
class ExperimentRegistry:
    """A frozen experiment description: boundaries, horizons, grids, gates."""

    payload: dict
    sha256: str = field(default="")

    REQUIRED = ("version", "freeze_status", "horizons", "development", "locked", "validation")

    @classmethod
    def load(cls, text: str, parent: dict | None = None) -> ExperimentRegistry:
        """The description, checked; parent: the release (tag, commit) that it must name as its own, if given."""
        payload = json.loads(text)
        missing = [k for k in cls.REQUIRED if k not in payload]
        if missing:
            raise ValueError(f"registry lacks {', '.join(missing)}")
        if payload["freeze_status"] != "FROZEN":
            raise ValueError("registry is not frozen")
        if parent is not None and payload.get("parent") != parent:
            raise ValueError("registry names another parent release")
        if payload["development"]["end"] >= payload["locked"]["start"]:
            raise ValueError("development and locked periods overlap")
        return cls(payload, json_sha256(payload))
