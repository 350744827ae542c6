"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.saved import Run, discard, drop_saved, save, shared_dir  # noqa: F401  (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> dict[str, str]:
    """A column name for each of `names` that is not taken, whatever its case."""
    used, out = {c.lower() for c in taken}, {}
    for name in names:
        new = f"__{name}"
        while new.lower() in used:
            new = f"_{new}"
        used.add(new.lower())
        out[name] = new
    return out


def crc32_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null gives null."""
    return F.crc32(col.cast("string").cast("binary")) % m


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of labelled training documents; of labels that contradict one another the greater.

    Training rows are those whose crc32(doc_id as text) modulo 4 is not 2.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc32_mod(F.col("doc_id"), 4) != 2))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def first_ids(ids: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """At most `rows` rows of ids, by a hash of doc_id: few enough to broadcast whatever the tables' size."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` (a bounded set of ids) with the text of each: of rows that repeat an id the one whose text
    has the least hash, so the rows are bounded too."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    others = [c for c in chosen.columns if c != "doc_id"]
    found = plain.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", *others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
