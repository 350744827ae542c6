"""The corpus pipeline: documents in, a token file out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
documents it keeps with their columns, extra ones and such as clash with an operator's own included;
the last returns what it read back from the token file. Null and empty texts pass the stages as
their operators define; rows that repeat a doc_id, or have none, are decided on one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_dedup, quality, token_binary
from tidemark.llm.common import Run, fresh, save, table
from tidemark.llm.queries import END_ID, tokenizer_path

SIMILARITY = 80
MIX_COLUMNS = {"topic", "n_tokens", "weight", "probability", "raking_error", "kept"}


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written with a key of each row, so that decisions hold for rows, whatever their doc_ids."""
    key = fresh(docs.columns, "row")["row"]
    return save(docs.withColumn(key, F.monotonically_increasing_id()), "rows", compression="zstd"), key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs.columns, "score", "predicted").values()
    return quality.score_rows(docs, ranker, score, predicted).where(F.col(predicted) == 1).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 0.8): the smallest doc_id, nulls last."""
    rows, key = _rows(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), SIMILARITY)
    ids = rows.select(F.col(key).alias("k"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key)).alias("place"))
    placed = save(found.select(F.col("doc_id").alias("k"), "component_id").join(ids, "k"), "placed")
    # Written, so that a component with a third of all rows is a skewed side of a join that Spark splits.
    first = save(placed.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    copies = placed.join(first, "component_id").where("place <> first").select(F.col("k").alias(key))
    return rows.join(copies, key, "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold ten words in a row of a benchmark item."""
    rows, key = _rows(docs)
    found = decontaminate.contamination(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = found.where("contaminated").select(F.col("doc_id").alias(key))
    return rows.join(leaks, key, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to tempered source, language and topic shares."""
    aside = fresh(docs.columns, *(c for c in docs.columns if c.lower() in MIX_COLUMNS))
    mixed = mixing.mix(docs.withColumnsRenamed(aside).withColumn("topic", mixing.topic(F.col("text"))))
    return mixed.where("kept").select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns each document's place in it."""
    blocks, shared = token_binary.token_file(docs.select("doc_id", "text"), tokenizer_path(), END_ID)
    return token_binary.read_blocks(blocks, shared)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again as the next one's documents, and the
    tables that made it are deleted."""
    docs = table(spark, sf_dir, "documents")
    with Run(spark) as own:
        for name, stage in STAGES:
            docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            own.drop(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
