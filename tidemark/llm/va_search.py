"""Exact top-k inner-product search by vector-approximation files.

`approximate` cuts the vectors into blocks of rows and stores, per block, the exact integer
vectors and their cells: every component is quantised to one of 2**cell_bits cells between the
block's least and greatest value in that dimension. A search has two parts:
1. The cells alone are read, twice. They bound each score from below and above. The first pass returns
   each lane's k best lower bounds of a query, which give one floor over all lanes; the second returns the
   rows whose upper bound reaches it, whatever the order in which blocks arrive.
2. Exact vectors of the rows left are read in the order of the better bound: the k best bounds
   first, then only those whose bound still reaches the kth exact score.

Queries are rows of the same or another table, packed in blocks too; each query block meets each
block of cells, in a Cartesian product whose tasks read both from where they are stored. Of equal vectors in a block only the rows that can be
in a result are looked at (those of the k + 1 smallest ids), so a vector that a third of all rows
share gives no more candidates than any other.

Defined results: vectors that are null or hold null or non-finite components take no part, neither
as queries nor as candidates; shorter vectors count as padded with zeros, an empty one is all
zeros; ties go to the smaller vec_id; rows that repeat a vec_id are candidates of their own except
for a query of that vec_id, and as queries give ranks 1 to k each; rows without vec_id take no part;
scaled components of 2**62 or more, and scores beyond 64 bits, raise an error; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import save, shuffle_partitions

SCALE = 256
CELL_BITS = 8
BLOCK_ROWS = 4096
QUERY_ROWS = 256
HELD_BLOCKS = 64
FILE = "block long, n long, dims long, kind string, ids binary, exact binary, turn binary, cells binary, low binary, width binary"


def valid(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & whole


def whole_numbers(parts: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """Scaled components as int64, one row a vector."""
    x = np.zeros((len(parts), max((len(p) for p in parts), default=0)))
    for i, p in enumerate(parts):
        x[i, : len(p)] = p
    x = np.floor(scale * x)
    if np.abs(x).max(initial=0) >= 2.0**62:
        raise OverflowError("a scaled component needs more than 62 bits")
    return x.astype(np.int64)


def cells(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of integer vectors, and each dimension's least value and cell width, all int64."""
    low, high = x.min(axis=0), x.max(axis=0)
    width = (high - low) // (1 << bits) + 1
    return (x - low) // width, low, width


def turns(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row among the block's equal vectors: how many smaller ids, or earlier rows of its id, there are."""
    _, same = np.unique(x, axis=0, return_inverse=True) if x.shape[1] else (None, np.zeros(len(ids), np.int64))
    order = np.lexsort((ids, same.ravel()))
    s, i = same.ravel()[order], ids[order]
    new_vector = np.diff(s, prepend=-1) != 0
    new_id = new_vector | (np.diff(i, prepend=i[:1]) != 0)
    before = lambda first: np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    number = np.cumsum(new_id)
    out = np.empty(len(s), np.int64)
    out[order] = np.maximum(number - number[before(new_vector)], np.arange(len(s)) - before(new_id))
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The narrowest of 16, 32 and 64 bits that holds all values."""
    top = np.abs(x).max(initial=0)
    return x.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")


def approximate(vectors: DataFrame, block_rows: int = BLOCK_ROWS, cell_bits: int = CELL_BITS) -> DataFrame:
    """The stored file: a row per block of (vec_id, v) with ids, exact vectors, cells and cell borders."""

    def pack(number: int, ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        x, i = whole_numbers(parts), np.array(ids, np.int64)
        code, low, width = cells(x, cell_bits)
        exact = narrow(x)
        row = {"block": number, "n": len(i), "dims": x.shape[1], "kind": exact.dtype.str, "ids": i.tobytes(), "exact": exact.tobytes(), "turn": turns(i, x).astype(np.uint32).tobytes(), "cells": code.astype(np.uint8).tobytes(), "low": low.tobytes(), "width": width.tobytes()}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, parts = TaskContext.get().partitionId() << 24, [], []
        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                ids.append(vec_id)
                parts.append(np.asarray(v.values, np.float64))
                if len(ids) >= block_rows:
                    yield pack(number, ids, parts)
                    ids, parts, number = [], [], number + 1
        if ids:
            yield pack(number, ids, parts)

    return save(vectors.mapInArrow(run, FILE), "va-file")


def _array(raw: bytes, kind, n: int, dims: int, wide: int) -> np.ndarray:
    return np.pad(np.frombuffer(raw, kind).reshape(n, dims), ((0, 0), (0, wide - dims)))


def bounds(q: np.ndarray, code: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows) and cells (columns)."""
    q, corner, span = q.astype(np.float64), low.astype(np.float64) + code * width.astype(np.float64), width.astype(np.float64) - 1
    middle = q @ corner.T
    top = np.abs(corner).max(axis=0, initial=0) + span
    slack = (np.abs(q) @ top) * (len(span) + 4) * 2.0**-51  # of rounding; nothing where all is below 2**53
    slack = np.where(slack < 0.25, 0.0, slack)
    return middle + (np.minimum(q, 0) @ span - slack)[:, None], middle + (np.maximum(q, 0) @ span + slack)[:, None]


def all_pairs(asked: DataFrame, prefix: str, file: DataFrame) -> DataFrame:
    """Each block of a saved query set (its columns get the prefix) with every block of the file.

    A Cartesian product by hint, whatever the sizes: its tasks read the blocks of queries where they are
    stored, so these are neither copied for each lane nor broadcast, and the driver holds none of them. The
    file moves once, to lanes; a task takes one block of queries after the other through its lane.
    """
    lanes = max(1, min(shuffle_partitions(file.sparkSession), file.count()))
    sent = asked.select(*(F.col(c).alias(f"{prefix}{c}") for c in asked.columns))
    return sent.hint("shuffle_replicate_nl").crossJoin(file.repartition(lanes))


def _meet(asked: DataFrame, file: DataFrame, k: int, look, schema: str, done=None) -> DataFrame:
    """Each block of queries with every block of cells.

    look(state, row, part, lower, upper, places) is called for parts of a block of queries; a task keeps the
    states of a bounded number of query blocks, and `done` turns a state that is put away into rows.
    """
    held = file.select("block", "n", "dims", "ids", "turn", "cells", "low", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, dict] = {}
        for batch in batches:
            for r in batch.to_pylist():
                block, ids, q_ids = r["q_block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                left = np.flatnonzero(np.frombuffer(r["turn"], np.uint32) <= k)
                wide = max(r["dims"], r["q_dims"])
                code = _array(r["cells"], np.uint8, r["n"], r["dims"], wide)[left]
                low, width = (np.pad(np.frombuffer(r[c], np.int64), (0, wide - r["dims"]), constant_values=v) for c, v in (("low", 0), ("width", 1)))
                q = _array(r["q_exact"], r["q_kind"], r["q_n"], r["q_dims"], wide)
                if block not in states:
                    if done and len(states) == HELD_BLOCKS:
                        old = next(iter(states))
                        yield done(old, states.pop(old))
                    states[block] = {}
                for at in range(0, len(q), QUERY_ROWS):
                    part = slice(at, at + QUERY_ROWS)
                    lower, upper = bounds(q[part], code, low, width)
                    own = q_ids[part, None] == ids[None, left]
                    lower[own] = upper[own] = -np.inf
                    found = look(states[block], r, part, lower, upper, left)
                    if found is not None:
                        yield found
                if not done:
                    states.clear()
        for block, state in states.items() if done else ():
            yield done(block, state)

    return all_pairs(asked, "q_", held).mapInArrow(run, schema)


def _floors(queries: DataFrame, file: DataFrame, k: int) -> DataFrame:
    """(q_row, floor): a bound under each query's kth best score, from the k best lower bounds of each lane."""

    def look(state, row, part, lower, upper, left):
        if "best" not in state:
            state["best"] = np.full((row["q_n"], k), -np.inf)
        both = np.concatenate([state["best"][part], lower], axis=1)
        state["best"][part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]

    def done(block: int, state: dict) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(state["best"]))
        return pa.RecordBatch.from_pydict({"q_row": pa.array((block << 16) + i, pa.int64()), "low": pa.array(state["best"][i, j])})

    best = W.partitionBy("q_row").orderBy(F.desc("low"))
    lows = _meet(queries, file, k, look, "q_row long, low double", done).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return lows.groupBy("q_row").agg(F.min("low").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select("q_row", "floor")


def _scan(queries: DataFrame, file: DataFrame, k: int) -> DataFrame:
    """(q_row, row, upper): rows that the cells do not rule out, given each query's floor over all lanes."""
    place = F.struct(F.col("q_row").bitwiseAND(F.lit(65535)).alias("i"), "floor")
    floors = _floors(queries, file, k).groupBy(F.shiftright("q_row", 16).alias("block")).agg(F.collect_list(place).alias("floors"))
    asked = save(queries.join(floors, "block", "left"), "floors")

    def look(state, row, part, lower, upper, left):
        floor = np.full(row["q_n"], -np.inf)
        for x in row["q_floors"] or ():
            floor[x["i"]] = x["floor"]
        i, j = np.nonzero((upper >= floor[part, None]) & (upper > -np.inf))
        return pa.RecordBatch.from_pydict({"q_row": pa.array((row["q_block"] << 16) + part.start + i, pa.int64()), "row": pa.array((row["block"] << 16) + left[j], pa.int64()), "upper": pa.array(upper[i, j])})

    return _meet(asked, file, k, look, "q_row long, row long, upper double")


def _rows(blocks: DataFrame, row: str, vec_id: str, v: str) -> DataFrame:
    """A row per exact vector of blocks; with a column `wanted` (places in the block) of those alone."""
    some = "wanted" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["exact"], r["kind"]).reshape(r["n"], r["dims"])
                at = np.array(r["wanted"] if some else range(r["n"]), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * r["dims"]), pa.array(x[at].astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array((r["block"] << 16) + at), pa.array(ids[at]), lists], names=[row, vec_id, v])

    columns = ["block", "n", "dims", "kind", "ids", "exact", *(["wanted"] if some else [])]
    return blocks.select(*columns).mapInArrow(run, f"{row} long, {vec_id} long, {v} array<long>")


def _exact(pairs: DataFrame, file: DataFrame, asked: DataFrame) -> DataFrame:
    """(q_row, query_id, vec_id, score) of pairs (q_row, row); a block's list of places is at most its rows."""
    places = pairs.select("row").distinct().groupBy(F.shiftright("row", 16).alias("block")).agg(F.collect_list(F.col("row").bitwiseAND(F.lit(65535))).alias("wanted"))
    found = _rows(file.join(places, "block"), "row", "vec_id", "v")

    def product(kind: str) -> Column:
        zero = F.lit(0).cast(kind)
        terms = F.zip_with("q", "v", lambda a, b: F.coalesce(a.cast(kind), zero) * F.coalesce(b.cast(kind), zero))
        return F.aggregate(terms, zero, lambda total, x: total + x)

    score = F.when(F.abs(product("double")) < 2.0**63, product("long")).otherwise(F.raise_error(F.lit("a score needs more than 64 bits")).cast("long"))
    return pairs.join(found, "row").join(asked, "q_row").select("q_row", "query_id", "vec_id", score.alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, cell_bits: int = CELL_BITS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, embedding) over all (vec_id, embedding)."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        return df.where(F.col("vec_id").isNotNull() & valid(v)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    if not (0 < block_rows <= 65536 and 0 < cell_bits <= 8):
        raise ValueError("blocks hold up to 65536 rows, cells up to 8 bits")
    file, wanted = approximate(usable(vectors), block_rows, cell_bits), usable(queries)
    # A stated query set against all rows, block by block: each query block goes to every vector block.
    asked = approximate(wanted.repartition(1 + wanted.count() // block_rows), block_rows, cell_bits)
    by_query = W.partitionBy("q_row")
    left = save(_scan(asked, file, k).withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("upper"), "row"))), "candidates")
    q_rows = _rows(asked, "q_row", "query_id", "q")
    first = save(_exact(left.where(F.col("turn") <= k).select("q_row", "row"), file, q_rows), "scores")
    kth = first.groupBy("q_row").agg(F.min("score").alias("kth"))
    rest = left.where(F.col("turn") > k).join(kth, "q_row").where("upper >= kth").select("q_row", "row")
    found = first.unionByName(_exact(rest, file, q_rows))
    return found.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
