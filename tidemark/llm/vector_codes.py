"""Product codes of vectors with integer codebooks, by screened matrix products.

Vectors become integers floor(SCALE * x) and are cut into PARTS equal consecutive parts. Each part
has its own codebook of up to ENTRIES integer entries, which starts as that part of the rows of the
smallest vec_ids. A round assigns every part to its nearest entry and replaces each entry by the
componentwise floor of the mean of its parts; after the rounds the parts are assigned once more.

Nearest entries are found in two steps (`nearest`):
1. One float32 matrix product gives x.c of every part x and entry c. Its rounding error is bounded by
   gamma * |x| * |c|, whatever the order of summation, so |c|^2 - 2 x.c is known within an interval.
2. Every entry whose interval overlaps the best one's is evaluated again in int64; equal distances go
   to the smaller index. The result is that of exact arithmetic.

Scale: a round is one pass over the packed vectors. A task returns one row a used (part, entry) with
exact sums and a count, however many rows it read; the driver holds the codebooks only (ENTRIES times
the vector's length), so a vector that a third of all rows share changes nothing. Vectors are packed
and written once; a lost task reads its blocks again.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter
vectors are padded with zeros to the longest, and all to a multiple of PARTS; rows that repeat a vec_id
are rows of their own, in the order of their components where they start a codebook; rows without
vec_id come last in that order and are returned; fewer than ENTRIES rows give as many entries; ties go
to the lower index, unused entries stay; components of 2**28 or more raise an error, as their squared
distances could leave 64 bits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, save
from tidemark.llm.va_search import narrow, valid, whole_numbers

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
LARGEST = 2**28
BLOCK_ROWS = 4096
CHUNK_ROWS, CHUNK_PAIRS = 1024, 100_000
FILE = "n long, dims long, kind string, ids binary, no_id binary, labels binary, no_label binary, exact binary"
#: A float32 product of m terms is off by at most (m + ROUNDINGS) * 2**-24 * (1 + tiny) of the sum of the terms' sizes: m sums, and each factor rounded once.
ROUNDINGS = 4


def pack(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored blocks of (vec_id, label, v): integers in row order, as narrow as they allow."""

    def block(ids: list, labels: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = whole_numbers(parts, SCALE)
        if np.abs(x).max(initial=0) >= LARGEST:
            raise OverflowError("a scaled component needs more than 28 bits")
        exact = narrow(x)
        flat = lambda values: np.array([v or 0 for v in values], np.int64).tobytes()
        none = lambda values: np.array([v is None for v in values]).tobytes()
        row = {"n": len(ids), "dims": x.shape[1], "kind": exact.dtype.str, "ids": flat(ids), "no_id": none(ids), "labels": flat(labels), "no_label": none(labels), "exact": exact.tobytes()}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, parts = [], [], []
        for batch in batches:
            for i, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("v")):
                ids.append(i), labels.append(label), parts.append(np.asarray(v.values, np.float64))
                if len(ids) >= block_rows:
                    yield block(ids, labels, parts)
                    ids, labels, parts = [], [], []
        if ids:
            yield block(ids, labels, parts)

    return save(vectors.mapInArrow(run, FILE), "codes-file")


def _integers(row: dict, width: int) -> np.ndarray:
    """A block's vectors as (rows, PARTS, width of a part)."""
    x = np.frombuffer(row["exact"], row["kind"]).reshape(row["n"], row["dims"]).astype(np.int64)
    return np.pad(x, ((0, 0), (0, PARTS * width - row["dims"]))).reshape(row["n"], PARTS, width)


def intervals(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c for parts (rows) and entries (columns)."""
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    size = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    off = (x.shape[1] + ROUNDINGS) * 2.0**-24 * 1.001
    middle = (book.astype(np.float64) ** 2).sum(axis=1)[None, :] - 2 * product
    # Denormal products and the float64 sums themselves are off by far less than the last two terms.
    room = 2 * off * size(x)[:, None] * size(book)[None, :] + np.abs(middle) * 2.0**-48 + 1e-9
    return middle - room, middle + room


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry in exact integers; ties to the lower index."""
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), CHUNK_ROWS):
        part = x[at : at + CHUNK_ROWS]
        low, high = intervals(part, book)
        row, entry = np.nonzero(low <= high.min(axis=1)[:, None])
        exact = np.concatenate([((part[row[i : i + CHUNK_PAIRS]] - book[entry[i : i + CHUNK_PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(row), CHUNK_PAIRS)])
        first = np.flatnonzero(np.diff(row, prepend=-1))  # every row has its best entry at least
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        index[at : at + CHUNK_ROWS], distance[at : at + CHUNK_ROWS] = entry[hit], least
    return index, distance


def _start(vectors: DataFrame, width: int) -> np.ndarray:
    """The first codebooks (PARTS, entries, width): parts of at most ENTRIES rows."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    x = whole_numbers([np.array(r["v"], np.float64) for r in rows], SCALE)
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1]))).reshape(len(rows), PARTS, width).swapaxes(0, 1)


def _step(file: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: each task sums the parts of every entry, Spark adds the tasks' sums."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                x = _integers(r, width)
                for p in range(PARTS):
                    index, _ = nearest(x[:, p], books[p])
                    order = np.argsort(index, kind="stable")
                    first = np.flatnonzero(np.diff(index[order], prepend=-1))
                    total[p, index[order][first]] += np.add.reduceat(x[order, p], first, axis=0)
                    count[p] += np.bincount(index, minlength=len(count[p]))
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": count[part, entry], "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    sums = file.select("n", "dims", "kind", "exact").mapInArrow(run, "part long, entry long, n long, total array<long>")
    added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    new = books.copy()
    for r in added.collect():  # at most PARTS * ENTRIES rows
        new[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return new


def train(file: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width of a part) after the rounds."""
    for _ in range(rounds):
        books = _step(file, books)
    return books


def encode(file: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code binary of one byte a part, error long) of every stored vector."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _integers(r, width)
                index, distance = zip(*(nearest(x[:, p], books[p]) for p in range(PARTS)))
                code = np.ascontiguousarray(np.stack(index, axis=1).astype(np.uint8))
                known = lambda name, none: pa.array(np.frombuffer(r[name], np.int64), mask=np.frombuffer(r[none], bool))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"vec_id": known("ids", "no_id"), "label": known("labels", "no_label"), "code": pa.array([c.tobytes() for c in code], pa.binary()), "error": np.sum(distance, axis=0)})

    return file.mapInArrow(run, "vec_id long, label long, code binary, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes and the column vector: the entries that a code names, scaled back."""
    flat = F.lit((books / SCALE).reshape(PARTS, -1, books.shape[2]).tolist())
    byte = lambda i: F.conv(F.hex(F.substring("code", i + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*[flat[i][byte(i)] for i in range(PARTS)])))


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of (vec_id, embedding, label) and the codebooks behind them.

    codes: (vec_id, label, code, error, label_error); label_error adds the errors of equal labels.
    """
    v = F.col("embedding").cast("array<double>")
    usable = vectors.where(valid(v)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    file = pack(usable)
    longest = file.agg(F.max("dims")).first()[0]
    if longest is None:
        empty = np.zeros((PARTS, 0, 0), np.int64)
        return usable.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), empty
    width = -(-longest // PARTS)
    books = train(file, _start(usable, width), rounds)
    codes = save(encode(file, books), "codes")
    discard(file)
    # Written, so that Spark knows its size: it broadcasts a small one and sorts and splits otherwise.
    sums = save(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
