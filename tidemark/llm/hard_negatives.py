"""Exact hard-negative mining by an orthogonal rotation with early discards.

For every anchor: its positives are the first `positives` other rows of its label, by integer inner
product; for every positive, the negatives are the first `negatives` rows of other labels whose score
lies in [low, high] percent of the positive's score.

1. `rotation`: the eigenvectors of the vectors' summed outer products, the leading ones first. The sums
   are aggregated over all rows; the driver holds one matrix of dimension x dimension.
2. `search`: anchors and vectors are packed in blocks. For a pair of blocks, the partial product of the
   leading rotated components is accumulated stage by stage. What is left of a score is at most the
   product of the residual norms; with a slack for rounding (of the rotation, of its departure from
   orthogonality, of the sums) that gives an interval of the exact score. Pairs whose interval cannot
   reach a wanted place are discarded at once; those left after the last stage are verified by integer
   products, and only these exact scores decide.
3. A task goes on with the best exact scores found so far, so later blocks discard sooner. It returns at
   most `positives` (or positives x negatives) rows an anchor; a window merges the tasks' rows.

Scale: a stated query set meets all rows, block by block. Vectors move once, to lanes; the tasks of a
Cartesian product read anchor blocks where they are stored, so these are not copied for each lane or sent
through the driver; no task emits more than its anchors' places, so rows that a third of the table
repeats add no rows. Positives are found and written before negatives are asked for.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no
part; shorter vectors are padded with zeros; "other" rows are those of another vec_id, and rows that
repeat a vec_id are each anchors, positives and negatives of their own; ties go to the smaller vec_id;
a positive whose score is 0 takes negatives of score 0, one below 0 takes none; vectors the product of
whose norms reaches 2**53 raise an error; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import discard, save
from tidemark.llm.va_search import all_pairs, narrow, valid, whole_numbers

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
BLOCK_ROWS, ANCHOR_ROWS = 4096, 512
STAGES = (1 / 8, 1 / 4, 1 / 2, 1)
CHUNK_PAIRS = 100_000
HELD_BLOCKS = 64
FILE = "block long, n long, dims long, kind string, ids binary, labels binary, exact binary"


def pack(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored blocks of (vec_id, label, v), all integers."""

    def block(number: int, ids: list[int], labels: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        exact = narrow(whole_numbers(parts, SCALE))
        row = {"block": number, "n": len(ids), "dims": exact.shape[1], "kind": exact.dtype.str, "ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int64).tobytes(), "exact": exact.tobytes()}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, labels, parts = TaskContext.get().partitionId() << 24, [], [], []
        for batch in batches:
            for i, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("v")):
                ids.append(i), labels.append(label), parts.append(np.asarray(v.values, np.float64))
                if len(ids) >= block_rows:
                    yield block(number, ids, labels, parts)
                    ids, labels, parts, number = [], [], [], number + 1
        if ids:
            yield block(number, ids, labels, parts)

    return save(rows.mapInArrow(run, FILE), "negatives-file")


def unpack(kind: str, exact: bytes, n: int, dims: int, wide: int) -> np.ndarray:
    return np.pad(np.frombuffer(exact, kind).reshape(n, dims).astype(np.int64), ((0, 0), (0, wide - dims)))


def rotation(file: DataFrame, wide: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes, the leading ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            for r in batch.to_pylist():
                x = unpack(r["kind"], r["exact"], r["n"], r["dims"], wide).astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(wide), "row": pa.array(list(total), pa.list_(pa.float64()))})

    outer = file.select("kind", "exact", "n", "dims").mapInArrow(run, "i long, row array<double>")
    added = outer.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # wide * wide rows
    gram = np.zeros((wide, wide))
    for r in added:
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


def rounding(turn: np.ndarray) -> float:
    """Slack of a rotated product in parts of |x| |y|: departure from orthogonality and float64 rounding."""
    wide = len(turn)
    apart = np.abs(turn @ turn.T - np.eye(wide)).sum(axis=1).max(initial=0)
    return float(apart + 8 * (wide + 8) ** 1.5 * 2.0**-52)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)


class Side:
    """Rotated vectors, the norms of what is left after each stage, and the whole norms."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, stages: list[int]):
        self.exact, self.z, self.norm = x, x.astype(np.float64) @ turn, _norms(x)
        self.rest = [_norms(self.z[:, m:]) for m in stages]


def stage_ends(wide: int) -> list[int]:
    return sorted({min(wide, int(np.ceil(wide * s))) for s in STAGES})


def survivors(a: Side, b: Side, slack: float, ends: list[int], near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) whose exact score may be wanted, by partial products of ever more components.

    near(i, j, lower, upper) tells which pairs may be: first it gets whole matrices (i and j None),
    then the pairs left.
    """
    if a.norm.max(initial=0) * b.norm.max(initial=0) >= 2.0**53:
        raise OverflowError("a score may need more than 53 bits")
    part = a.z[:, : ends[0]] @ b.z[:, : ends[0]].T
    room = a.rest[0][:, None] * b.rest[0][None, :] + slack * a.norm[:, None] * b.norm[None, :]
    i, j = np.nonzero(near(None, None, part - room, part + room))
    done = part[i, j]
    for k in range(1, len(ends)):
        kept = []
        for at in range(0, len(i), CHUNK_PAIRS):
            p, q = i[at : at + CHUNK_PAIRS], j[at : at + CHUNK_PAIRS]
            done[at : at + CHUNK_PAIRS] += np.einsum("ij,ij->i", a.z[p, ends[k - 1] : ends[k]], b.z[q, ends[k - 1] : ends[k]])
            now, room = done[at : at + CHUNK_PAIRS], a.rest[k][p] * b.rest[k][q] + slack * a.norm[p] * b.norm[q]
            kept.append(near(p, q, now - room, now + room))
        stay = np.concatenate(kept) if kept else np.zeros(0, bool)
        i, j, done = i[stay], j[stay], done[stay]
    return i, j


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs."""
    return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", a[i[at : at + CHUNK_PAIRS]], b[j[at : at + CHUNK_PAIRS]]) for at in range(0, len(i), CHUNK_PAIRS))])


class Places:
    """The k best (score, vec_id) of every group, ties to the smaller vec_id."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, -np.inf)
        self.group, self.score, self.vec_id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        g, s, v = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((v, -s, g))
        g = g[order]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        kept = rank < self.k
        self.group, self.score, self.vec_id = g[kept], s[order][kept], v[order][kept]
        last = rank == self.k - 1
        self.least[g[last]] = s[order][last]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The kth largest value of every row."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


class PositiveSearch:
    """Same-label rows of one block of anchors; a group is an anchor."""

    groups_of = 1

    def __init__(self, row: dict, positives: int):
        self.n, self.k = row["n"], positives
        self.places = Places(self.n, positives)

    def look(self, a: Side, b: Side, a_ids, a_labels, b_ids, b_labels, slack: float, ends: list[int]) -> None:
        own = (a_labels[:, None] == b_labels[None, :]) & (a_ids[:, None] != b_ids[None, :])
        floor = self.places.least

        def near(i, j, lower, upper):
            nonlocal floor
            if i is None:
                if not np.isfinite(floor).all():
                    floor = np.maximum(floor, _kth(np.where(own, lower, -np.inf), self.k))
                return own & (upper >= floor[:, None])
            return upper >= floor[i]

        i, j = survivors(a, b, slack, ends, near)
        self.places.add(i, products(a.exact, b.exact, i, j), b_ids[j])


class NegativeSearch:
    """Rows of other labels within each positive's band; a group is an anchor and a positive."""

    def __init__(self, row: dict, positives: int, negatives: int, low: int, high: int):
        self.n, self.m, self.k = row["n"], positives, negatives
        score = np.frombuffer(row["scores"], np.int64).reshape(self.n, positives)
        there = np.arange(positives)[None, :] < np.frombuffer(row["found"], np.int64)[:, None]
        self.score, self.there, self.low, self.high = score, there, low, high
        self.bottom = np.where(there, -(-(low * score) // 100), 1).astype(np.float64)
        self.top = np.where(there, (high * score) // 100, 0).astype(np.float64)
        self.places = Places(self.n * positives, negatives)

    def look(self, a: Side, b: Side, a_ids, a_labels, b_ids, b_labels, slack: float, ends: list[int]) -> None:
        other = (a_labels[:, None] != b_labels[None, :]) & (a_ids[:, None] != b_ids[None, :])
        least = self.places.least.reshape(self.n, self.m)
        floor = np.maximum(self.bottom, least)

        def near(i, j, lower, upper):
            wanted = np.zeros(lower.shape, bool)
            for p in range(self.m):
                if i is None:
                    if not np.isfinite(least[:, p]).all():
                        sure = other & (lower >= self.bottom[:, p, None]) & (upper <= self.top[:, p, None])
                        floor[:, p] = np.maximum(floor[:, p], _kth(np.where(sure, lower, -np.inf), self.k))
                    wanted |= (upper >= floor[:, p, None]) & (lower <= self.top[:, p, None]) & self.there[:, p, None]
                else:
                    wanted |= (upper >= floor[i, p]) & (lower <= self.top[i, p]) & self.there[i, p]
            return wanted & other if i is None else wanted

        i, j = survivors(a, b, slack, ends, near)
        s = products(a.exact, b.exact, i, j)
        for p in range(self.m):
            score = self.score[i, p]
            band = self.there[i, p] & (self.low * score <= 100 * s) & (100 * s <= self.high * score)
            self.places.add(i[band] * self.m + p, s[band], b_ids[j[band]])


def search(asked: DataFrame, file: DataFrame, turn: np.ndarray, make, groups: int) -> DataFrame:
    """(a_row, place, score, vec_id): the exact best of each lane for every anchor; `place` is its group.

    asked, a saved table, has the columns of the file and what `make` needs to start a block of anchors with.
    """
    slack, wide = rounding(turn), len(turn)
    ends = stage_ends(wide)

    def side(r: dict, prefix: str) -> tuple:
        x = unpack(r[f"{prefix}kind"], r[f"{prefix}exact"], r[f"{prefix}n"], r[f"{prefix}dims"], wide)
        return Side(x, turn, ends), np.frombuffer(r[f"{prefix}ids"], np.int64), np.frombuffer(r[f"{prefix}labels"], np.int64)

    def found(block: int, held) -> pa.RecordBatch:
        p = held.places
        return pa.RecordBatch.from_pydict({"a_row": (block << 16) + p.group // groups, "place": p.group % groups, "score": p.score, "vec_id": p.vec_id})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # by block of anchors: a bounded number
        for batch in batches:
            for r in batch.to_pylist():
                block = r["a_block"]
                if block not in held:
                    if len(held) == HELD_BLOCKS:
                        old = next(iter(held))
                        yield found(old, held.pop(old)[0])
                    own = {k[2:]: v for k, v in r.items() if k.startswith("a_")}
                    held[block] = (make(own), *side(r, "a_"))
                task, a, a_ids, a_labels = held[block]
                b, b_ids, b_labels = side(r, "")
                task.look(a, b, a_ids, a_labels, b_ids, b_labels, slack, ends)
        for block, (task, *_) in held.items():
            yield found(block, task)

    return all_pairs(asked, "a_", file).mapInArrow(run, "a_row long, place long, score long, vec_id long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ask(anchors: DataFrame, positives: DataFrame, m: int) -> DataFrame:
    """Anchor blocks with the scores of each anchor's positives: two packed columns."""
    own = positives.groupBy(F.shiftright("a_row", 16).alias("block")).agg(F.collect_list(F.struct(F.col("a_row").bitwiseAND(F.lit(65535)).alias("i"), (F.col("rank") - 1).alias("p"), "score")).alias("own"))
    joined = anchors.join(own, "block")  # anchors without positives ask for nothing; a block's list is at most its rows x m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                score, found = np.zeros((r["n"], m), np.int64), np.zeros(r["n"], np.int64)
                for x in r.pop("own"):
                    score[x["i"], x["p"]] = x["score"]
                    found[x["i"]] += 1
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in (r | {"scores": score.tobytes(), "found": found.tobytes()}).items()})

    return joined.mapInArrow(run, FILE + ", scores binary, found binary")


def _anchor_ids(anchors: DataFrame) -> DataFrame:
    """(a_row, anchor_id) of packed anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"a_row": (r["block"] << 16) + np.arange(r["n"]), "anchor_id": np.frombuffer(r["ids"], np.int64)})

    return anchors.select("block", "n", "ids").mapInArrow(run, "a_row long, anchor_id long")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors and anchors have vec_id, label and embedding; a band is low to high percent of the
    positive's score.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(v)
        return df.where(there).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))

    if not (0 < block_rows <= 65536 and 0 < anchor_rows <= 65536):
        raise ValueError("blocks hold up to 65536 rows")
    file, wanted = pack(usable(vectors), block_rows), usable(anchors)
    asked = pack(wanted.repartition(1 + wanted.count() // anchor_rows), anchor_rows)
    wide = max(df.agg(F.coalesce(F.max("dims"), F.lit(0))).first()[0] for df in (file, asked))
    turn = rotation(file, wide)
    best = search(asked, file, turn, lambda row: PositiveSearch(row, positives), 1)
    first = save(_ranked(best, ["a_row"], positives).select("a_row", "rank", "score", "vec_id"), "positives")
    scored = save(_ask(asked, first, positives), "asked")
    best = search(scored, file, turn, lambda row: NegativeSearch(row, positives, negatives, low, high), positives)
    second = save(_ranked(best, ["a_row", "place"], negatives), "negatives")
    discard(file, scored)
    pairs = first.select("a_row", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs.hint("merge"), ["a_row", "place"]).join(_anchor_ids(asked).hint("merge"), "a_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
