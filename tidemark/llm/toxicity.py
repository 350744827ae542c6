"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; all else is unlabelled text, toxic or not. With the
class prior p, the risk p*E_pos[l(f, 1)] + max(0, E_unl[l(f, 0)] - p*E_pos[l(f, 0)]) is that of
learning from both classes, and the maximum keeps the second part from going negative. The
classifiers are linear over the distinct words of a text and their first four and five letters;
several are trained on reweighted documents and their logits averaged; the bias is then set so that
the mean score of unlabelled text is the prior.

Training uses at most `positives` + `unlabelled` documents, one row an id (a documented bound), and all
features that are significantly more frequent in the positives; every document is scored by its whole
text.

Defined results: null, empty and wordless texts get the score of a text without known features; a
null doc_id is scored and not held out; without positives all scores are 0; repeated rows get equal
scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_mod, discard, first_ids, one_text_each, save, training_labels

POSITIVES, UNLABELLED = 3000, 6000
THRESHOLD = 0.3
LEAST_Z, LEAST_DOCS = 5.0, 3
WORD_CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Feature numbers of a word: itself, its first four and its first five letters."""
    out = [zlib.crc32(word.encode())]
    for k in (4, 5):
        if len(word) > k:
            out.append(zlib.crc32(b"^" + word[:k].encode()))
    return tuple(out)


class Features(dict):
    """Features of words, as numbers of a model's vocabulary if one is given."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = word_features(word)
        if self.known is not None:
            got = tuple(self.known[f] for f in got if f in self.known)
        self[word] = got
        return got

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for w in set(WORD.findall((text or "").lower())):
            found.update(self[w])
        return sorted(found)


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, positive, unlabelled, text) of the training documents, written once."""
    known = first_ids(training_labels(labels, "toxic").where("label = 1"), positives).select("doc_id", F.lit(1).alias("positive"), F.lit(0).alias("unlabelled"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(crc32_mod(F.col("doc_id"), 4) != 2).distinct()
    other = first_ids(ids, unlabelled, seed=1).select("doc_id", F.lit(0).alias("positive"), F.lit(1).alias("unlabelled"))
    chosen = known.union(other).groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    return save(one_text_each(docs, chosen), "sample")


def choose_features(sample: DataFrame, n_pos: int, n_unl: int) -> list[int]:
    """Features that are significantly more frequent in positives."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, pos, unl = Features(), Counter(), Counter()
        for batch in batches:
            for text, p, u in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist(), batch.column("unlabelled").to_pylist()):
                found = features.of(text)
                pos.update(found if p else ())
                unl.update(found if u else ())
        ids = list(pos.keys() | unl.keys())
        yield pa.RecordBatch.from_pydict({"f": pa.array(ids, pa.int64()), "a": pa.array([pos[i] for i in ids], pa.int64()), "b": pa.array([unl[i] for i in ids], pa.int64())})

    counts = sample.mapInArrow(count, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    p = (a + b) / F.lit(float(n_pos + n_unl))
    z = (a / F.lit(float(n_pos)) - b / F.lit(float(n_unl))) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n_pos + 1 / n_unl))
    good = counts.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (a >= LEAST_DOCS))
    return [r["f"] for r in good.orderBy(F.desc("z"), "f").collect()]


def _rows(sample: DataFrame, known: dict[int, int]) -> tuple[Sparse, Sparse]:
    """Positive and unlabelled rows in numbers of the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(known)
        for batch in batches:
            found = [np.array(features.of(t), np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), pa.array(found, pa.binary())], names=["positive", "unlabelled", "f"])

    rows = sample.orderBy("doc_id").mapInArrow(run, "positive int, unlabelled int, f binary").collect()
    return tuple(Sparse([np.frombuffer(bytes(r["f"]), np.uint32) for r in rows if r[c]], len(known)) for c in ("positive", "unlabelled"))


class Sparse:
    """Rows of binary features."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col, self.shape = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64), (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_nnpu(pos: Sparse, unl: Sparse, prior: float, weights: tuple[np.ndarray, np.ndarray], rounds: int = 400, rate: float = 0.1, decay: float = 5e-5) -> np.ndarray:
    """Weights and bias of a linear classifier by the non-negative risk; rows may be weighted."""
    k = pos.shape[1]
    w = np.concatenate([np.zeros(k), [np.log(prior / (1 - prior))]])
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    wp, wu = weights[0] / weights[0].sum(), weights[1] / weights[1].sum()
    for t in range(1, rounds + 1):
        fp, fu = pos.dot(w[:k]) + w[k], unl.dot(w[:k]) + w[k]
        negative = wu @ np.logaddexp(0, fu) - prior * (wp @ np.logaddexp(0, fp))
        gp = -prior * wp * _sigmoid(-fp)
        gn_u, gn_p = wu * _sigmoid(fu), -prior * wp * _sigmoid(fp)
        if negative >= 0:
            g_pos, g_unl = gp + gn_p, gn_u
        else:  # the estimate says less than no risk: step back out of the overfit
            g_pos, g_unl = -gn_p, -gn_u
        g = np.concatenate([pos.back(g_pos) + unl.back(g_unl) + decay * w[:k], [g_pos.sum() + g_unl.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior_bias(logits: np.ndarray, prior: float) -> float:
    """The bias at which the mean score of unlabelled text is the class prior."""
    low, high = -50.0, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(logits + middle).mean() < prior else (low, middle)
    return low


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None, bags: int = 3) -> tuple[list[int], np.ndarray]:
    """(features, weights with the bias last) of the averaged classifiers."""
    sample = _sample(docs, labels, positives, unlabelled)
    n_pos, n_unl = (x or 0 for x in sample.agg(F.sum("positive"), F.sum("unlabelled")).first())
    if not n_pos or not n_unl:
        return [], np.array([-np.inf])
    if prior is None:
        prior = training_labels(labels, "toxic").agg(F.avg(F.col("label").cast("double"))).first()[0]
    prior = min(max(prior, 0.01), 0.9)
    features = choose_features(sample, n_pos, n_unl)
    a, b = _rows(sample, {f: i for i, f in enumerate(features)})
    discard(sample)
    rng, out = np.random.default_rng(3), []
    for _ in range(bags):
        weights = rng.exponential(size=n_pos), rng.exponential(size=n_unl)
        out.append(fit_nnpu(a, b, prior, weights))
    w = np.mean(out, axis=0)
    w[-1] = prior_bias(b.dot(w[:-1]), prior)
    return features, w


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text)."""
    features, weights = train(docs, labels, **options)
    known = {f: i for i, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bias = Features(known), weights[-1]
        for batch in batches:
            logits = np.array([weights[found.of(t.as_py())].sum() + bias for t in batch.column("text")], np.float64)
            score = _sigmoid(logits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    plain = docs.select(doc_id.alias("doc_id"), F.coalesce(crc32_mod(doc_id, 4) == 2, F.lit(False)).alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
