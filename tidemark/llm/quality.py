"""Quality classifier by Bradley-Terry pairwise ranking.

Every pair of a preferred and a rejected training document is a contest; the chance that the first
wins is the logistic function of the difference of linear scores, fitted by logistic loss on
differences of the documents' features. The cut is a quantile of the training documents' scores:
the level at which it parts the labels best. The reported score puts that cut at 0.7.

The features are shares and repetitions measured on the whole text (letters, case, digits, marks,
lines, word lengths, variety of words in stretches of 100, repeated lines, sentences and word
runs), so the length of a text hardly moves them.

Training uses at most `sample` labelled documents, one row an id (a documented bound); all their pairs
take part. Every document is scored.

Defined results: null and wordless texts are scored as the empty text; a null doc_id is scored and
not held out; if the training labels hold one class only, or none, nothing can be ranked and all
scores are 1; repeated rows get equal scores; extra columns are kept by `score_rows`, but for those
named like its results, and ignored by `score_documents`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc32_mod, first_ids, one_text_each, training_labels

SAMPLE = 8000
PAIR_ROWS = 256  # preferred documents whose pairs are held at a time
CUT = 0.7
SENTENCE = re.compile(rb"[.!?\n]+\s*")
_MARKS = [b"!", b"|", b"%&#$*@^~", b"<>{}[]()\\/=+_", b".,;:'\"-?", b"\n"]
_CLASS = np.full(256, 0, np.int64)
for _k, _chars in enumerate(_MARKS, 1):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 7, 8, 9, 10
_CLASS[32] = 11


def measure(text: bytes | None) -> np.ndarray:
    """The features of a text."""
    text = text or b""
    n = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=12).astype(np.float64)
    size, letters = max(len(text), 1), max(n[7] + n[8] + n[10], 1.0)
    words = text.lower().split()
    count = max(len(words), 1)
    stretches = [words[i : i + 100] for i in range(0, len(words), 100)]
    variety = [len(set(s)) / (len(s) + 0.02 * len(s)) for s in stretches] or [1.0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = [x for x in SENTENCE.split(text) if x]
    runs = max(len(words) - 2, 1)
    shares = [
        *(n[1:7] / size),
        n[7] / letters,
        n[9] / size,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(sentences)) / len(sentences) if sentences else 0.0,
        1 - len(set(zip(words, words[1:], words[2:]))) / runs if len(words) > 2 else 0.0,
        1 - float(np.mean(variety)),
        1 - min(variety),
    ]
    return np.array([*shares, *np.sqrt(np.maximum(shares, 0)), np.log1p(count), np.log1p(sum(map(len, words)) / count), n[10] / letters])


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a good and a bad row, its gradient and its second derivatives."""
    sg, sb, k = good @ w, bad @ w, good.shape[1]
    loss, g, h = 0.0, np.zeros(k), np.zeros((k, k))
    of_bad, weight_bad = np.zeros(len(bad)), np.zeros(len(bad))
    for at in range(0, len(good), PAIR_ROWS):
        x = good[at : at + PAIR_ROWS]
        margin = sg[at : at + PAIR_ROWS, None] - sb
        loss += float(np.logaddexp(0, -margin).sum())
        p = 0.5 * (1 - np.tanh(margin / 2))  # the chance that the worse one wins
        c = p * (1 - p)
        g -= x.T @ p.sum(axis=1)
        cross = x.T @ (c @ bad)
        h += (x * c.sum(axis=1)[:, None]).T @ x - cross - cross.T
        of_bad, weight_bad = of_bad + p.sum(axis=0), weight_bad + c.sum(axis=0)
    n = len(good) * len(bad)
    return loss / n, (g + bad.T @ of_bad) / n, (h + (bad * weight_bad[:, None]).T @ bad) / n


def fit_ranking(good: np.ndarray, bad: np.ndarray, decay: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights that rank good over bad: logistic loss on the feature differences of all pairs, by Newton steps."""
    w = np.zeros(good.shape[1])
    now, g, h = pair_sums(good, bad, w)
    for _ in range(rounds):
        step = np.linalg.solve(h + decay * np.eye(len(w)), g + decay * w)
        value, part = now + decay / 2 * float(w @ w), 1.0
        while True:
            new = w - part * step
            now, g, h = pair_sums(good, bad, new)
            if now + decay / 2 * float(new @ new) <= value + 1e-12 or part < 1e-4:
                break
            part /= 2
        w = new
        if np.abs(part * step).max() < 1e-6:
            break
    return w


def best_quantile(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The quantile level (in thousandths) that parts the labels best, and the score there."""
    levels = np.arange(0, 1000) / 1000
    cuts = np.quantile(score, levels)
    wrong = np.array([((score >= c) != (label == 1)).sum() for c in cuts])
    level = float(np.median(levels[wrong == wrong.min()]))
    return level, float(np.quantile(score, level))


class Ranker:
    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.sd
        self.weights = fit_ranking(z[label == 1], z[label == 0])
        raw = z @ self.weights
        self.level, self.cut = best_quantile(raw, label)
        low = raw[raw < self.cut]
        if len(low):  # the middle of the gap below the cut
            self.cut = (self.cut + float(low.max())) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = (x - self.mean) / self.sd @ self.weights - self.cut
        return 0.5 * (1 + np.tanh((raw + np.log(CUT / (1 - CUT))) / 2))


def _features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measure(t).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("label")], names=["x", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "x binary, label int").collect()
    return np.array([np.frombuffer(bytes(r["x"])) for r in rows]), np.array([r["label"] for r in rows])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker | None:
    """A fitted ranking, or None if there are not both classes."""
    x, label = _features(one_text_each(docs, first_ids(training_labels(labels, "quality"), sample)))
    return Ranker(x, label) if len(set(label.tolist()) & {0, 1}) == 2 else None


def score_rows(docs: DataFrame, ranker: Ranker | None, score: str = "quality_score", predicted: str = "quality_predicted") -> DataFrame:
    """docs (with text) and the columns `score` double and `predicted` int, instead of any of that name."""
    docs = docs.drop(score, predicted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            got = ranker.score(np.array([measure(t.as_py()) for t in texts])) if ranker and len(texts) else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= CUT).astype(np.int32))], names=[*batch.schema.names, score, predicted])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text)."""
    doc_id = F.col("doc_id").cast("long")
    plain = docs.select(doc_id.alias("doc_id"), F.coalesce(crc32_mod(doc_id, 4) == 2, F.lit(False)).alias("held_out"), "text")
    return score_rows(plain, train(docs, labels, sample), "score", "predicted").drop("text")
