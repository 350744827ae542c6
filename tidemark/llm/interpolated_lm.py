"""Language-model scoring by deleted interpolation.

The model of a token w after h mixes three estimates, with weights that depend on how often the
context h was seen (buckets of powers of two):
    p(w | h) = a[b(h)] * c(h, w) / c(h)  +  u[b(h)] * c(w) / N  +  z[b(h)] / (V + 1)
Counts come from all training documents; the weights come from expectation-maximisation over
held-out counts: estimates from the training documents that are not in the held-out fold are
weighed by the counts of those that are. Documents begin after an end token.

Flow (a chunk is a run of whole documents of about CHUNK_TOKENS tokens):
1. `_chunks`: documents become chunks of local word numbers, written once.
2. `_global_counts`: a chunk sends its distinct words and word pairs, sorted by hash and packed by
   hash range, to the ranges' tasks; these add them up and send each chunk the totals of what it
   asked for, in its own order. A frequent word or pair is one entry per chunk, so no key is hot;
   a range's size is set by the number of ranges, which follows the corpus.
3. `_counted`: chunks meet their totals; each token gets c(w) and c(h, w), and held-out tokens go
   into a histogram of (bucket, pair estimate, word estimate), whose size is fixed by its bins.
4. The driver runs EM on the histogram; tokens are scored from the written counts.

Defined results: null and empty texts are one end token; a null doc_id is in the training part
but never in the held-out fold; repeated rows count as often as they occur; without training
tokens every token has probability 1; extra columns are ignored. Words are told apart by 64-bit
hashes, pairs by 56-bit ones: with a million million different pairs one in 65,000 shares its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import varint
from tidemark.llm.common import crc32_mod, discard, save, shuffle_partitions

CHUNK_TOKENS = 1_000_000
RANGE_TOKENS = 2_000_000
TEST, HELD = 1, 2
BITS, LOW = (64, 56), (5, 4)  # of the hashes of words and of pairs: their size, and how many bytes of a step stand as they are
#: Histogram: levels of a quarter of a factor of two down to 2**-40, one for zero. With 64 buckets it
#: has at most 64 * 161 * 161 = 1.7 million cells, whatever the corpus.
BINS, _ZERO = 4, 160
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def _pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * _M1 + (w ^ (w >> np.uint64(29))) * _M2
    x = (x ^ (x >> np.uint64(32))) * _M1
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - BITS[1])


def _zip(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(varint.encode(values)[0].tobytes())


def _unzip(data: bytes) -> np.ndarray:
    import zstandard

    return varint.decode(zstandard.ZstdDecompressor().decompress(data)).astype(np.int64)


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """(chunk long, n long, docs binary, words binary, tokens binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        known, parts, info = _Ids({b"": 0}), [], []

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            d = np.array(info, np.int64).T.copy()
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number]), "n": pa.array([len(tokens)]), "docs": pa.array([d.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary()), "tokens": pa.array([_zip(tokens)], pa.binary())})

        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, (doc_id, fold) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist())):
                words = (texts[i].as_py() or b"").lower().split()
                words.append(b"")
                parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                info.append((doc_id or 0, doc_id is None, -1 if fold is None else fold, len(words)))
                size += len(words)
                if size >= chunk_tokens:
                    yield close()
                    known, parts, info, size, number = _Ids({b"": 0}), [], [], 0, number + 1
        if parts:
            yield close()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc32_mod(F.col("doc_id").cast("long"), 5).cast("int").alias("fold"))
    return save(plain.mapInArrow(run, "chunk long, n long, docs binary, words binary, tokens binary"), "chunks", compression="none")


class _Chunk:
    """A chunk's documents, tokens, and distinct words and pairs in the order of their hashes."""

    def __init__(self, docs: bytes, words: bytes, tokens: bytes):
        self.doc_ids, self.null, self.fold, self.lengths = np.frombuffer(docs, np.int64).reshape(4, -1)
        words, tokens = np.frombuffer(words, np.uint64), _unzip(tokens)
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]  # a document's first token follows an end, word 0
        context[0] = 0
        self.token_fold = np.repeat(self.fold, self.lengths)
        pairs, pair_of = np.unique(context * len(words) + tokens, return_inverse=True)
        self.keys, self.of = [], []
        for hashes, index in ((words, tokens), (_pair_hash(words[pairs // len(words)], words[pairs % len(words)]), pair_of)):
            order = np.argsort(hashes, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            self.keys.append(hashes[order])
            self.of.append(place[index])
            if index is tokens:
                self.end_place = int(place[0])

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: tokens in kept training documents, and in the held-out fold."""
        at, n, f = self.of[kind], len(self.keys[kind]), self.token_fold
        return np.bincount(at[(f != TEST) & (f != HELD)], minlength=n), np.bincount(at[f == HELD], minlength=n)


def _split(key: np.ndarray, kind: int, ranges: int) -> np.ndarray:
    """The range of each key: even parts of the hashes' span."""
    return ((key >> np.uint64(BITS[kind] - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _steps(keys: np.ndarray, part: np.ndarray, first: np.ndarray, kind: int, ranges: int) -> np.ndarray:
    """Differences of rising keys; those of a range's first keys are taken from where the range begins."""
    step = np.diff(keys, prepend=np.uint64(0))
    begin = ((part[first].astype(np.uint64) << np.uint64(32)) // np.uint64(ranges)) << np.uint64(BITS[kind] - 32)
    step[first] = keys[first] - begin
    return step


def _cut(raw: bytes, ends: np.ndarray) -> list[bytes]:
    at = ends.tolist()
    return [raw[a:b] for a, b in zip([0, *at], at)]


def _both(kept: np.ndarray, held: np.ndarray, ends: np.ndarray) -> list[bytes]:
    at = ends.tolist()
    return [_zip(np.concatenate([kept[a:b], held[a:b]])) for a, b in zip([0, *at], at)]


def _two(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    halves = [_unzip(b).reshape(2, -1) for b in blobs]
    return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])


def _global_counts(chunks: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    """(chunk, range, counts binary, distinct, tokens, kept): counts of a chunk's keys in a range, kept
    and held; rows of chunk -1 have a word range's sums instead."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs, words, tokens in zip(*(batch.column(c).to_pylist() for c in ("chunk", "docs", "words", "tokens"))):
                chunk = _Chunk(docs, words, tokens)
                for kind in (0, 1):
                    keys = chunk.keys[kind]
                    part = _split(keys, kind, ranges[kind]).astype(np.int64)
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(first[1:], len(keys))
                    step = _steps(keys, part, first, kind, ranges[kind])
                    high, size = varint.encode(step >> np.uint64(8 * LOW[kind]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "range": pa.array(part[first] + kind * ranges[0]),
                            "chunk": pa.array(np.full(len(first), number)),
                            "low": pa.array(_cut(varint.encode_low(step, LOW[kind]).tobytes(), ends * LOW[kind]), pa.binary()),
                            "high": pa.array(_cut(high.tobytes(), np.cumsum(np.add.reduceat(size, first))), pa.binary()),
                            "counts": pa.array(_both(*chunk.counts(kind), ends), pa.binary()),
                        }
                    )

    def total(number: int, rows: list[tuple]) -> pa.RecordBatch:
        chunk, low, high, counts = zip(*rows)
        kind = int(number >= ranges[0])
        size = np.array([len(x) // LOW[kind] for x in low])
        first = np.cumsum(size) - size
        step = (varint.decode(b"".join(high)) << np.uint64(8 * LOW[kind])) | varint.decode_low(b"".join(low), LOW[kind])
        run = np.cumsum(step)  # wraps; differences stay right
        _, of = np.unique(run - np.repeat(run[first] - step[first], size), return_inverse=True)
        kept, held = (np.bincount(of, x.astype(np.float64)).astype(np.int64) for x in _two(counts))
        blobs, ids, sums = _both(kept[of], held[of], np.cumsum(size)), list(chunk), [None] * len(chunk)
        out = {"distinct": sums, "tokens": sums, "kept": sums}
        if kind == 0:
            ids, blobs = [*ids, -1], [*blobs, None]
            out = {k: [*sums, int(v)] for k, v in (("distinct", (kept + held > 0).sum()), ("tokens", (kept + held).sum()), ("kept", kept.sum()))}
        return pa.RecordBatch.from_pydict({"chunk": pa.array(ids, pa.int64()), "range": pa.array([number] * len(ids), pa.int64()), "counts": pa.array(blobs, pa.binary()), **{k: pa.array(v, pa.int64()) for k, v in out.items()}})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for number, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "chunk", "low", "high", "counts"))):
                if number != now and rows:
                    yield total(now, rows)
                    rows = []
                now = number
                rows.append(row)
        if rows:
            yield total(now, rows)

    sent = chunks.mapInArrow(emit, "range long, chunk long, low binary, high binary, counts binary")
    n = shuffle_partitions(chunks.sparkSession)  # word and pair ranges are dealt evenly, each kind from its own start
    dealt = sent.repartitionById(n, F.pmod(F.when(F.col("range") < ranges[0], n - 1 - F.col("range")).otherwise(F.col("range") - ranges[0]), F.lit(n)).cast("int")).sortWithinPartitions("range")
    return save(dealt.mapInArrow(reduce, "chunk long, range long, counts binary, distinct long, tokens long, kept long"), "totals", compression="none")


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2)."""
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0)


def _level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(-np.log2(p) * BINS, _ZERO - 1), _ZERO).astype(np.int64)


def _counted(chunks: DataFrame, totals: DataFrame, kept_tokens: int) -> DataFrame:
    """(docs, c_word, c_pair, c_end, cells, weights) of each chunk; docs as in `_chunks`."""

    def counted(chunk: _Chunk, blobs: list[bytes]) -> pa.RecordBatch:
        kept, held = _two(blobs)
        n_words = len(chunk.keys[0])
        by_kind = []
        for of, part in ((chunk.of[0], slice(0, n_words)), (chunk.of[1], slice(n_words, None))):
            by_kind.append((kept[part][of], (kept + held)[part][of]))
        (kept_w, all_w), (kept_p, all_p) = by_kind
        seen = np.concatenate([[kept[chunk.end_place]], kept_w[:-1]])
        test = chunk.token_fold == HELD
        pair = kept_p[test] / np.maximum(seen[test], 1)
        word = kept_w[test] / max(kept_tokens, 1)
        cells, weights = np.unique((_bucket(seen[test]) * 256 + _level(pair)) * 256 + _level(word), return_counts=True)
        docs = np.stack([chunk.doc_ids, chunk.null, chunk.fold, chunk.lengths])
        return pa.RecordBatch.from_pydict(
            {
                "docs": pa.array([docs.tobytes()], pa.binary()),
                "c_word": pa.array([_zip(all_w)], pa.binary()),
                "c_pair": pa.array([_zip(all_p)], pa.binary()),
                "c_end": pa.array([int((kept + held)[chunk.end_place])]),
                "cells": pa.array([cells], pa.list_(pa.int64())),
                "weights": pa.array([weights], pa.list_(pa.int64())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, blobs = None, None, []
        for batch in batches:
            for number, r, counts, *own in zip(*(batch.column(c).to_pylist() for c in ("chunk", "range", "counts", "docs", "words", "tokens"))):
                if number != now and chunk is not None:
                    yield counted(chunk, blobs)
                now = number
                if r < 0:
                    chunk, blobs = _Chunk(*own), []
                else:
                    blobs.append(counts)
        if chunk is not None:
            yield counted(chunk, blobs)

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = chunks.select("chunk", F.lit(-1).cast("long").alias("range"), *none("counts"), "docs", "words", "tokens")
    got = totals.where("chunk >= 0").select("chunk", "range", "counts", *none("docs", "words", "tokens"))
    dealt = own.union(got).repartitionByRange(shuffle_partitions(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "range")
    return save(dealt.mapInArrow(run, "docs binary, c_word binary, c_pair binary, c_end long, cells array<long>, weights array<long>"), "counted", compression="none")


def fit_weights(cells: np.ndarray, weights: np.ndarray, distinct: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, [pair, word, uniform]) by EM; thin buckets lean on the pooled ones."""
    bucket, pair, word = cells >> 16, (cells >> 8) & 255, cells & 255
    value = lambda level: np.where(level == _ZERO, 0.0, 2.0 ** (-(level + 0.5) / BINS))
    p = np.stack([value(pair), value(word), np.full(len(cells), 1.0 / (distinct + 1))], axis=1)

    def em(p: np.ndarray, w: np.ndarray, prior: np.ndarray) -> np.ndarray:
        a = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            r = a * p
            r = (r * (w / r.sum(axis=1))[:, None]).sum(axis=0) + prior
            a = r / r.sum()
        return a

    pooled = em(p, weights, np.ones(3)) if len(cells) else np.array([0.4, 0.4, 0.2])
    out = np.tile(pooled, (64, 1))
    for b in np.unique(bucket):
        out[b] = em(p[bucket == b], weights[bucket == b], 10 * pooled)
    out[0] = np.array([0.0, *(out[0][1:] / out[0][1:].sum())])
    return out


def score_documents(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, range_tokens: int = RANGE_TOKENS, mixture: np.ndarray | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text).

    mixture: weights by bucket (64 rows of pair, word, uniform); None fits them to held-out counts.
    """
    chunks = _chunks(docs, chunk_tokens)
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    totals = _global_counts(chunks, (1 + tokens // (8 * range_tokens), 1 + tokens // range_tokens))
    distinct, n_train, n_kept = (x or 0 for x in totals.agg(F.sum("distinct"), F.sum("tokens"), F.sum("kept")).first())
    counted = _counted(chunks, totals, n_kept)
    discard(chunks, totals)
    mix = mixture
    if mix is None:
        cell = F.explode(F.arrays_zip("cells", "weights"))
        rows = counted.select(cell.alias("x")).groupBy(F.col("x.cells").alias("cell")).agg(F.sum("x.weights").alias("weight")).collect()  # bounded by the histogram's cells
        mix = fit_weights(np.array([r["cell"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float64), distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, c_word, c_pair, c_end in zip(*(batch.column(c).to_pylist() for c in ("docs", "c_word", "c_pair", "c_end"))):
                doc_ids, null, fold, lengths = np.frombuffer(raw, np.int64).reshape(4, -1)
                word, pair = _unzip(c_word), _unzip(c_pair)
                seen = np.concatenate([[c_end], word[:-1]])
                a = mix[_bucket(seen)]
                p = a[:, 0] * pair / np.maximum(seen, 1) + a[:, 1] * word / max(n_train, 1) + a[:, 2] / (distinct + 1)
                base = (word + 0.5) / (n_train + 0.5 * (distinct + 1))
                first = np.cumsum(lengths) - lengths
                per_doc = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, mask=null.astype(bool)),
                        "held_out": pa.array(fold == TEST),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(per_doc((word > 0).astype(np.int64))),
                        "train_tokens": pa.array(np.full(len(lengths), n_train)),
                        "base_score": pa.array(per_doc(np.log10(base))),
                        "score": pa.array(per_doc(np.log10(p)) if n_train else np.zeros(len(lengths))),
                    }
                )

    return counted.select("docs", "c_word", "c_pair", "c_end").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
