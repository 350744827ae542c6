"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores the postings of every training word. The index is cut by documents into
segments of bounded size (a segment is a run of whole documents of one partition), so building
it needs no shuffle and a lost task is repeated on its own:
    segment long, term binary, postings binary
postings are the word's positions in the segment, as differences in variable-length integers.
The empty term's row holds the segment's documents: five int64 arrays of equal length, one after
the other: doc_id, doc_id is null, first position, words, 0. One position between documents is
left free, so no phrase reaches over two.

`phrase_matches` fetches the postings of the test terms only, segment by segment, and for each
phrase intersects offset-adjusted lists from the segment's rarest term on. Test items are sent to
the tasks in blocks of at most BLOCK_WORDS words (read one block at a time on the driver), however
many there are. `proximity_matches` returns documents in which all words of an item lie within a
given span.

Defined results: null texts have no words; items without words match nothing; windows that several
items share count for each; a null item_id marks hits but is not listed; repeated documents are
reported one by one; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import varint
from tidemark.llm.common import save, shuffle_partitions

WINDOW = 10
SEGMENT_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return (text or b"").translate(_WORD).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def _segment(ids: list[np.ndarray], terms: list[bytes], doc_ids: list, number: int) -> Iterator[pa.RecordBatch]:
    n = np.array([len(i) for i in ids], np.int64)
    starts = np.cumsum(n + 1) - (n + 1)
    flat = np.concatenate(ids)
    position = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(flat, kind="stable")
    sorted_ids, sorted_pos = flat[order], position[order]
    step = np.diff(sorted_pos, prepend=0)
    first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
    step[first] = sorted_pos[first]
    data, size = varint.encode(step)
    edges = np.concatenate([[0], np.cumsum(np.add.reduceat(size, first))]) if len(first) else np.zeros(1, np.int64)
    docs = np.concatenate([[d or 0 for d in doc_ids], [d is None for d in doc_ids], starts, n, n * 0]).astype("<i8").tobytes()
    yield pa.RecordBatch.from_pydict({"segment": pa.array([number], pa.int64()), "term": pa.array([b""], pa.binary()), "postings": pa.array([docs], pa.binary())})
    for at in range(0, len(terms), 20_000):
        part = terms[at : at + 20_000]
        e = edges[at : at + len(part) + 1]
        postings = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((e - e[0]).astype(np.int32).tobytes()), pa.py_buffer(data[e[0] : e[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int64)), pa.array(part, pa.binary()), postings], names=["segment", "term", "postings"])


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        known, ids, doc_ids, size = _Ids(), [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                w = words(texts[i].as_py())
                ids.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                doc_ids.append(doc_id)
                size += len(w) + 1
                if size >= segment_words:
                    yield from _segment(ids, list(known), doc_ids, number)
                    known, ids, doc_ids, size, number = _Ids(), [], [], 0, number + 1
        if ids:
            yield from _segment(ids, list(known), doc_ids, number)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return save(plain.mapInArrow(run, "segment long, term binary, postings binary"), "index", compression="zstd")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Test items (item_id as text, words) in blocks of bounded size, one at a time on the driver."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        w = words(bytes(row["text"]) if row["text"] is not None else None)
        if w:
            held.append((row["item_id"], w))
            size += len(w)
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def _windows(items: list[tuple], window: int | None) -> list[tuple[tuple, list]]:
    """Distinct windows with the ids of their items; window None takes each item whole."""
    found: dict[tuple, list] = {}
    for item_id, w in items:
        size = len(w) if window is None else min(window, len(w))
        for i in range(len(w) - size + 1):
            found.setdefault(tuple(w[i : i + size]), []).append(item_id)
    return list(found.items())


def phrase_starts(phrase: tuple, lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Positions at which a phrase begins: offset-adjusted lists, from the rarest term on."""
    got = [(lists.get(t), k) for k, t in enumerate(phrase)]
    if any(p is None for p, _ in got):
        return np.zeros(0, np.int64)
    got.sort(key=lambda x: len(x[0]))
    starts = got[0][0] - got[0][1]
    for postings, k in got[1:]:
        at = np.searchsorted(postings, starts + k)
        at[at == len(postings)] = 0
        starts = starts[postings[at] == starts + k]
        if not len(starts):
            break
    return starts


def near_starts(terms: tuple, lists: dict[bytes, np.ndarray], within: int) -> np.ndarray:
    """Positions s such that [s, s + within) holds all terms, as often as they are asked for."""
    need = {t: terms.count(t) for t in terms}
    if any(t not in lists for t in need):
        return np.zeros(0, np.int64)
    by_rarity = sorted(need, key=lambda t: len(lists[t]))
    rarest = lists[by_rarity[0]]
    starts = np.unique(np.concatenate([lists[t] for t in need]))
    for t in by_rarity:
        starts = starts[np.searchsorted(lists[t], starts + within) - np.searchsorted(lists[t], starts) >= need[t]]
    return starts if len(rarest) else starts[:0]


def _query(index: DataFrame, items: list[tuple], window: int | None, within: int | None) -> DataFrame:
    """(segment, ord, doc_id, n_words, hits, items, starts) for every document, of one block.

    hits: disjoint [start, end) pairs laid flat, starts: first words of the matches of items[i].
    """
    spark = index.sparkSession
    wanted = _windows(items, window)
    in_windows = Counter(t for phrase, _ in wanted for t in set(phrase))
    by_rarest: dict[bytes, list] = {}
    for phrase, ids in wanted:
        by_rarest.setdefault(min(phrase, key=lambda t: (in_windows[t], t)), []).append((phrase, ids))
    terms = spark.createDataFrame([(bytearray(t),) for t in sorted({t for w, _ in wanted for t in w} | {b""})], "term binary")
    sent = spark.sparkContext.broadcast(by_rarest)

    def answer(segment: int, docs: np.ndarray, lists: dict) -> pa.RecordBatch:
        doc_ids, null, starts, n, _ = docs.reshape(5, -1)
        edge = np.zeros(int(starts[-1] + n[-1]) + 2, np.int32)
        found: list[set] = [set() for _ in range(len(n))]
        # Only windows whose rarest term (of all windows' terms) the segment holds can occur in it.
        for phrase, ids in (w for term in lists for w in sent.value.get(term, ())):
            at = phrase_starts(phrase, lists) if within is None else near_starts(phrase, lists, within)
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, "right") - 1
            if within is None:
                np.add.at(edge, at, 1)
                np.add.at(edge, at + len(phrase), -1)
            else:
                end = np.minimum(at + within, starts[doc] + n[doc])
                inside = np.array([all(np.searchsorted(lists[t], e) - np.searchsorted(lists[t], s) >= phrase.count(t) for t in set(phrase)) for s, e in zip(at, end)])
                at, doc, end = at[inside], doc[inside], end[inside]
                np.add.at(edge, at, 1)
                np.add.at(edge, end, -1)
            for d, s in zip(doc.tolist(), (at - starts[doc]).tolist()):
                found[d].update((i, s) for i in ids)
        cover = np.cumsum(edge) > 0
        turn = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
        lo, hi = turn[::2], turn[1::2]
        doc = np.searchsorted(starts, lo, "right") - 1
        hits: list[list] = [[] for _ in range(len(n))]
        for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()):
            hits[d] += [a - int(starts[d]), b - int(starts[d])]
        pairs = [sorted(f, key=lambda x: (x[0] is None, x[0] or "", x[1])) for f in found]
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(np.full(len(n), segment)),
                "ord": pa.array(np.arange(len(n))),
                "doc_id": pa.array(doc_ids, mask=null.astype(bool)),
                "n_words": pa.array(n),
                "hits": pa.array(hits, pa.list_(pa.int64())),
                "items": pa.array([[i for i, _ in p] for p in pairs], pa.list_(pa.string())),
                "starts": pa.array([[s for _, s in p] for p in pairs], pa.list_(pa.int64())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, docs, lists = None, None, {}
        for batch in batches:
            for s, term, postings in zip(*(batch.column(c).to_pylist() for c in ("segment", "term", "postings"))):
                if s != segment:
                    if docs is not None:
                        yield answer(segment, docs, lists)
                    segment, docs, lists = s, None, {}
                if term:
                    lists[term] = np.cumsum(varint.decode(postings).astype(np.int64))
                else:
                    docs = np.frombuffer(postings, "<i8")
        if docs is not None:
            yield answer(segment, docs, lists)

    # At most BLOCK_WORDS short rows: the size of what is broadcast is bounded.
    wanted_rows = index.join(F.broadcast(terms), "term").select("segment", "term", "postings")
    dealt = wanted_rows.repartition(shuffle_partitions(spark), "segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "segment long, ord long, doc_id long, n_words long, hits array<long>, items array<string>, starts array<long>")


def _matches(index: DataFrame, items: DataFrame, window: int | None, within: int | None, block_words: int) -> DataFrame:
    parts = [_query(index, block, window, within) for block in _blocks(items, block_words)] or [_query(index, [], window, within)]
    if len(parts) == 1:
        return parts[0].withColumns({c: F.array(c) for c in ("hits", "items", "starts")})
    both = save(parts[0], "matches")
    for part in parts[1:]:
        both = both.union(save(part, "matches"))
    return both.groupBy("segment", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.collect_list(c).alias(c) for c in ("hits", "items", "starts")))


def phrase_matches(index: DataFrame, items: DataFrame, window: int | None = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start): where a window of an item (or the whole item) occurs word for word."""
    return _listed(_matches(index, items, window, None, block_words))


def proximity_matches(index: DataFrame, items: DataFrame, within: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start): where a span of `within` words holds all words of an item."""
    return _listed(_matches(index, items, None, within, block_words))


def _listed(found: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.flatten("items").alias("item_id"), F.flatten("starts").alias("start"))
    return found.select("doc_id", F.explode(pairs).alias("m")).select("doc_id", F.col("m.item_id").alias("item_id"), F.col("m.start").alias("start"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, segment_words: int = SEGMENT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of each document."""
    found = _matches(build_index(docs, segment_words), items, window, None, block_words)
    flat = F.flatten("hits")
    ends = F.transform(F.sequence(F.lit(1), F.size(flat), F.lit(2)), lambda i: F.struct(F.element_at(flat, i).alias("a"), F.element_at(flat, i + 1).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    # Stretches of one block are disjoint, those of several may overlap.
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))
    n_hit = F.when(F.size(flat) > 0, F.aggregate(F.array_sort(ends), start, step, lambda acc: acc["n"])).otherwise(F.lit(0).cast("long"))
    listed = F.array_sort(F.array_distinct(F.array_compact(F.flatten("items"))))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), listed.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
