"""MinHash near-duplicate detection with b-bit signatures.

Flow:
1. `sign`: a document's distinct 5-word shingles (64-bit hashes), its minima under 130
   permutations, 26 band keys of 5 whole minima each, and the low 4 bits of every minimum
   packed 16 to a word. Documents whose word sequences are equal form one class, represented by
   the smallest doc_id, so copies are never compared with each other.
2. Bands give candidates: pairs of a bucket whose set sizes allow the threshold and whose packed
   bits give a collision-corrected similarity that may reach it. A bucket returns a spanning forest
   of them, so what passes on grows with the documents, not with the pairs, and documents that
   share a bucket by chance are not joined. Components of these edges are the candidate groups.
3. Pairs of a group that pass the same screen are confirmed on the full shingle sets; a group too
   returns a spanning forest: no link between different texts is lost to the components.
4. Connected components of the confirmed links; component_id is the smallest doc_id.

A bucket or group of any size is cut in blocks of bounded size (`_forest`): first each block is
linked on its own, with a few of the group's members (hubs, the first in a fixed order of all
documents) that all blocks get. Pairs whose ends are linked then need no look. Only members outside
the largest part so found (none or few where a group is all near copies) are sent to every block, in
blocks again, so every other pair is met. A part is returned as edges from its first member in that
order to the others, so blocks, and buckets of one cluster, mostly return the same edges. Of the edges
that reach one member from several first members one is kept, and the others go between those
(`_thinned`): edges stay about as many as members, however many buckets they share.

The chance that a pair with similarity 0.85 shares no band is (1 - 0.85**5)**26 < 3e-7, and that
the screen (five standard deviations below the threshold) drops it is about the same.

Classes go by the key of their first row: its doc_id and the hash of its text (KEY), so many texts under
one doc_id are as many members, each met once, and are joined by their doc_id alone at the end.

Defined results: a text that is null or has no words has no shingles, is its own component and is
kept; fewer than five words are one shingle; rows that repeat a doc_id share one component; a row
without doc_id takes part in nothing, has no component and is kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Run, discard, save, shuffle_partitions
from tidemark.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 26, 5
PERMS = BANDS * ROWS
BITS = 4
PER_WORD = 64 // BITS
WORDS = -(-PERMS // PER_WORD)
BLOCK_ROWS, BLOCK_SHINGLES = 200, 500_000
KEY = ["doc_id", "text_key"]
HUBS = 8
WORD_CACHE = 200_000

_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SLOTS = (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(BITS))[None, :]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class _WordHash(dict):
    """64-bit hashes of words, kept up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def word_hashes(text: bytes | None, known: _WordHash) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; all words as one if there are fewer."""
    if len(h) == 0:
        return h
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = _mix(s + h[k : k + n] * _STEP[k])
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _MUL + _ADD).min(axis=0))
    return _mix(low)


def pack_bits(low: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, 16 to a 64-bit word."""
    b = np.zeros(WORDS * PER_WORD, np.uint64)
    b[:PERMS] = low & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(b.reshape(WORDS, PER_WORD) << _SLOTS, axis=1)


def mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the packed b-bit values differ, by bit counts along the last axis."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def estimate(miss: np.ndarray) -> np.ndarray:
    """Similarity from mismatches, corrected for values that agree by chance."""
    chance = 1.0 / (1 << BITS)
    return ((1 - miss / PERMS) - chance) / (1 - chance)


def most_mismatches(percent: int) -> int:
    """Mismatches beyond which a pair cannot reach the threshold, by five standard deviations."""
    chance = 1.0 / (1 << BITS)
    p = 1 - (percent / 100 * (1 - chance) + chance)
    return int(np.floor(PERMS * p + 5 * np.sqrt(PERMS * p * (1 - p))))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text)"""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, bands, bits); digest, bands and bits are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _WordHash()
        for batch in batches:
            n, digest, bands, bits = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                h = word_hashes(text.as_py(), known)
                s = shingle_set(h)
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    for k in range(ROWS):
                        keys = _mix(keys + low[k::ROWS] * _STEP[k])
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    bands.append(keys.view(np.int64))
                    bits.append(pack_bits(low).tobytes())
                else:
                    digest.append(None), bands.append(None), bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=[*KEY, "n_shingles", "digest", "bands", "bits"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, bits binary")


def link_unit(ids: list[int], place: np.ndarray, outside: np.ndarray, size: np.ndarray, bits: np.ndarray, labels: np.ndarray, percent: int, sets: list[np.ndarray] | None) -> list[tuple[int, int, int]]:
    """Edges of the parts that links make within one unit, beyond what equal labels join already.

    Pairs are links if they pass the screen and, if sets are given, the check on the full sets.
    With members from outside only their pairs with the others are looked at. A part's edges run
    from the first of its labels' first members (by `place`) to those of the other labels: (a, b, a's place).
    """
    order = np.lexsort((ids, size))
    size, bits, outside = size[order], bits[order], outside[order]
    _, own = np.unique(labels[order], return_inverse=True)
    root, two, most = own.copy(), bool(outside.any()), most_mismatches(percent)
    for i in range(len(order) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        if end <= i + 1:
            continue
        miss = mismatches(bits[i + 1 : end], bits[i])
        near = (miss <= most) & (root[i + 1 : end] != root[i])
        if two:
            near &= outside[i + 1 : end] != outside[i]
        near = np.flatnonzero(near)
        for j in near[np.argsort(miss[near], kind="stable")] + i + 1:
            if root[i] == root[j]:
                continue
            if sets is not None:
                a, b = sets[order[i]], sets[order[j]]
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
            root[root == root[j]] = root[i]
    links, first = [], {}
    for i in np.lexsort((np.array(ids)[order], place[order])):
        if own[i] not in first:
            first[own[i]] = i
            start = first.setdefault(("part", root[i]), i)
            if start != i:
                links.append((ids[order[start]], ids[order[i]], int(place[order[start]])))
    return links


def _units(units: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b, place) of each unit: rows (keys, doc_id, place, outside, label, n_shingles, bits[, text]) with equal keys."""
    whole = "text" in units.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, links, known, seen = None, [], [], _WordHash(), set()

        def close() -> None:
            if len(held) > 1:
                ids, place, outside, labels, size, bits, sets = zip(*held)
                links.extend(link_unit(list(ids), np.array(place), np.array(outside), np.array(size), np.stack(bits), np.array(labels), percent, list(sets) if whole else None))
            held.clear(), seen.clear()

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate(("a", "b", "place"))})

        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            texts = batch.column("text").cast(pa.binary()) if whole else None
            for i, (k, *row, n, bits) in enumerate(zip(key, *(batch.column(c).to_pylist() for c in ("doc_id", "place", "outside", "label", "n_shingles", "bits")))):
                if k != now:
                    close()
                    now = k
                if tuple(row[:2]) in seen:  # a row that repeats both doc_id and text is no other member
                    continue
                seen.add(tuple(row[:2]))
                own = shingle_set(word_hashes(texts[i].as_py(), known)) if whole else None
                held.append((*row, len(own) if whole else n, np.frombuffer(bits, np.uint64), own))
            yield found()
            links.clear()
        close()
        yield found()

    dealt = units.repartition(shuffle_partitions(units.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long, place long")


def _thinned(links: DataFrame) -> DataFrame:
    """(a, b): links (a, b, place) with the same components, but one edge a member.

    A member b is linked with the first member of each of its buckets or blocks. The first of these keeps
    it, and the others are linked with that one instead: edges among first members, which all of a
    cluster's members share. A member has as many links as buckets and blocks that hold it.
    """
    distinct = links.groupBy("a", "b").agg(F.min("place").alias("place"))
    first = distinct.withColumn("first", F.min(F.struct("place", "a")).over(W.partitionBy("b"))["a"])
    return first.select(F.col("first").alias("a"), F.when(F.col("a") == F.col("first"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def _forest(members: DataFrame, payload: list[DataFrame], percent: int, cost: str | None = None) -> DataFrame:
    """(a, b): a spanning forest of the links within every group of members (grp, doc_id, text_key[, cost]).

    payload: tables that give (doc_id, text_key, n_shingles, bits[, text]); a member's text may be there
    several times.
    """
    share = F.greatest(F.count("*") / BLOCK_ROWS, F.sum(cost or F.lit(0)) / BLOCK_SHINGLES)
    sizes = members.groupBy("grp").agg(F.count("*").alias("k"), F.ceil(share).cast("int").alias("blocks")).where("k > 1")
    place = F.xxhash64(*KEY, F.lit(3))
    first_few = place.cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * HUBS / F.col("k")  # about HUBS of the group's k members
    placed = members.select("grp", *KEY).join(sizes, "grp").withColumns({"block": F.pmod(F.xxhash64(*KEY), F.col("blocks")).cast("int"), "place": place, "hub": (F.col("blocks") > 1) & first_few})
    for part in payload:
        placed = placed.join(part, KEY)
    placed = save(placed.drop("k"), "members")
    kept = ["place", "n_shingles", "bits", *(["text"] if "text" in placed.columns else [])]
    own = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.select("grp", F.explode(own).alias("block"), "doc_id", F.lit(False).alias("outside"), F.col("doc_id").alias("label"), *kept)
    links = save(_thinned(_units(first, ["grp", "block"], percent)), "links")
    cut = placed.where("blocks > 1")
    if cut.isEmpty():
        discard(placed)
        return links
    labels = connected_components(links).withColumnRenamed("node", "doc_id")
    tagged = cut.select("grp", "doc_id").join(labels, "doc_id", "left").select("grp", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    tagged = save(tagged.distinct(), "labelled")
    parts = tagged.groupBy("grp", "label").agg(F.count("*").alias("n"))
    rest = parts.groupBy("grp").agg(F.max_by("label", "n").alias("most"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    rest = rest.select("grp", "most", F.ceil(F.col("others") / BLOCK_ROWS).cast("int").alias("lots"))
    left = cut.join(tagged, ["grp", "doc_id"]).join(rest, "grp").withColumn("other", F.col("label") != F.col("most"))
    lot = F.pmod(F.xxhash64(*KEY, F.lit(5)), F.col("lots")).cast("int")
    inner = left.select("grp", "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "doc_id", F.lit(False).alias("outside"), "label", *kept)
    outer = left.where("other").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), lot.alias("lot"), "doc_id", F.lit(True).alias("outside"), "label", *kept)
    more = save(_thinned(_units(inner.union(outer), ["grp", "block", "lot"], percent)), "links")
    discard(placed, tagged)
    return links.union(more)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text).

    Documents are linked where 100 * shingles in both >= percent * shingles in either.
    """
    with Run(docs.sparkSession) as run:
        signed = save(sign(docs), "signatures")
        worded = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
        classes = signed.where(worded).groupBy("digest").agg(F.min_by(F.struct(*KEY, "n_shingles", "bands", "bits"), F.struct(*KEY)).alias("r")).select("digest", "r.*")
        classes = save(classes, "classes")
        sized = classes.select(*KEY, "n_shingles", "bits")
        near = _forest(classes.select(F.explode("bands").alias("grp"), *KEY), [sized], percent)
        groups = connected_components(near).select(F.col("node").alias("doc_id"), F.col("label").alias("grp"))
        members = save(groups.join(sized.select(*KEY, "n_shingles"), "doc_id"), "groups")
        links = _forest(members, [sized, keyed(docs)], percent, "n_shingles")
        labels = connected_components(links).select(F.col("node").alias("rep"), "label")
        named = classes.select("digest", F.col("doc_id").alias("rep")).join(labels, "rep", "left")
        named = save(named.select("digest", F.coalesce("label", "rep").alias("component_id")), "named")
        run.drop(signed, named)
    out = signed.where(worded).select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    alone = signed.where(~worded).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
