"""Token-ID / binary output: interleaved range-ANS blocks under shared static frequency tables.

Flow: texts are dealt in doc_id ranges, encoded to token ids once and written as packed ids
(`tokenize`); one aggregate over that table gives the frequency table and each shard's length;
`write_blocks` entropy-codes whole documents into independent blocks and writes them;
`read_blocks` decodes blocks in parallel and checks them.

File format, version 1. A token file is a Parquet dataset with one block a row:
    shard int, block_start long (ids before the block, over all shards), n_tokens long,
    n_docs int, block binary.
and a one-row dataset beside it with the shared table: scale_bits int, symbols binary
(little-endian uint32), freqs binary (little-endian uint32, their sum is 2**scale_bits).
A block, all integers little-endian:
    magic b"TMRA" | version u16 | lanes u16 | scale_bits u8 | 3 zero bytes |
    n_tokens u64 | n_docs u32 | n_checkpoints u32 | n_words u64 | checkpoint_every u32 |
    crc32 of all that follows u32 |
    doc_id i64[n_docs] | doc_null u8[n_docs] | doc_len u64[n_docs] |
    checkpoints: (step u64, word position u64, state u64[lanes])[n_checkpoints] |
    words u32[n_words]
Token t of the block belongs to lane t % lanes and step t // lanes. Each lane is a 64-bit rANS
state that renormalises by 32-bit words; lanes share one word stream in lane order. The first
checkpoint is the block's start; every checkpoint is an entry point for decoding.

Defined results: a null text counts as empty (its document still has the end id); null doc_ids
come first; rows that repeat a doc_id follow one another, ordered by a hash of the text; an
empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, save, shuffle_partitions

LANES = 4096
SCALE_BITS = 20
BLOCK_TOKENS = 1 << 20
CHECKPOINT_STEPS = 128
WORD_CACHE = 600_000
PIECE_BYTES = 1 << 25
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHB3xQIIQII")


# ---------------------------------------------------------------- entropy coder


def scale_counts(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Integer frequencies of at least 1 that add up to 2**scale_bits."""
    total = 1 << scale_bits
    if len(counts) > total // 2:
        raise ValueError("too many symbols for this scale")
    share = counts / counts.sum() * (total - len(counts))
    freqs = np.floor(share).astype(np.int64) + 1
    rest = total - int(freqs.sum())
    freqs[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
    return freqs


class Table:
    """A shared frequency table: symbols in ascending order with their frequencies."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, scale_bits: int):
        self.symbols = symbols.astype(np.uint32)
        self.freqs = freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
        self.scale_bits = scale_bits
        self._slots = self._places = None

    @property
    def places(self) -> np.ndarray:
        if self._places is None:
            self._places = np.zeros(int(self.symbols.max(initial=0)) + 1, np.int32)
            self._places[self.symbols] = np.arange(len(self.symbols))
        return self._places

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freqs.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table, lanes: int, every: int) -> tuple[np.ndarray, list]:
    """The words of a block and its checkpoints (step, word position, lane states)."""
    at = table.places[ids]
    freq, start = table.freqs[at], table.starts[at]
    bits = np.uint64(table.scale_bits)
    top = np.uint64(63 - table.scale_bits)
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    chunks, written, marks = [], 0, []
    for step in range(steps - 1, -1, -1):
        lo = step * lanes
        f, c = freq[lo : lo + lanes], start[lo : lo + lanes]
        x = state[: len(f)]
        full = x >= (f << top)
        words = x[full].astype(np.uint32)
        chunks.append(words)
        written += len(words)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
        if step % every == 0:
            marks.append((step, written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    return words, [(step, written - done, s) for step, done, s in marks[::-1]]


def decode_steps(words: np.ndarray, n: int, table: Table, lanes: int, mark: tuple, until: int) -> np.ndarray:
    """The ids from a checkpoint's step up to step `until` (not included)."""
    step, at, state = mark[0], mark[1], mark[2].copy()
    bits, low = np.uint64(table.scale_bits), np.uint64((1 << table.scale_bits) - 1)
    out = np.empty(min(until * lanes, n) - step * lanes, np.uint32)
    done = 0
    while step < until and done < len(out):
        width = min(lanes, len(out) - done)
        x = state[:width]
        slot = x & low
        s = table.slots[slot.astype(np.int64)]
        out[done : done + width] = table.symbols[s]
        x = table.freqs[s] * (x >> bits) + slot - table.starts[s]
        need = np.flatnonzero(x < _LOW)
        x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)].astype(np.uint64)
        at += len(need)
        state[:width] = x
        done += width
        step += 1
    return out


def pack_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, table: Table, lanes=LANES, every=CHECKPOINT_STEPS) -> bytes:
    words, marks = encode_block(ids, table, lanes, every)
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            lengths.astype("<u8").tobytes(),
            *(struct.pack("<QQ", step, at) + state.astype("<u8").tobytes() for step, at, state in marks),
            words.astype("<u4").tobytes(),
        ]
    )
    return _HEAD.pack(b"TMRA", 1, lanes, table.scale_bits, len(ids), len(doc_ids), len(marks), len(words), every, zlib.crc32(body)) + body


def unpack_block(block: bytes) -> dict:
    """The parts of a block; a wrong checksum raises."""
    magic, version, lanes, bits, n, n_docs, n_marks, n_words, every, crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != b"TMRA" or version != 1 or zlib.crc32(body) != crc:
        raise ValueError("damaged token block")
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    marks = []
    for _ in range(n_marks):
        step, pos = (int(v) for v in take("<u8", 2))
        marks.append((step, pos, take("<u8", lanes).astype(np.uint64)))
    return {"lanes": lanes, "bits": bits, "n": n, "every": every, "doc_ids": [None if z else int(d) for d, z in zip(doc_ids, null)], "lengths": lengths.astype(np.int64), "marks": marks, "words": take("<u4", n_words)}


def decode_block(block: bytes, table: Table) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block; each checkpoint's stretch is decoded on its own."""
    b = unpack_block(block)
    ends = [m[0] for m in b["marks"][1:]] + [-(-b["n"] // b["lanes"])]
    parts = [decode_steps(b["words"], b["n"], table, b["lanes"], m, end) for m, end in zip(b["marks"], ends)]
    return b["doc_ids"], b["lengths"], np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# ---------------------------------------------------------------- Spark jobs


class _Recent(dict):
    """A bounded map in two generations that computes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= WORD_CACHE:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


#: The splitting rule of a tokenizer whose words can be encoded one by one.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_words_alone(description: dict) -> bool:
    """Whether, by a tokenizer's own description, a text's ids are those of its words one after the other.

    It must lower and compose letters and merge white space, drop white space between pre-tokens, split
    them by WORD_RULE, and have no added tokens that reach into their surroundings.
    """
    normal, before, model = (description.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    parts = before.get("pretokenizers", [{}])
    byte_level = {k: parts[-1].get(k) for k in ("type", "add_prefix_space", "use_regex")}
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and parts[:-1] == [{"type": "Split", "pattern": {"Regex": WORD_RULE}, "behavior": "Removed", "invert": True}]
        and byte_level == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].split() == [t["content"]] for t in description.get("added_tokens", []))
    )


class _WordIds:
    """Packed ids of texts, word by word where the tokenizer's description allows it, else as a whole.

    A word of Latin letters, after which only ASCII marks other than the apostrophe may come, is then
    one pre-token and those marks another; its lower-case letters go to the merges alone, since the
    normaliser and the splitting rule change nothing in them. Texts are cut, and their ids joined, by
    Arrow; Python sees each distinct part of a piece of texts once.
    """

    def __init__(self, tokenizer_file: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.model, self.alone = self.whole.model, encodes_words_alone(json.loads(self.whole.to_str()))
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.chars = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.cores, self.others = _Recent(self._core), _Recent(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, letters: str) -> bytes:
        raw = letters if letters.isascii() else letters.translate(self.chars)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """The packed ids of each text; null counts as empty."""
        texts, nothing = texts.cast(pa.large_string()).fill_null(""), pa.scalar(b"", pa.large_binary())
        if not self.alone:
            return pa.array([self._whole(t.as_py()) for t in texts], pa.large_binary())
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        word = coded.dictionary
        core = pc.ascii_rtrim(word, MARKS)
        plain = pc.match_substring_regex(core, CORE)
        core = pc.if_else(plain, pc.utf8_lower(core), "")
        rest = pc.if_else(plain, pc.utf8_ltrim(word, LETTERS), word)
        ids = pc.binary_join_element_wise(_each_once(self.cores, core), _each_once(self.others, rest), nothing)
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids.take(coded.indices)), nothing)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


def _each_once(known: _Recent, parts: pa.Array) -> pa.Array:
    """What the map holds for each part; each distinct part is looked up once."""
    coded = parts.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return pa.array([known[p] for p in distinct], pa.large_binary()).take(coded.indices)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE_BYTES of text, whole texts each."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


#: ASCII marks without the apostrophe (which starts pre-tokens of its own), Latin letters, and words of those alone.
MARKS = string.punctuation.replace("'", "")
LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
CORE = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
_CACHES: dict[str, _WordIds] = {}


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(shard int, first long, doc_id, n long, ids binary): packed ids in ascending doc_id order.

    first is the number of ids before the document within its shard.

    Where a text's ids are those of its words (between ASCII white space) one after the other, a worker
    looks a word up once for a piece of about PIECE_BYTES and encodes it once for as long as its map holds
    it; other tokenizers get whole texts.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _CACHES.get(tokenizer_file) or _CACHES.setdefault(tokenizer_file, _WordIds(tokenizer_file))
        shard, first = TaskContext.get().partitionId(), 0
        end, nothing = (pa.scalar(b, pa.large_binary()) for b in (np.array([end_id], "<u4").tobytes(), b""))
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            packed = pc.binary_join_element_wise(cache.encode_all(batch.column("text")), end, nothing).cast(pa.binary())
            n = pc.binary_length(packed).to_numpy().astype(np.int64) // 4
            ends = first + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), pa.array(ends - n), batch.column("doc_id"), pa.array(n), packed],
                names=["shard", "first", "doc_id", "n", "ids"],
            )
            first = int(ends[-1])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = dealt.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return dealt.mapInArrow(run, "shard int, first long, doc_id long, n long, ids binary")


def _id_counts(tokens: DataFrame) -> DataFrame:
    """(shard, id, count) with id null for a shard's number of ids; one row per id and task at most."""

    def run(batches):
        shards: dict[int, np.ndarray] = {}
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            ids = batch.column("ids").to_pylist()
            for s in np.unique(shard):
                got = np.bincount(np.frombuffer(b"".join(ids[i] for i in np.flatnonzero(shard == s)), "<u4"))
                old = shards.get(int(s), np.zeros(0, np.int64))
                if len(old) < len(got):
                    old, got = got, old
                old[: len(got)] += got
                shards[int(s)] = old
        total: dict = {}
        for s, c in shards.items():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "id": pa.array([None], pa.int64()), "count": pa.array([int(c.sum())], pa.int64())})
            at = np.flatnonzero(c)
            for i, k in zip(at.tolist(), c[at].tolist()):
                total[i] = total.get(i, 0) + k
        yield pa.RecordBatch.from_pydict({"shard": pa.array([-1] * len(total), pa.int32()), "id": pa.array(list(total), pa.int64()), "count": pa.array(list(total.values()), pa.int64())})

    return tokens.select("shard", "ids").mapInArrow(run, "shard int, id long, count long").groupBy("shard", "id").agg(F.sum("count").alias("count"))


def write_blocks(tokens: DataFrame, name: str = "tokens", lanes: int = LANES, block_tokens: int = BLOCK_TOKENS, every: int = CHECKPOINT_STEPS, scale_bits: int = SCALE_BITS) -> tuple[DataFrame, DataFrame]:
    """Write the token file; returns its two datasets (blocks, table) as read back.

    The driver gets one row per distinct id (at most the vocabulary) and one per shard.
    """
    spark = tokens.sparkSession
    rows = _id_counts(tokens).collect()
    counts = sorted((r["id"], r["count"]) for r in rows if r["id"] is not None)
    symbols = np.array([i for i, _ in counts], np.uint32)
    freqs = scale_counts(np.array([c for _, c in counts], np.float64), scale_bits) if counts else np.zeros(0, np.int64)
    bases, before = {}, 0
    for shard, n in sorted((r["shard"], r["count"]) for r in rows if r["id"] is None):
        bases[shard] = before
        before += n

    def run(batches):
        shared, held, size = Table(symbols, freqs, scale_bits), [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([h[3] for h in held])
            block = pack_block([h[2] for h in held], lengths, np.frombuffer(b"".join(h[4] for h in held), "<u4"), shared, lanes, every)
            shard, first = held[0][:2]
            held.clear()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block_start": pa.array([bases[shard] + first]), "n_tokens": pa.array([int(lengths.sum())]), "n_docs": pa.array([len(lengths)], pa.int32()), "block": pa.array([block], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "doc_id", "n", "ids"))):
                if held and (size >= block_tokens or held[-1][0] != row[0] or held[-1][1] + held[-1][3] != row[1]):
                    yield flush()
                    size = 0
                held.append(row)
                size += row[3]
        if held:
            yield flush()

    blocks = tokens.select("shard", "first", "doc_id", "n", "ids").mapInArrow(run, "shard int, block_start long, n_tokens long, n_docs int, block binary")
    table = spark.createDataFrame([(scale_bits, bytearray(symbols.astype("<u4").tobytes()), bytearray(freqs.astype("<u4").tobytes()))], "scale_bits int, symbols binary, freqs binary")
    return save(blocks, f"{name}-blocks", compression="none"), save(table.coalesce(1), f"{name}-table")


def read_blocks(blocks: DataFrame, table: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<long>]) decoded from a token file."""
    row = table.first()
    symbols, freqs, bits = bytes(row["symbols"]), bytes(row["freqs"]), row["scale_bits"]

    def run(batches):
        shared = Table(np.frombuffer(symbols, "<u4"), np.frombuffer(freqs, "<u4").astype(np.int64), bits)
        for batch in batches:
            for start, block in zip(batch.column("block_start").to_pylist(), batch.column("block").to_pylist()):
                doc_ids, lengths, ids = decode_block(block, shared)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64())}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return blocks.select("block_start", "block").mapInArrow(run, schema)


def token_file(docs: DataFrame, tokenizer_file: str, end_id: int, **options) -> tuple[DataFrame, DataFrame]:
    """Encode documents (doc_id, text) and write them as a token file: (blocks, table)."""
    tokens = save(tokenize(docs, tokenizer_file, end_id), "token-ids", compression="zstd")
    written = write_blocks(tokens, **options)
    discard(tokens)
    return written
