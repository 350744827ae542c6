"""The ten operators on small tables: brute force, round trips, and the defined edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, html_extract, interpolated_lm, mixing, near_dedup, quality, queries, token_binary, toxicity, url_filter, va_search, varint
from tidemark.llm.common import drop_saved, save, table
from tidemark.llm.components import connected_components

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all".split()


def docs_of(spark, rows):
    """(doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, kept string")


def random_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 40)) for _ in range(n))


def edge_rows():
    rng = np.random.default_rng(0)
    long = random_text(rng, 6000)
    return [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two three"), (6, long), (7, long), (7, long), (None, "a b c d e f"), (8, "Ünïcödé  wörds\tand\nlines"), (9, "<|endoftext|> Don't stop, 3.14%!!")]


# ---------------------------------------------------------------- small parts


def test_varint_round_trip():
    v = np.array([0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1], np.uint64)
    data, size = varint.encode(v)
    assert (varint.decode(data.tobytes()) == v).all() and size.sum() == len(data)
    assert len(varint.decode(b"")) == 0


def test_saved_tables_can_be_dropped(spark):
    kept = save(spark.range(5), "kept")
    assert kept.count() == 5 and drop_saved(spark) >= 1
    with pytest.raises(Exception):
        kept.count()


def test_a_run_deletes_its_own_tables_alone(spark):
    from threading import Event, Thread

    from tidemark.llm.common import Run

    theirs, go, seen = {}, Event(), {}

    def other():
        with Run(spark) as run:
            theirs["a"] = save(spark.range(3), "other")
            seen["saved"].set()
            go.wait(60)
            theirs["n"] = theirs["a"].count()
            theirs["gone"] = run.drop()

    seen["saved"] = Event()
    thread = Thread(target=other)
    thread.start()
    assert seen["saved"].wait(60)
    with Run(spark) as outer:
        with Run(spark) as inner:
            first, second = save(spark.range(2), "first"), save(spark.range(4), "second")
            assert inner.drop(second) == 1
        assert second.count() == 4
        with pytest.raises(Exception):
            first.count()
        assert outer.drop() == 1
    go.set()
    thread.join()
    assert theirs["n"] == 3 and theirs["gone"] == 1


def test_many_texts_under_one_doc_id_make_rows_in_proportion(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [random_text(rng, 60) for _ in range(3)]
    rows = [(7, f"{base[k % 3]} tail{k} end{k}") for k in range(900)] + [(8, f"{base[0]} tail9999 end1"), (9, random_text(rng, 60))]
    rows += [(7, rows[0][1])] * 50
    made, save_ = {}, near_dedup.save
    monkeypatch.setattr(near_dedup, "save", lambda df, name: made.setdefault(f"{name}{len(made)}", save_(df, name)))
    counts = {}
    monkeypatch.setattr(near_dedup, "discard", lambda *dfs: None)
    monkeypatch.setattr(near_dedup.Run, "drop", lambda self, *keep: 0)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(spark, rows), 85).collect()}
    assert got == {(7, 7), (8, 7), (9, 9)}
    for name, df in made.items():
        counts[name] = df.count()
    assert sum(n for name, n in counts.items() if name.startswith("members")) <= 30 * 902


def test_components_by_union(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 11), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 10}


# ---------------------------------------------------------------- 1 URL filter


def test_url_filter_intervals_and_keys(spark):
    log = [("a", "domain", "Bad.org", "add", "2024-01-02"), ("a", "domain", "bad.org", "add", "2024-01-03"), ("a", "domain", "bad.org", "remove", "2024-01-05"), ("b", "host", "x.net", "add", "2024-01-01"), ("b", "host", "x.net", "remove", "2024-01-01"), ("c", "prefix", "y.net/p/q", "add", "2024-01-01"), (None, "host", "z", "add", "2024-01-01"), ("d", "host", "z.net", "drop", "2024-01-01")]
    entries = spark.createDataFrame(log, "list_id string, kind string, value string, action string, at string")
    assert url_filter.intervals(entries).count() == 2
    rows = [("http://www.BAD.org/a", "2024-01-02"), ("http://bad.org:80/", "2024-01-01"), ("http://notbad.org/", "2024-01-03"), ("https://u@bad.org./?q", "2024-01-04"), ("https://bad.org", "2024-01-05"), ("http://x.net/", "2024-02-01"), ("http://y.net/p/q/r?x#y", "2024-02-01"), ("http://y.net/p/qq", "2024-02-01"), (None, "2024-01-03"), ("http://bad.org/", None), ("no url", "2024-01-03"), ("http://www.BAD.org/a", "2024-01-02")]
    seen = spark.createDataFrame([(i, u, t, "clash") for i, (u, t) in enumerate(rows)], "i int, url string, fetched_at string, lists string")
    got = {r["i"]: (r["blocked"], r["n_entries"], r["lists"]) for r in url_filter.filter_captures(seen, entries).collect()}
    assert {i for i, v in got.items() if v[0]} == {0, 3, 6, 11} and len(got) == len(rows)
    assert got[0] == (True, 1, ["a"]) and got[6][2] == ["c"] and got[1] == (False, 0, [])
    assert url_filter.filter_captures(seen.limit(0), entries).count() == 0
    assert url_filter.filter_captures(seen, entries.limit(0)).where("blocked").count() == 0


def test_url_filter_long_urls_clashing_names_and_repeats(spark):
    log = [("a", "domain", "bad.org", "add", "2024-01-02"), ("b", "prefix", "y.net/p/q", "add", "2024-01-01"), ("b", "prefix", "y.net/p/q", "add", "2024-01-01"), ("c", "host", "x.y.bad.org", "add", "2024-01-01")]
    entries = spark.createDataFrame(log, "list_id string, kind string, value string, action string, at string")
    deep, wide = "http://y.net/p/q" + "/s" * 20000, "http://" + "w." * 20000 + "bad.org/"
    rows = [(deep, 1), (wide, 2), ("http://x.y.bad.org", 3), ("http://x.y.bad.org", 3), (None, 4)]
    seen = spark.createDataFrame([(i, u, "2024-03-01", i, i, i) for u, i in rows], "i int, url string, fetched_at string, __u int, __f int, salt int")
    out = url_filter.filter_captures(seen, entries)
    got = sorted((r["i"], r["n_entries"], r["lists"], r["__u"], r["__f"], r["salt"]) for r in out.collect())
    assert got == [(1, 1, ["b"], 1, 1, 1), (2, 1, ["a"], 2, 2, 2), *[(3, 2, ["a", "c"], 3, 3, 3)] * 2, (4, 0, [], 4, 4, 4)]
    assert not any("Python" in line or "Arrow" in line for line in out._jdf.queryExecution().toString().splitlines())


# ---------------------------------------------------------------- 2 toxicity


def test_nnpu_learns_from_positives_and_unlabelled(spark, sf_dir):
    rng = np.random.default_rng(1)
    good = [(i, random_text(rng, 60)) for i in range(300)]
    bad = [(1000 + i, random_text(rng, 60) + " vilestuff " + rng.choice(["nastya", "nastyb", "nastyc"])) for i in range(150)]
    docs = docs_of(spark, good + bad + [(None, None), (5000, ""), (5001, None)])
    labels = spark.createDataFrame([(i, 0) for i, _ in good[:150]] + [(i, 1) for i, _ in bad[:90]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    right = [got[i]["predicted"] == (1 if i >= 1000 else 0) for i, _ in good + bad if got[i]["held_out"]]
    assert np.mean(right) > 0.97
    assert got[5000]["predicted"] == 0 and got[5001]["score"] == got[5000]["score"] and got[None]["held_out"] is False
    assert got[7]["held_out"] == (zlib.crc32(b"7") % 4 == 2)
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == 453 and {r["predicted"] for r in none} == {0}


def test_nnpu_risk_stays_non_negative_in_training():
    pos = toxicity.Sparse([np.array([0], np.uint32)] * 20, 2)
    unl = toxicity.Sparse([np.array([1], np.uint32)] * 80 + [np.array([0], np.uint32)] * 20, 2)
    w = toxicity.fit_nnpu(pos, unl, 0.2, (np.ones(20), np.ones(100)))
    assert w[0] > 1 > 0 > w[1] and np.isfinite(w).all()


def test_nnpu_risk_is_the_stated_one():
    """The gradient of the first step is that of the risk, taken by differences."""
    pos, unl = toxicity.Sparse([np.array([0], np.uint32), np.array([0, 1], np.uint32)], 2), toxicity.Sparse([np.array([1], np.uint32), np.array([], np.uint32), np.array([0], np.uint32)], 2)
    x = lambda s: np.array([s.dot(np.eye(2)[k]) for k in range(2)]).T

    def risk(w):
        fp, fu = x(pos) @ w[:2] + w[2], x(unl) @ w[:2] + w[2]
        loss = lambda z: np.logaddexp(0, z).mean()
        return 0.3 * loss(-fp) + max(0.0, loss(fu) - 0.3 * loss(fp))

    start = np.array([0.0, 0.0, np.log(0.3 / 0.7)])
    slope = np.array([(risk(start + d) - risk(start - d)) / 2e-5 for d in 1e-5 * np.eye(3)])
    step = toxicity.fit_nnpu(pos, unl, 0.3, (np.ones(2), np.ones(3)), rounds=1, rate=1.0, decay=0.0) - start
    assert np.allclose(step[:2], -np.sign(slope[:2]), atol=1e-4)  # the first step of its optimiser goes by the sign
    assert risk(toxicity.fit_nnpu(pos, unl, 0.3, (np.ones(2), np.ones(3)), rounds=50)) < risk(start)


@pytest.mark.parametrize(("operator", "column", "least"), [(toxicity, "toxic", 0.95), (quality, "quality", 0.95)])
def test_held_out_accuracy_on_the_tables(spark, operator, column, least):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    scored = operator.score_documents(docs, labels).where("held_out")
    pairs = scored.join(labels.where(f"{column} is not null").select("doc_id", column), "doc_id").select("predicted", column).collect()
    assert len(pairs) > 500 and np.mean([p == t for p, t in pairs]) >= least


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_with_repeated_ids_and_very_long_texts(spark, operator):
    rng = np.random.default_rng(21)
    rows = [(1, "vile " + random_text(rng, 30))] * 400 + [(2, "VILE!! " * 20000), (3, random_text(rng, 20000))] + [(10 + i, random_text(rng, 40) if i % 2 else "VILE!! vile " + random_text(rng, 4)) for i in range(80)]
    docs = docs_of(spark, rows)
    column = "toxic" if operator is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (3, 0)] + [(10 + i, int(i % 2 == 0)) for i in range(80)], f"doc_id long, {column} int")
    chosen = common.one_text_each(docs, common.first_ids(common.training_labels(labels, column), 3))
    assert chosen.count() == 3
    got = operator.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert operator.score_documents(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- 3 token output


def test_rans_round_trip_and_checkpoints():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 5000) % 900).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    t = token_binary.Table(symbols, token_binary.scale_counts(counts.astype(float), 14), 14)
    for n in (0, 1, 63, 64, 5000):
        block = token_binary.pack_block([3, None], np.array([n // 2, n - n // 2]), ids[:n], t, lanes=64, every=8)
        doc_ids, lengths, back = token_binary.decode_block(block, t)
        assert doc_ids == [3, None] and lengths.tolist() == [n // 2, n - n // 2] and (back == ids[:n]).all()
    parts = token_binary.unpack_block(block)
    assert len(parts["marks"]) == math.ceil(math.ceil(5000 / 64) / 8)
    last = token_binary.decode_steps(parts["words"], 5000, t, 64, parts["marks"][-1], 10**6)
    assert (last == ids[parts["marks"][-1][0] * 64 :]).all()
    with pytest.raises(ValueError):
        token_binary.decode_block(block[:-1] + bytes([block[-1] ^ 1]), t)


def test_token_file_equals_direct_encoding(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = edge_rows() + [(100 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").limit(60).collect()]
    blocks, shared = token_binary.token_file(docs_of(spark, rows), queries.tokenizer_path(), 2, block_tokens=3000, lanes=32, every=4)
    got = [tuple(r) for r in token_binary.read_blocks(blocks, shared, keep_ids=True).orderBy("start").collect()]
    tok, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    for (doc_id, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert r == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    empty = token_binary.read_blocks(*token_binary.token_file(docs_of(spark, []), queries.tokenizer_path(), 2))
    assert empty.count() == 0


def test_words_are_encoded_alone_only_where_the_description_allows_it():
    import json
    import random

    from tokenizers import Tokenizer

    rng = random.Random(5)
    pool = ["Don't", "naïve", "ÀÉÎ!", "x's", "3.14", "don'T", "İstanbul", "e\u0301te", "ß", "<|endoftext|>", "a<|endoftext|>b", "--", "'", "''s", "Ünïcödé,", "日本語", "\u00a0", "a\u2003b", "it's.", "K", "ﬁne", "Ω", "word", "Word."]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) + rng.choice(["", " ", "\n\t"]) for _ in range(400)]
    for name, alone in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = queries.tokenizer_path(name)
        ids, tok = token_binary._WordIds(path), Tokenizer.from_file(path)
        assert ids.alone is alone
        for t in texts:
            assert np.frombuffer(ids.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    plain = json.loads(Tokenizer.from_file(queries.tokenizer_path()).to_str())
    assert token_binary.encodes_words_alone(plain)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**plain["model"], "dropout": 0.1}}, {"added_tokens": [{**plain["added_tokens"][0], "lstrip": True}]}):
        assert not token_binary.encodes_words_alone({**plain, **change})


def test_words_of_many_places_cost_python_one_lookup():
    import tracemalloc

    ids = token_binary._WordIds(queries.tokenizer_path())
    words = [f"{a}{b}{m}" for a in ("tide", "Mark", "été", "x") for b in ("", "ing", "À") for m in ("", ",", "!!", "'s")]
    text = " ".join(words * 2000)
    expected = ids._whole(" ".join(words)) * 2000
    ids.encode(" ".join(words))
    tracemalloc.start()
    got = ids.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == expected
    assert peak < 3 * len(expected)  # an object for each of the 96,000 words would take more


def test_pieces_of_a_batch_are_whole_texts_in_order(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [None, "", " \t\n", "  lead and trail \r\n", "×a a× b÷c É÷", "|", "'s Don't it's. ''", "ẞ İ naïve, e\u0301", "w" * 300, "one two " * 40, "\x00 a\x1cb \x85", None, "end"]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    expected = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(token_binary, "PIECE_BYTES", 64)
    pieces = list(token_binary._pieces(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})))
    assert len(pieces) > 3 and [t for p in pieces for t in p.column("text").to_pylist()] == texts
    ids = token_binary._WordIds(queries.tokenizer_path())
    got = [np.frombuffer(b, "<u4").tolist() for p in pieces for b in ids.encode_all(p.column("text")).to_pylist()]
    assert got == expected
    assert list(token_binary._pieces(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []


# ---------------------------------------------------------------- 4 decontamination


def plain_contamination(docs, items, size=10):
    word = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for item_id, t in items:
            iw = cut(t)
            n = min(size, len(iw))
            wanted = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add(item_id)
        names = sorted(str(f) for f in found if f is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    passage = random_text(rng, 30)
    items = [(1, passage), (2, " ".join(passage.split()[5:25])), (10, "short one here"), (11, None), (12, "..."), (None, "null item of some length but no id at all yes"), (13, "a a a a a a a a a a a a")]
    rows = edge_rows() + [(20, "x " + passage.upper() + " y"), (21, random_text(rng, 50) + ", " + " ".join(passage.split()[8:19])), (22, "Short, ONE... here short one"), (23, "null item of some length but no id at all yes"), (24, "a " * 40)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    for options in ({}, {"segment_words": 200, "block_words": 25}):
        got = decontaminate.contamination(docs_of(spark, rows), bench, **options).drop("items")
        assert sorted([tuple(r) for r in got.collect()], key=str) == plain_contamination(rows, items)
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs_of(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_phrases_and_proximity(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "beta x alpha y gamma"), (3, "alpha " + "z " * 20 + "beta gamma"), (4, "gamma beta"), (5, "alpha alpha beta")]
    index = decontaminate.build_index(docs_of(spark, rows))
    items = spark.createDataFrame([(7, "beta gamma"), (8, "alpha alpha")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.phrase_matches(index, items, window=None).collect()) == [(1, "7", 1), (3, "7", 21), (5, "8", 0)]
    near = decontaminate.proximity_matches(index, items, within=5).collect()
    assert {(r["doc_id"], r["item_id"]) for r in near} == {(1, "7"), (2, "7"), (3, "7"), (4, "7"), (5, "8")}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity_matches(index, items, within=2).collect()} == {(1, "7"), (3, "7"), (4, "7"), (5, "8")}


# ---------------------------------------------------------------- 5 HTML


PROSE = "This is a paragraph of the story, with some commas, and enough words to count as text."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  words\n here", "plain words here"),
        (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p>{PROSE}<p>a<b>b</b>c&nbsp;d</article><footer>foot</footer>", f"Head & line {PROSE} abc d"),
        (f"<div class='sidebar'><p>{PROSE}</p></div><div id=main><p>{PROSE}</p><p>Short.</p></div><div id='comments'><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE} Short."),
        (f"<main><script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form><p>no</p></form><p>{PROSE}</p><aside>no</aside></main>", PROSE),
        (f"<article><p>one<br>two</p><ul><li>three<li>four</ul><table><tr><td>five<td>six</table><p>{PROSE}</p></article>", f"one two three four five six {PROSE}"),
        ("<div>" * 5000 + "deep", "deep"),
        ('<a href="x>' * 3000, ""),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>Hi, there</p></article>", "clash"), (1, "u", "<article><p>Hi, there</p></article>", "clash"), (None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "Hi, there", 9), (1, "u", "Hi, there", 9), (None, None, "", 0)]
    long = html_extract.main_text("<article>" + f"<p>{PROSE}</p>" * 4000 + "</article>")
    assert len(long) == 4000 * (len(PROSE) + 1) - 1


# ---------------------------------------------------------------- 6 language model


def test_lm_base_counts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, t) for i, t in edge_rows() if i is not None] + [(100 + i, random_text(rng, 80)) for i in range(120)]
    got = sorted(interpolated_lm.score_documents(docs_of(spark, rows), chunk_tokens=2000, range_tokens=700).collect(), key=str)
    cut = lambda t: (t or "").encode().lower().split() + [b""]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in cut(t))
    n, v = sum(train.values()), len(train)
    want = sorted([(i, zlib.crc32(str(i).encode()) % 5 == 1, len(cut(t)), sum(w in train for w in cut(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(t)), 6)) for i, t in rows], key=str)
    assert sorted([(r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got], key=str) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_score_equals_brute_force(spark):
    rng = np.random.default_rng(14)
    rows = [(i, t) for i, t in edge_rows() if i is not None] + [(100 + i, random_text(rng, 60)) for i in range(90)]
    raw = rng.uniform(0.1, 1, (64, 3))
    mix = raw / raw.sum(axis=1, keepdims=True)
    cut = lambda t: [b"", *(t or "").encode().lower().split(), b""]
    word, pair = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            word.update(cut(t)[1:])
            pair.update(zip(cut(t), cut(t)[1:]))
    n, v = sum(word.values()), len(word)

    def score(t):
        out = 0.0
        for h, w in zip(cut(t), cut(t)[1:]):
            a = mix[word[h].bit_length()]
            out += math.log10(a[0] * pair[h, w] / max(word[h], 1) + a[1] * word[w] / n + a[2] / (v + 1))
        return out

    for options in ({}, {"chunk_tokens": 900, "range_tokens": 500}):
        got = interpolated_lm.score_documents(docs_of(spark, rows), mixture=mix, **options).collect()
        assert sorted([(r["doc_id"], round(r["score"], 6)) for r in got]) == sorted([(i, round(score(t), 6)) for i, t in rows])


def test_lm_without_training_text(spark):
    assert interpolated_lm.score_documents(docs_of(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = interpolated_lm.score_documents(docs_of(spark, [(only, "some words")])).first()
    assert (r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(5)
    pair, word = 2.0 ** -rng.uniform(1, 4, 4000), 2.0 ** -rng.uniform(6, 12, 4000)
    cells = (np.full(4000, 5) * 256 + interpolated_lm._level(pair)) * 256 + interpolated_lm._level(word)
    mix = interpolated_lm.fit_weights(cells, np.ones(4000), 10**6)
    assert mix[5][0] > 0.9 and np.allclose(mix.sum(axis=1), 1) and mix[0][0] == 0


# ---------------------------------------------------------------- 7 near duplicates


def plain_components(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = {i: i for i, _ in rows if i is not None}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and x and 100 * x >= percent * len(sets[a] | sets[b]):
                i, j = find(rows[a][0]), find(rows[b][0])
                low[max(i, j)] = min(i, j)
    return sorted([(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), s in zip(rows, sets)], key=str)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = edge_rows()
    for g in range(12):
        base = random_text(rng, 120).split()
        for k in range(8):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = "edit" + str(rng.integers(0, 10**6))
            rows.append((1000 - 10 * g - k, " ".join(w)))
    for percent in (80, 85):
        got = near_dedup.near_duplicates(docs_of(spark, rows), percent)
        assert sorted([tuple(r) for r in got.collect()], key=str) == plain_components(rows, percent)
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("edits", [2, 9, 30])
def test_blocks_lose_no_link(spark, monkeypatch, edits):
    """One large group: of near copies of one another (2), in parts (9), of scattered texts (30)."""
    rng = np.random.default_rng(7)
    base = random_text(rng, 150).split()
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, edits))):
            w[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    got = near_dedup.near_duplicates(docs_of(spark, rows), 85)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_components(rows, 85)


def test_b_bit_estimate_is_corrected():
    rng = np.random.default_rng(8)
    for j in (0.0, 0.5, 0.9):
        got = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(1000 * j), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(500 * (1 - j)), dtype=np.uint64)])) for _ in range(2))
            got.append(near_dedup.estimate(near_dedup.mismatches(near_dedup.pack_bits(near_dedup.minima(a)), near_dedup.pack_bits(near_dedup.minima(b)))))
        want = int(1000 * j) / (int(1000 * j) + 2 * int(500 * (1 - j)))
        assert abs(np.mean(got) - want) < 0.03


# ---------------------------------------------------------------- 8 quality


def test_quality_ranks_held_out_documents(spark):
    rng = np.random.default_rng(9)
    good = [(i, random_text(rng, 120).capitalize() + ".") for i in range(300)]
    bad = [(1000 + i, (random_text(rng, 6).upper() + "!!\n") * 15) for i in range(90)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (2, None)], "doc_id long, quality int")
    docs = docs_of(spark, good + bad + [(9000, None), (None, "x")])
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert all(got[i]["predicted"] == (1 if i < 1000 else 0) for i, _ in good + bad)
    assert 0 <= got[9000]["score"] <= 1 and len(got) == 392
    ones = quality.score_documents(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in ones} == {1.0}


def test_all_pairs_take_part_in_the_ranking(monkeypatch):
    rng = np.random.default_rng(22)
    good, bad, w = rng.normal(size=(23, 4)) + 0.4, rng.normal(size=(17, 4)), rng.normal(size=4)
    monkeypatch.setattr(quality, "PAIR_ROWS", 5)
    d = np.array([g - b for g in good for b in bad])
    p = 1 / (1 + np.exp(d @ w))
    loss, g, h = quality.pair_sums(good, bad, w)
    assert np.isclose(loss, np.log1p(np.exp(-d @ w)).mean()) and np.allclose(g, -(d * p[:, None]).mean(axis=0))
    assert np.allclose(h, (d * (p * (1 - p))[:, None]).T @ d / len(d))
    best = quality.fit_ranking(good, bad)
    value = lambda w: quality.pair_sums(good, bad, w)[0] + 5e-4 * w @ w
    assert all(value(best) <= value(best + 1e-3 * e) for e in (*np.eye(4), *-np.eye(4)))


# ---------------------------------------------------------------- 9 vectors


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 16)) / 4
    x[50] = x[51] = x[52]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0] * 15 + [None]), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (None, [0.1] * 16), (904, [0.5] * 4), (50, x[7].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    ok = [(i, np.floor(256 * np.array(v + [0.0] * (16 - len(v)))).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = sorted(r for qi, q in ok if qi % 50 == 0 for r in plain_top(q, qi, ok))
    for block, bits in ((64, 4), (4096, 8)):
        got = va_search.top_k(df, df.where("vec_id % 50 = 0"), 5, block, bits).collect()
        assert searched(got) == want  # vec_id 50 asks twice
    assert va_search.top_k(df.limit(0), df, 5).count() == 0 and va_search.top_k(df, df.limit(0), 5).count() == 0


def plain_top(q, q_id, rows, k=5):
    best = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), i) for i, v in rows if i != q_id)[:k]
    return [(q_id, n, i, -s) for n, (s, i) in enumerate(best, 1)]


def searched(got):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_wide_empty_and_equal_vectors(spark):
    wide = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1.3e7, 0.0]), (3, [-1.2e7, 5.0]), (4, [3e15, -1.0]), (5, []), (6, [0.5])]
    for bits in (4, 8):
        df = vectors_of(spark, wide)
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in wide]
        small = [w for w in whole if w[0] != 4]
        got = va_search.top_k(df.where("vec_id <> 4"), df.where("vec_id <> 4"), 3, cell_bits=bits).collect()
        assert searched(got) == sorted(r for i, q in small for r in plain_top(q, i, small, 3))
    with pytest.raises(Exception, match="64 bits|overflow|OVERFLOW"):
        va_search.top_k(vectors_of(spark, [(1, [3e15]), (2, [3e15])]), vectors_of(spark, [(1, [3e15])]), 1).collect()
    with pytest.raises(Exception, match="62 bits"):
        va_search.top_k(vectors_of(spark, [(1, [3e16])]), vectors_of(spark, [(1, [3e16])]), 1).collect()
    empty = vectors_of(spark, [(i, []) for i in range(9)])
    got = va_search.top_k(empty, empty.where("vec_id = 4"), 5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 5, 0)]
    same = vectors_of(spark, [(i % 400, [0.5, 0.25]) for i in range(1200)] + [(1000 + i, [0.1 * i, 0.2]) for i in range(4)])
    rows = [(i % 400, [128, 64]) for i in range(1200)] + [(1000 + i, [math.floor(25.6 * i), 51]) for i in range(4)]
    got = va_search.top_k(same, same.where("vec_id in (1000, 1003)"), 5, block_rows=100).collect()
    assert searched(got) == sorted(r for i, q in rows if i in (1000, 1003) for r in plain_top(q, i, rows))


def test_the_cells_leave_few_rows_to_read(spark, monkeypatch):
    x = np.random.default_rng(20).normal(size=(3000, 32)) / 6
    saved, save = {}, va_search.save
    monkeypatch.setattr(va_search, "save", lambda df, name: saved.setdefault(name, save(df, name)) if name == "candidates" else save(df, name))
    df = vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert va_search.top_k(df, df.where("vec_id % 50 = 0"), 5).count() == 60 * 5
    assert saved["candidates"].count() < 60 * 20


def test_cells_bound_the_vectors():
    x = np.random.default_rng(11).integers(-(2**40), 2**40, (300, 8))
    code, low, width = va_search.cells(x, 4)
    assert code.max() < 16 and (x >= low + code * width).all() and (x < low + (code + 1) * width).all()
    q = np.random.default_rng(12).integers(-(2**20), 2**20, (20, 8))
    lower, upper = va_search.bounds(q, code, low, width)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q], dtype=object)
    assert (lower <= exact).all() and (exact <= upper).all()


# ---------------------------------------------------------------- 10 mixing


def test_raking_meets_the_margins():
    rng = np.random.default_rng(12)
    tokens = rng.integers(1, 1000, 60)
    codes = [np.arange(60) % 3, np.arange(60) // 3 % 4, np.arange(60) // 12]
    targets = [np.array([0.5, 0.3, 0.2]), np.full(4, 0.25), np.array([0.1, 0.2, 0.3, 0.2, 0.2])]
    x, worst = mixing.rake(tokens, codes, targets)
    assert worst < 1e-9
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, x) / x.sum(), t, atol=1e-9)
    w = x / tokens
    c = mixing.keep_factor(0.6 * tokens.sum(), lambda c: (tokens[c * w >= 1].sum(), (tokens * w)[c * w < 1].sum()))
    assert abs((tokens * np.minimum(1, c * w)).sum() - 0.6 * tokens.sum()) < 1e-6 * tokens.sum()


def test_mix_small_and_frame_paths_agree(spark):
    rng = np.random.default_rng(13)
    rows = [(i, random_text(rng, int(rng.integers(1, 60))), "s" + str(min(3, int(rng.integers(0, 8)))), "l" + str(i % 3), 1.0) for i in range(300)] + [(300, None, None, "l0", 1.0), (300, None, None, "l0", 1.0), (None, "a b", "s0", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight double")
    a = mixing.mix(df, ("source", "lang"), part=0.5).orderBy("doc_id").collect()
    b = mixing.mix(df, ("source", "lang"), part=0.5, max_cells=0).orderBy("doc_id").collect()
    assert len(a) == len(b) == 303
    for x, y in zip(a, b):
        assert x["n_tokens"] == y["n_tokens"] and abs(x["weight"] - y["weight"]) < 1e-9 and abs(x["probability"] - y["probability"]) < 1e-9 and x["kept"] == y["kept"]
    total = sum(r["n_tokens"] for r in a)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in a) - 0.5 * total) < 1e-6 * total
    given = mixing.mix(df, ("source",), {"source": {"s0": 0.5, "s1": 0.5, "gone": 3.0}}, part=0.3).collect()
    assert {r["kept"] for r in given if r["source"] in ("s2", "s3")} == {False}
    assert mixing.mix(df.limit(0), ("source",)).count() == 0
    for cells in (0, 10**6):  # all that have a weight are wanted whole
        whole = mixing.mix(df, ("source",), {"source": {"s0": 0.5, "s1": 0.5}}, part=1.0, max_cells=cells).collect()
        assert {(r["source"] in ("s0", "s1"), r["kept"]) for r in whole} == {(True, True), (False, False)}


def test_mix_with_clashing_names_and_other_types(spark):
    rows = [(1, "a b", 5, "x", 7, "k"), (2, None, None, "y", 8, "l"), (3, "c", 5, None, 9, "m"), (3, "c", 5, None, 9, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source int, lang string, __source int, kept string")
    got = mixing.mix(df, ("source", "lang"), part=1.0)
    assert dict(got.dtypes)["source"] == "int" and dict(got.dtypes)["kept"] == "boolean" and got.count() == 4
    assert sorted(r["__source"] for r in got.collect()) == [7, 8, 9, 9]


def test_mixing_draw_is_even(spark):
    u = np.array([r[0] for r in spark.range(4000).select(mixing.uniform(F.col("id"), 7)).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02


def test_links_of_one_cluster_thin_to_one_a_member(spark):
    """Forty members that share buckets with four first members each: edges go by members, not by buckets."""
    links = [(a, b, a) for a in range(4) for b in range(4, 44)]
    thin = near_dedup._thinned(spark.createDataFrame([*links, (50, 51, 50)], "a long, b long, place long"))
    assert thin.count() == 40 + 3 + 1
    label = {r["node"]: r["label"] for r in connected_components(thin).collect()}
    assert label == {**dict.fromkeys(range(44), 0), 50: 50, 51: 50}
