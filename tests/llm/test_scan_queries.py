"""Licence scans, hard negatives and vector codes: brute force and the defined edge cases."""

import hashlib
import math
import re

import numpy as np
import pytest

from tidemark.llm import hard_negatives as H
from tidemark.llm import license_scan as L
from tidemark.llm import scan_queries as Q
from tidemark.llm import vector_codes as V


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


# ---------------------------------------------------------------- 11 licence scans


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    w, found = plain_words(text), []
    for t in L.BASE:
        p = t.statement.split()
        found += [(i, t.label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), found


LICENCE_TEXTS = [
    None, "", " \n\t ", "cc", "cc by", "CC-BY cc by CC  BY", "cc by cc", "by cc", "General Public License", "general public licens",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. all RIGHTS reserved", "rights reserved",
    "Licensed under CC BY-NC 4.0. Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "apache license " + "x " * 40 + "2 0",
    "gnu general public license , as it is , version 2", "K cc by", "RELEASED UNDER THE MİT LICENSE", "mit licenſe", "cc by " * 4000, "all\x00rights\x7freserved", "ccby cc_by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted, free of charge", "é all rights reserved é",
]


def test_licence_query_on_odd_texts(spark, tmp_path):
    rows = [(i, t, "x", "a") for i, t in enumerate(LICENCE_TEXTS)] + [(4, "cc by", "x", "a"), (None, "cc by", "x", "a")]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, matches string, n_words string")
    got = Q.op11_license_scan(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in rows)
    texts = dict(enumerate(LICENCE_TEXTS)) | {None: "cc by"}
    for r in got:
        n, base = plain_base(texts[r["doc_id"]])
        places = [i for i, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[10] == "gpl,gpl-3.0" and labels[13] == "cc-by,cc-by-nc,mit" and labels[14] == "apache-2.0" and labels[15] == "" and labels[16] == "gpl,gpl-2.0"
    assert labels[18] == labels[19] == "" and labels[23] == "mit" and labels[24] == ""


def test_licence_scan_of_an_empty_table_and_of_own_templates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan_documents(docs).count() == 0
    own = (L.Template("own", "to be or not to be", ("to be", "not to be")),)
    docs = spark.createDataFrame([(1, "To be or not to be"), (2, "not to be"), (3, "to be ... not to be to be")], "doc_id long, text string")
    got = {r["doc_id"]: [(m["start"], m["label"], round(m["share"], 3)) for m in r["matches"]] for r in L.scan_documents(docs, own, slack=1).collect()}
    assert got[1] == [(0, "own", 1.0)] or got[1] == [(3, "own", 1.0)]
    assert got[2] == [] and len(got[3]) == 1 and got[3][0][2] < 1


def test_the_anchor_is_the_rarest_word():
    index = L.build_index(1000, {"cc": 900, "by": 3})
    entry = next(e for e in index if e["statement"] == ["cc", "by"])
    assert (entry["word"], entry["place"]) == ("by", 1)


# ---------------------------------------------------------------- 12 hard negatives


def plain_negatives(rows):
    v = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in e]) for i, lab, e in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, e in v:
        if i % 50:
            continue
        scored = sorted((-dot(e, f), j, m) for j, m, f in v if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:5]:
            band = [(n, -t) for t, n, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, k, n, -s, t) for k, (n, t) in enumerate(band, 1)]
    return sorted(out)


def odd_vectors(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    rows = [(int(i), int(i * 7 % 10), (centres[i * 3 % 10] * 0.4 + rng.normal(size=dims) * 0.3).tolist()) for i in range(n)]
    rows += [(1000 + i, 3, [0.25] * dims) for i in range(120)]  # equal vectors: ties everywhere
    rows += [(50, 2, rows[50][2]), (50, 5, rows[49][2]), (None, 1, rows[3][2]), (2001, None, rows[4][2]), (2002, 1, None), (2003, 1, [None] * dims), (2004, 1, [float("nan")] * dims), (2005, 1, [float("inf")] + [0.0] * (dims - 1)), (2050, 4, []), (2051, 4, [0.5]), (2100, 4, [0.0] * dims), (2101, 4, [0.0] * dims)]
    return rows


@pytest.mark.parametrize("block,anchors", [(4096, 512), (37, 3)])
def test_hard_negatives_by_brute_force(spark, tmp_path, block, anchors):
    rows = odd_vectors(1, 260)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rank string")
    relabelled = df.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "embedding", "rank")
    got = H.mine(relabelled, relabelled.where("vec_id % 50 = 0"), block_rows=block, anchor_rows=anchors).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_hard_negatives_of_empty_tables_and_large_numbers(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert H.mine(df, df).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.4])], "vec_id long, label int, embedding array<double>")
    assert H.mine(one, one.limit(0)).count() == 0
    assert [tuple(r) for r in H.mine(one, one.where("vec_id = 0")).collect()] == [(0, 1, 1, 2, 256 * 128, 256 * 102)]
    wide = [(i, i % 2, [1e4 * (i % 5 + 1), 1e4, float(i)]) for i in range(101)]
    df = spark.createDataFrame(wide, "vec_id long, label int, embedding array<double>")
    got = H.mine(df.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "embedding"), df.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "embedding").where("vec_id % 50 = 0"), block_rows=9)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(wide)
    with pytest.raises(Exception, match="53 bits"):
        H.mine(*[spark.createDataFrame([(0, 1, [1e6]), (1, 1, [1e6])], "vec_id long, label int, embedding array<double>")] * 2).collect()


def test_bounds_hold_and_few_pairs_are_left(spark):
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(10, 64))[rng.integers(0, 10, 1500)] * 0.15 + rng.normal(size=(1500, 64)) * 0.05)).astype(np.int64)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1].copy()
    ends = H.stage_ends(64)
    a, b = H.Side(x[:100], turn, ends), H.Side(x, turn, ends)
    exact, slack, seen = x[:100] @ x.T, H.rounding(turn), []

    def near(i, j, lower, upper):
        want = exact if i is None else exact[i, j]
        assert (lower <= want).all() and (want <= upper).all()
        seen.append(lower.size)
        return upper >= 0.9 * (exact.max(axis=1)[:, None] if i is None else exact.max(axis=1)[i])

    i, j = H.survivors(a, b, slack, ends, near)
    got = set(zip(i.tolist(), j.tolist()))
    assert {(p, q) for p, q in zip(*np.nonzero(exact >= 0.9 * exact.max(axis=1)[:, None]))} <= got
    assert seen[1] < 0.3 * seen[0]


# ---------------------------------------------------------------- 13 vector codes


def plain_codes(rows):
    kept = [(i, lab, [math.floor(1024 * x) for x in e]) for i, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    wide = max(len(e) for *_, e in kept)
    width = -(-wide // 4)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    parts = [[(e + [0] * (4 * width - len(e)))[p * width : (p + 1) * width] for *_, e in kept] for p in range(4)]
    books = [[(e + [0] * (4 * width - len(e)))[p * width : (p + 1) * width] for *_, e in order[:256]] for p in range(4)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            of = [best(x, books[p])[1] for x in parts[p]]
            for k in range(len(books[p])):
                mine = [x for x, o in zip(parts[p], of) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[best(x, books[p]) for x in parts[p]] for p in range(4)]
    error = [sum(found[p][n][0] for p in range(4)) for n in range(len(kept))]
    label = {}
    for (_, lab, _), e in zip(kept, error):
        label[lab] = label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{found[p][n][1]:02x}" for p in range(4)), error[n], label[lab], sha) for n, (i, lab, _) in enumerate(kept))


@pytest.mark.parametrize("n,dims", [(330, 12), (40, 10), (1, 4)])
def test_vector_codes_by_brute_force(spark, tmp_path, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i, int(i % 3) if i % 11 else None, (rng.normal(size=dims) * (50 if i % 9 == 0 else 0.3)).tolist()) for i in range(n)]
    if n > 1:
        rows += [(500 + i, 1, [0.125] * dims) for i in range(90)] + [(3, 1, [0.5] * dims), (3, 1, [-0.5] * dims), (None, 2, [0.1] * dims), (901, 1, None), (902, 1, [None] * dims), (903, 1, [float("nan")] * dims), (904, 1, [float("-inf")] * dims), (905, 1, []), (906, None, [0.7])]
    write(spark, tmp_path, "embeddings", [(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, error string")
    got = Q.op13_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows)


def test_nearest_resolves_what_float32_cannot():
    rng = np.random.default_rng(5)
    book = (rng.integers(-3, 4, (256, 8)) + 2**27).astype(np.int64)  # far beyond float32's 24 bits
    book[100:] = book[:156]
    x = (rng.integers(-3, 4, (3000, 8)) + 2**27).astype(np.int64)
    index, distance = V.nearest(x, book)
    exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (distance == exact.min(axis=1)).all() and (index == exact.argmin(axis=1)).all()
    near = (rng.normal(size=(2000, 16)) * 300).astype(np.int64)
    low, high = V.intervals(near, near[:256])
    want = (near[:256] ** 2).sum(axis=1)[None] - 2 * near @ near[:256].T
    assert (low <= want).all() and (want <= high).all()
    assert (low <= high.min(axis=1)[:, None]).sum() < 1.1 * len(near)


def test_codes_of_empty_and_too_large_tables(spark):
    schema = "vec_id long, label int, embedding array<double>"
    codes, books = V.compress(spark.createDataFrame([], schema))
    assert codes.count() == 0 and V.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="28 bits"):
        V.compress(spark.createDataFrame([(1, 1, [1e6])], schema))
    rows = [(i, 0, [i / 8, -i / 4, 0.5, 1.0]) for i in range(20)]
    codes, books = V.compress(spark.createDataFrame(rows, schema))
    assert {r["vec_id"]: r["vector"] for r in V.decode(codes, books).collect()} == {i: v for i, _, v in rows}


def test_the_first_pass_of_a_search_returns_k_bounds_a_lane(spark, monkeypatch):
    from tidemark.llm import va_search as S

    rng, counts, meet = np.random.default_rng(11), {}, S._meet

    def counted(asked, file, k, look, schema, done=None):
        out = meet(asked, file, k, look, schema, done)
        counts["floors" if done else "rows"] = out.count()
        return out

    monkeypatch.setattr(S, "_meet", counted)
    x = rng.normal(size=(900, 16)) / 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = S.top_k(df, df.where("vec_id % 10 = 0"), 5, block_rows=32).collect()  # 29 blocks of cells, 3 of queries
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(got) == 90 * 5 and counts["floors"] <= 90 * 5 * lanes and counts["rows"] <= 90 * 20
    v = np.floor(256 * x).astype(np.int64)
    for q in (0, 440, 890):
        want = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(-s, i) for s, i in want]


def test_blocks_of_queries_are_neither_copied_to_lanes_nor_broadcast(spark, monkeypatch):
    from tidemark.llm import va_search as S

    plans, meet = [], S._meet

    def seen(*parts):
        out = meet(*parts)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(S, "_meet", seen)
    x = np.random.default_rng(12).normal(size=(300, 8)) / 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = S.top_k(df, df.where("vec_id % 3 = 0"), 5, block_rows=32).collect()  # 10 blocks of cells, 4 of queries
    v = np.floor(256 * x).astype(np.int64)
    want = [(q, i) for q in range(0, 300, 3) for _, i in sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(q, n % 5 + 1, i) for n, (q, i) in enumerate(want)]
    assert len(plans) == 2 and all("CartesianProduct" in p and "Broadcast" not in p and "Generate" not in p for p in plans)


def test_blocks_of_anchors_are_neither_copied_to_lanes_nor_broadcast(spark, monkeypatch):
    plans, search = [], H.search

    def seen(*parts):
        out = search(*parts)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(H, "search", seen)
    rows = odd_vectors(2, 120)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    relabelled = df.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "embedding")
    got = H.mine(relabelled, relabelled.where("vec_id % 50 = 0"), block_rows=25, anchor_rows=2)
    last = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert len(plans) == 2 and all("CartesianProduct" in p and "Generate" not in p for p in plans)
    assert not any("Broadcast" in p for p in (*plans, last))
