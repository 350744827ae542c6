"""The pipeline's stages against their operators' rules, and registered SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import plain_components, plain_contamination
from tidemark.llm import decontaminate, mixing, near_dedup, quality, queries
from tidemark.llm.common import save, table


def test_each_stage_keeps_columns_and_takes_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == names
        sizes.append(docs.count())
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 0.4 * sizes[0]
    assert near_dedup.near_duplicates(docs, 80).where("not kept").isEmpty()
    assert decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").isEmpty()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    total = out.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert total[0] == total[1]


def test_stages_stand_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_equal_brute_force_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, null and empty texts, and columns named like those that stages make."""
    docs = table(spark, sf_dir, "documents").limit(90).collect()
    bench = [r["text"] for r in table(spark, sf_dir, "benchmark").where("text is not null").limit(3).collect()]
    some = next(r["text"] for r in docs if len((r["text"] or "").split()) > 60)
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(None, None), (None, some), (docs[5]["doc_id"], bench[0]), (None, "x " + bench[1]), (7, ""), (7, some + " end"), (docs[6]["doc_id"], docs[7]["text"])]
    clash = ["topic", "n_tokens", "weight", "probability", "kept", "score", "predicted", "quality_score", "__row", "__score", "component_id", "contaminated"]
    schema = "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"{c} int" for c in clash)
    odd = spark.createDataFrame([(i, t, "s", "l", k, *[k] * len(clash)) for k, (i, t) in enumerate(rows)], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns
        found = got.collect()
        assert all(len({r["n_chars"], *(r[c] for c in clash)}) == 1 and rows[r["n_chars"]] == (r["doc_id"], r["text"]) for r in found)
        kept[name] = {r["n_chars"] for r in found}
        assert len(kept[name]) == len(found)
    keyed = [(k, t) for k, (_, t) in enumerate(rows)]
    groups = {}
    for k, _, component, _ in plain_components(keyed, corpus_pipeline.SIMILARITY):
        groups.setdefault(component, []).append((rows[k][0] is None, rows[k][0] or 0, k))
    for k in kept["near-duplicate removal"]:
        group = next(g for g in groups.values() if any(x[2] == k for x in g))
        assert [x[:2] for x in group if x[2] == k] == [min(group)[:2]]
    assert len(kept["near-duplicate removal"]) == len(groups)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = [r[0] for r in plain_contamination(keyed, items) if not r[-1]]
    assert kept["benchmark decontamination"] == set(clean)
    ranker = quality.train(odd, table(spark, sf_dir, "labels"))
    good = [k for k, t in keyed if ranker is None or ranker.score(quality.measure((t or "").encode())[None])[0] >= quality.CUT]
    assert kept["quality classifier"] == set(good)
    mixed = mixing.mix(odd.drop(*clash).withColumn("topic", mixing.topic(F.col("text"))))
    assert kept["mixing"] == {r["n_chars"] for r in mixed.where("kept").collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = queries.queries()[name](spark, sf_dir)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want
