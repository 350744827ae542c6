"""Queries of licence scans, hard negatives and vector codes, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, license_scan, vector_codes
from tidemark.llm.common import table


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a["label"])), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max("matches.share"), F.lit(0.0)), 6).alias("score"),
    )


def _op11_sql() -> str:
    quoted = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    starts = lambda t, p: next(i for i in range(len(t)) if t[i : i + len(p)] == p)
    templates = [(i, t.label, t.base, t.statement.split(), [p.split() for p in t.phrases]) for i, t in enumerate(license_scan.TEMPLATES)]
    phrases = ", ".join(f"({i}, {n}, {starts(s, p)}, {quoted(p)})" for i, _, _, s, ps in templates for n, p in enumerate(ps))
    statements = ", ".join(f"({i}, '{label}', {str(base).lower()}, {quoted(s)})" for i, label, base, s, _ in templates)
    slack = license_scan.SLACK
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(tid, label, base, statement) AS (VALUES {statements}),
p(tid, pid, begins, phrase) AS (VALUES {phrases}),
tw AS (SELECT tid, unnest(statement) AS word, generate_subscripts(statement, 1) - 1 AS k FROM t),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT r, unnest(w) AS word FROM d) SEMI JOIN tw USING (word) GROUP BY word),
v AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 0.5)) AS weight FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
pw AS (SELECT tid, pid, begins, phrase, unnest(phrase) AS word, generate_subscripts(phrase, 1) - 1 AS k FROM p),
a AS (SELECT * FROM pw JOIN v USING (word) QUALIFY row_number() OVER (PARTITION BY tid ORDER BY weight DESC, begins + k, begins) = 1),
pos AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d WHERE len(w) > 0),
c AS (SELECT r, w, tid, pid, i - k - begins AS origin, i - k AS start FROM pos JOIN a USING (word) JOIN d USING (r)
      WHERE i - k >= 0 AND list_slice(w, i - k + 1, i - k + len(phrase)) = phrase),
o AS (SELECT c.r, c.w, c.tid, c.origin, c.start, bool_and(q.tid IS NULL OR len(list_filter(range(-{slack}, {slack + 1}), lambda x: c.origin + q.begins + x >= 0 AND list_slice(c.w, c.origin + q.begins + x + 1, c.origin + q.begins + x + len(q.phrase)) = q.phrase)) > 0) AS whole
      FROM c LEFT JOIN p AS q ON q.tid = c.tid AND q.pid <> c.pid GROUP BY ALL),
s AS (SELECT o.r, o.tid, o.start, sum(CASE WHEN o.origin + k >= 0 AND o.w[o.origin + k + 1] = word THEN weight ELSE 0 END) / sum(weight) AS share
      FROM o JOIN tw USING (tid) JOIN v USING (word) WHERE whole GROUP BY o.r, o.tid, o.start),
m AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s JOIN t USING (tid) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN m USING (r)"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP12_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.n AS n, a.vec_id AS anchor_id, e.vec_id AS vec_id, a.label = e.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e AS a, e WHERE a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
r AS (SELECT p.n, place, p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.n, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.n = p.n AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """The rounds written out; a codebook is a row a part and entry."""
    assign = lambda k: f"""a{k} AS MATERIALIZED (SELECT n, part, x, unnest(b) AS b FROM (SELECT n, part, any_value(x) AS x, min({{'d': d, 'entry': entry}}) AS m, [m] AS b
        FROM (SELECT v.n, v.part, v.x, c.entry, CAST(list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN c{k} AS c USING (part)) GROUP BY n, part))"""  # noqa: E731
    steps = []
    for k in range(vector_codes.ROUNDS):
        steps += [
            assign(k),
            f"t{k} AS (SELECT part, b.entry AS entry, i, CAST(sum(y) AS BIGINT) AS total, count(*) AS n FROM (SELECT part, b, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL)",
            f"u{k} AS (SELECT part, entry, list(CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END ORDER BY i) AS c FROM t{k} GROUP BY part, entry)",
            f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN u{k} USING (part, entry))",
        ]
    last = vector_codes.ROUNDS
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT n, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS x FROM e, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, n - 1 AS entry, x AS c FROM v WHERE n <= 256),
{", ".join(steps)},
{assign(last)},
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS sha FROM c{last}),
r AS (SELECT n, string_agg(printf('%02x', b.entry), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{last} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM k) AS codebooks_sha256 FROM e JOIN r USING (n)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op11_license_scan": op11_license_scan, "op12_hard_negatives": op12_hard_negatives, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op11_license_scan": _op11_sql(), "op12_hard_negatives": OP12_SQL, "op13_vector_codes": _op13_sql()}
