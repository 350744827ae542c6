"""Queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extract, interpolated_lm, mixing, near_dedup, quality, scan_queries, token_binary, toxicity, url_filter, va_search
from tidemark.llm.common import save, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Entries of the fixed list: (list_id, kind, value, action, at).
LIST = [
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-01-15 00:00:00"),
    ("spam", "domain", "cheap-pills.example.com", "remove", "2024-06-01 00:00:00"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-08-01 12:00:00"),
    ("spam", "domain", "cheap-pills.example.net", "add", "2024-03-01 00:00:00"),
    ("mobile", "domain", "example.org", "add", "2024-10-01 00:00:00"),
    ("mobile", "domain", "example.org", "remove", "2024-11-01 00:00:00"),
]


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): pages have no fetch time, so page_id stands in for one, over 2024."""
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(CAST(page_id % 366 AS INT), CAST(page_id % 24 AS INT))")
    return pages.select("page_id", "url", at.alias("fetched_at"))


def dated_list(seen: DataFrame) -> DataFrame:
    """A list that grows with the corpus: entries of a fifth of the hosts and a seventh of their
    first path parts, dated by a hash, besides the fixed ones."""
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")
    h, first = url_filter.host(F.col("url")), F.regexp_extract("url", r"://[^/?#\s]*/([^/?#\s]+)", 1)
    entry = lambda list_id, kind, value: F.struct(F.lit(list_id).alias("list_id"), F.lit(kind).alias("kind"), value.alias("value"))
    prefix = F.when(F.col("first") != "", F.lower(F.concat("h", F.lit("/"), "first")))
    read = seen.select(h.alias("h"), first.alias("first")).select(F.inline(F.array(entry("hosts", "host", F.col("h")), entry("parts", "prefix", prefix))))
    found = save(read.where("value is not null").withColumn("x", number(F.col("value"))).where("x % if(kind = 'host', 5, 7) = 0").distinct(), "list")
    day = lambda plus: F.expr(f"timestamp '2024-01-01 00:00:00' + make_dt_interval(CAST(x % 300 AS INT) + {plus})")
    log = [found.withColumns({"action": F.lit("add"), "at": day(0)}), found.where("x % 2 = 0").withColumns({"action": F.lit("remove"), "at": day(45)}), found.where("x % 6 = 0").withColumns({"action": F.lit("add"), "at": day(90)})]
    fixed = seen.sparkSession.createDataFrame(LIST, "list_id string, kind string, value string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    for part in log:
        fixed = fixed.unionByName(part.select("list_id", "kind", "value", "action", "at"))
    return fixed


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = captures(table(spark, sf_dir, "pages"))
    out = url_filter.filter_captures(seen, dated_list(seen))
    return out.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "blocked", "n_entries", F.array_join("lists", ",").alias("lists"))


_HOST = r"""nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '')"""

OP1_SQL = rf"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 366 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS f,
                  {_HOST} AS h, lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#\s]*)', 1)) AS p FROM pages),
v AS (SELECT DISTINCT 'hosts' AS list_id, 'host' AS kind, h AS value FROM c WHERE h IS NOT NULL
      UNION ALL SELECT DISTINCT 'parts', 'prefix', h || '/' || lower(regexp_extract(url, '://[^/?#\s]*/([^/?#\s]+)', 1)) FROM c
      WHERE h IS NOT NULL AND regexp_extract(url, '://[^/?#\s]*/([^/?#\s]+)', 1) <> ''),
n AS (SELECT *, CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) AS x FROM v),
k AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(x % 300 AS INTEGER)) AS day FROM n WHERE x % (CASE WHEN kind = 'host' THEN 5 ELSE 7 END) = 0),
log AS (SELECT list_id, kind, value, true AS is_on, day AS since FROM k
        UNION ALL SELECT list_id, kind, value, false, day + to_days(45) FROM k WHERE x % 2 = 0
        UNION ALL SELECT list_id, kind, value, true, day + to_days(90) FROM k WHERE x % 6 = 0
        UNION ALL SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', {str(d == 'add').lower()}, TIMESTAMP '{e}')" for a, b, c, d, e in LIST)})),
i AS (SELECT list_id, kind, value, since AS valid_from, lead(since) OVER (PARTITION BY list_id, kind, value ORDER BY since) AS valid_to, is_on FROM log),
m AS (SELECT DISTINCT page_id, url, f, list_id, kind, value FROM c JOIN (SELECT * FROM i WHERE is_on) AS i
      ON f >= valid_from AND (valid_to IS NULL OR f < valid_to)
      AND CASE kind WHEN 'host' THEN h = value WHEN 'domain' THEN h = value OR ends_with(h, '.' || value)
               ELSE starts_with(h || p || '/', value || '/') END),
a AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list_id, ',' ORDER BY list_id) AS lists FROM m GROUP BY page_id)
SELECT c.page_id, c.url, strftime(f, '%Y-%m-%d %H:%M:%S') AS fetched_at, n IS NOT NULL AS blocked,
       CAST(coalesce(n, 0) AS BIGINT) AS n_entries, coalesce(lists, '') AS lists
FROM c LEFT JOIN a USING (page_id)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_binary.read_blocks(*token_binary.token_file(docs, tokenizer_path(), END_ID))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("items")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, size, list_slice(w, i, i + size - 1) AS g
           FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM b)),
grams AS (SELECT r, i, size, list_slice(w, i, i + size - 1) AS g
          FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM wanted))),
found AS (SELECT r, i, grams.size AS size, item_id FROM grams JOIN wanted USING (g)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(generate_series(i, i + size - 1)) AS at FROM found) GROUP BY r),
item AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
         FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS place FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.place),
c AS (SELECT doc_id, min(place) AS low FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, doc_id) AS component_id, coalesce(c.low, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return va_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP9_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS n, q.vec_id AS query_id, e.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e AS q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("topic", mixing.topic(F.col("text")))
    out = mixing.mix(docs)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def _op10_sql(rounds: int = 40) -> str:
    """The same steps with a fixed number of rounds, written out."""
    steps = ["d AS (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN 'none' WHEN instr(text, '|') > 0 THEN 'table' WHEN instr(text, '!!') > 0 THEN 'shout' WHEN regexp_matches(text, '[%&#$*]{3}') THEN 'marks' WHEN length(text) < 600 THEN 'short' ELSE 'prose' END AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents)"]
    steps += ["x0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(n) AS DOUBLE) AS x FROM d GROUP BY ALL)"]
    for m in mixing.MARGINS:
        steps += [f"g_{m} AS MATERIALIZED (SELECT {m}, (SELECT sum(t) FROM x0) * pow(sum(t), {mixing.TEMPER}) / sum(pow(sum(t), {mixing.TEMPER})) OVER () AS goal FROM x0 GROUP BY {m})"]
    k = 0
    for _ in range(rounds):
        for m in mixing.MARGINS:
            steps += [f"x{k + 1} AS MATERIALIZED (SELECT source, lang, topic, t, x * goal / sum(x) OVER (PARTITION BY {m}) AS x FROM x{k} JOIN g_{m} USING ({m}))"]
            k += 1
    steps += [
        f"w AS MATERIALIZED (SELECT *, CASE WHEN t > 0 THEN x / t ELSE 1.0 END AS w FROM x{k})",
        f"s AS (SELECT w, {mixing.PART} * sum(t) OVER () AS want, coalesce(sum(t) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure, sum(t * w) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w)",
        "c AS (SELECT max((want - sure) / rest) AS c FROM s WHERE (want - sure) / rest * w <= 1 AND w = (SELECT max(w) FROM s WHERE (want - sure) / rest * w <= 1))",
        "p AS (SELECT source, lang, topic, w, least(1.0, (SELECT c FROM c) * w) AS p FROM w)",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, CAST(n AS BIGINT) AS n_tokens, round(w, 6) AS weight, round(p, 6) AS probability,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
FROM d JOIN p USING (source, lang, topic)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_toxicity": op2_toxicity,
        "op3_token_binary": op3_token_binary,
        "op4_decontaminate": op4_decontaminate,
        "op5_html_extract": op5_html_extract,
        "op6_interpolated_lm": op6_interpolated_lm,
        "op7_near_dedup": op7_near_dedup,
        "op8_quality": op8_quality,
        "op9_va_search": op9_va_search,
        "op10_mixing": op10_mixing,
        **scan_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op4_decontaminate": OP4_SQL, "op7_near_dedup": OP7_SQL, "op9_va_search": OP9_SQL, "op10_mixing": _op10_sql(), **scan_queries.oracle_sql()}
