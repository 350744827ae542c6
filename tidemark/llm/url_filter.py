"""URL filters: a temporal list join in DataFrame operations only.

A list is a log of dated entries (list_id, kind, value, action, at): an `add` makes a value active
from its time on, a `remove` ends that. `intervals` turns the log into validity intervals
[valid_from, valid_to). `filter_captures` looks every capture up as of its fetch time: the keys of
its URL (the host, each parent domain, the host with each leading part of the path) meet the
intervals of the same kind and value, and those that were active then decide.

Kinds: `host` (the exact host), `domain` (the host or any name below it), `prefix` (host and
leading path segments, written host/path).

Scale: a capture's keys are made as it is read, and only as deep as the list's deepest domain and
prefix, so a URL of thousands of segments costs no more than its length. Spark broadcasts the list
or the verdict if they are small and sorts and merges otherwise; a key or capture that a third of
all rows share makes a skewed partition, which adaptive execution splits. A group that is gathered
is one capture's active entries, pre-aggregated before the shuffle.

Defined results: a null or unreadable URL, or a null fetch time, meets nothing and is allowed; of
entries of one list, kind and value with the same time the `remove` counts; a repeated `add`
changes nothing; a repeated list entry counts once; entries with a null in list_id, kind, value, action or at, or another action, are
ignored; repeated captures get the same result each; empty tables give empty results; extra
columns of captures are kept unless they are named like a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, save


def host(url: Column) -> Column:
    """The lower-case host of a URL without port, user, or final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(name != "", name)


def path(url: Column) -> Column:
    """The path of a URL without query and fragment."""
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#\s]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list_id, kind, value, valid_from, valid_to) of a log of entries; valid_to null: still active."""
    log = entries.where(F.col("action").isin("add", "remove"))
    log = log.select("list_id", "kind", F.lower("value").alias("value"), F.col("at").cast("timestamp").alias("at"), (F.col("action") == "add").alias("on"))
    log = log.where("list_id is not null and kind is not null and value is not null and at is not null")
    states = log.groupBy("list_id", "kind", "value", "at").agg(F.bool_and("on").alias("on"))
    w = W.partitionBy("list_id", "kind", "value").orderBy("at")
    turns = states.withColumn("was", F.lag("on", 1, False).over(w)).where("on <> was")
    spans = turns.withColumn("valid_to", F.lead("at").over(w))
    return spans.where("on").select("list_id", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def url_keys(url: Column, labels: int, segments: int) -> Column:
    """All (kind, value) under which a list entry can hold for a URL; null if it has no host.

    Domains have at most `labels` labels, prefixes at most `segments` path segments (none if negative).
    """
    h = host(url)
    names = F.split(h, r"\.")
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda p: p != ""), 1, max(segments, 0))
    key = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    keys = [F.array(key("host", h))]
    if labels > 0:
        from_last = F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels)))
        keys += [F.transform(from_last, lambda i: key("domain", F.array_join(F.slice(names, -i, i), ".")))]
    if segments >= 0:
        keys += [F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: key("prefix", F.lower(F.array_join(F.concat(F.array(h), F.slice(parts, 1, i)), "/"))))]
    return F.when(h.isNotNull(), F.concat(*keys))


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures and the columns blocked boolean, n_entries long, lists (ids of the lists that hold)."""
    active = save(intervals(entries), "intervals")
    depth = lambda kind, mark: F.max(F.when(F.col("kind") == kind, F.size(F.split("value", mark))))
    labels, segments = active.agg(depth("domain", r"\."), depth("prefix", "/")).first()
    own = captures.drop("blocked", "n_entries", "lists")
    names = fresh(own.columns, "u", "f")
    u, f = names["u"], names["f"]
    left = own.withColumns({u: F.col(url), f: F.col(fetched).cast("timestamp")})
    seen = left.select(u, f).where(F.col(u).isNotNull() & F.col(f).isNotNull())
    keyed = seen.withColumn("key", F.explode(url_keys(F.col(u), labels or 0, (segments or 0) - 1))).select(u, f, "key.kind", "key.value")
    held = keyed.join(active, ["kind", "value"]).where((F.col("valid_from") <= F.col(f)) & (F.col("valid_to").isNull() | (F.col(f) < F.col("valid_to"))))
    verdict = held.groupBy(u, f).agg(F.collect_set(F.struct("list_id", "kind", "value")).alias("found"))
    verdict = verdict.select(u, f, F.size("found").cast("long").alias("n_entries"), F.array_sort(F.array_distinct("found.list_id")).alias("lists"))
    out = left.join(verdict, [u, f], "left").drop(u, f)
    empty = F.array().cast(out.schema["lists"].dataType)
    return out.withColumns({"blocked": F.col("n_entries").isNotNull(), "n_entries": F.coalesce("n_entries", F.lit(0).cast("long")), "lists": F.coalesce("lists", empty)})
