"""License scans by a positional rare-token index, in DataFrame expressions only.

A template is a licence statement with key phrases that must all stand in a file. Its index entry is its
anchor: of the key phrases' words the one with the highest inverse document frequency, by the documents
at hand. A file that holds all key phrases holds that word, so nothing is missed by looking up the
anchors' words only.

1. `word_counts` counts, for the templates' words, the documents that hold them (over all documents).
2. `build_index` orders each template's words by that and picks its anchor; an entry has the anchor's
   place in its key phrase and in the statement, and the statement's words with their weights.
3. `scan` finds, per file, where the words of the index stand (its posting lists). Every posting is
   aligned with the entries of its word: the anchor's key phrase must stand around it word for word, the
   other key phrases at their places relative to it, give or take `slack` words. What stands is a match;
   its share is the weight of the statement's words that stand exactly at their relative places.

Scale: the index is a literal of the plan, as large as the list of templates, not as the corpus; counts
are the templates' vocabulary. Files are scanned row by row without a shuffle, whatever their source, and
words are looked up by their place in the file's list of words, so a file of any length costs its length.

Defined results: a null text is empty and matches nothing; words are runs of digits, ASCII letters and
everything beyond ASCII, only A-Z is lower-cased; matches of one template may overlap and each counts;
repeated rows and ids are scanned one by one; ties of weight go to the word that stands first; an empty
table gives an empty result; columns asked for are kept, others ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLACK = 8


@dataclass(frozen=True)
class Template:
    """A licence statement in lower-case words, and the phrases of it that must stand."""

    label: str
    statement: str
    phrases: tuple[str, ...]
    base: bool = False


def phrase(label: str, words: str) -> Template:
    return Template(label, words, (words,), True)


# Labels, public licence statements and their key phrases.
BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))
TEMPLATES = (
    *BASE,
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "permitted")),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("epl-2.0", "eclipse public license version 2 0", ("eclipse public license", "2 0")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "obtaining a copy")),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license", "2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


def words_of(text: Column) -> Column:
    """The words of a text as they are written; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _one_of(word: Column, known: list[str]) -> Column:
    """Whether a word is one of the known ones. Words beyond ASCII never are, but some of their letters have
    an ASCII small letter: hence the second look, at A-Z alone."""
    return F.lower(word).isin(known) & lowered(word).isin(known)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.statement.split()})


def word_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of the templates."""
    known = vocabulary(templates)
    held = F.array_distinct(F.transform(F.filter(words_of(F.col(text)), lambda w: _one_of(w, known)), lowered))
    # The null stands for the document itself, so that one pass counts both.
    counted = docs.select(F.explode(F.concat(held, F.array(F.lit(None).cast("string")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}  # at most a row a word of the templates
    return found.pop(None, 0), found


def build_index(n_docs: int, counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[dict]:
    """An entry a template: its anchor, and all places relative to the start of the statement."""
    weight = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary(templates)}
    index = []
    for t in templates:
        statement, entries = t.statement.split(), []
        for p in t.phrases:
            w = p.split()
            entries.append((w, next(i for i in range(len(statement)) if statement[i : i + len(w)] == w)))
        anchor, first, at = max(((w, start, k) for w, start in entries for k in range(len(w))), key=lambda x: (weight[x[0][x[2]]], -x[1] - x[2]))
        others = [{"phrase": w, "first": start} for w, start in entries if (w, start) != (anchor, first)]
        index.append({"label": t.label, "base": t.base, "word": anchor[at], "place": first + at, "phrase": anchor, "first": first, "others": others, "statement": statement, "weights": [weight[w] for w in statement]})
    return index


ENTRY = "label: string, base: boolean, word: string, place: int, phrase: array<string>, first: int, others: array<struct<phrase: array<string>, first: int>>, statement: array<string>, weights: array<double>"


def literal(index: list[dict]) -> Column:
    """The index as one constant: an array of entries, whose places count from the statement's first word."""
    return F.from_json(F.lit(json.dumps(index)), f"array<struct<{ENTRY}>>")


def scan(docs: DataFrame, index: list[dict], keep: tuple[str, ...] = ("doc_id",), slack: int = SLACK, text: str = "text") -> DataFrame:
    """The kept columns, n_words long and matches: array of (label, base, start, words, share), by start.

    start is the first matched word of the file (from 0), words the length of the matched key phrase.
    """
    rare = sorted({e["word"] for e in index})
    w, n = F.col("__words"), F.size("__words")
    postings = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda p: _one_of(p["w"], rare))
    read = lambda start, size: F.transform(F.slice(w, F.greatest(start, F.lit(0)) + 1, size), lowered)
    stands = lambda phrase, start: (start >= 0) & (start + F.size(phrase) <= n) & (read(start, F.size(phrase)) == phrase)

    def aligned(posting: Column, e: Column) -> Column:
        origin = posting["i"] - e["place"]
        around = lambda o: F.exists(F.sequence(-F.lit(slack), F.lit(slack)), lambda d: stands(o["phrase"], origin + o["first"] + d))
        return (lowered(posting["w"]) == e["word"]) & stands(e["phrase"], origin + e["first"]) & F.forall(e["others"], around)

    def match(posting: Column, e: Column) -> Column:
        origin = posting["i"] - e["place"]
        there = F.transform(e["statement"], lambda s, k: F.coalesce(lowered(F.get(w, F.when(origin + k >= 0, origin + k))) == s, F.lit(False)))
        got = F.aggregate(F.arrays_zip(there.alias("t"), e["weights"].alias("v")), F.lit(0.0), lambda a, x: a + F.when(x["t"], x["v"]).otherwise(0.0))
        whole = F.aggregate(e["weights"], F.lit(0.0), lambda a, x: a + x)
        return F.struct((origin + e["first"]).cast("long").alias("start"), e["label"].alias("label"), e["base"].alias("base"), F.size(e["phrase"]).alias("words"), F.when(whole > 0, got / whole).otherwise(1.0).alias("share"))

    entries = literal(index)
    matches = F.flatten(F.transform("__postings", lambda p: F.transform(F.filter(entries, lambda e: aligned(p, e)), lambda e: match(p, e))))
    read_once = docs.select(*keep, words_of(F.col(text)).alias("__words")).withColumn("__postings", postings)
    return read_once.select(*keep, n.cast("long").alias("n_words"), F.array_sort(matches).alias("matches"))


def scan_documents(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """(doc_id, n_words, matches) with an index built from the same documents."""
    return scan(docs, build_index(*word_counts(docs, templates), templates), slack=slack)
