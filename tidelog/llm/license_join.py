"""License scan: an exact set-similarity join of text blocks with license templates, in SQL functions.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case; blocks are
lines and, for notices wrapped over lines, windows of ``2 * REACH`` words that start at every
``REACH``-th word of the text. Any ``REACH`` words in a row, as many as the longest template has, lie
in one window, whatever line breaks and comment marks stand between them. A block holds a template if at least ``CONTAINMENT`` of the template's distinct words stand in
it. All words that templates use are ordered by how many documents of the corpus have them, rarest
first. In that order the join takes, of every block, its template words. A template's prefix are its first
(size - needed + 1) words: a block without any of them can't hold enough of it. So prefix words of templates
and of blocks are joined where they are equal, and a pair goes on

- by length, if the block has as many template words as the overlap that is needed;
- by prefix, if the word is their first common one and stands early enough in the block too;
- by position, if what follows it on either side is long enough;

and has its overlap counted in full, so no block is missed and no pair is counted twice. The templates are one
table, so the plan is the same however many there are; it is broadcast while its text is within
``BROADCAST_CHARS`` and shuffled beyond. The corpus is scanned twice (frequencies, join); counts of template
words and one short row a document are shuffled.

Besides, plain phrases are counted at every place where their words follow one another.

Input columns ``doc_id`` and ``text``; others are ignored. A null or empty text has no words, no labels
and score 0; repeated rows each give a row; a null doc_id stays null; frequency ties are ordered by the
word; an empty table gives no rows; without templates, only phrases are found. Rows are told apart by
their place in the input, so a repeated task must get them in the same order, as it does from files and from
tables that are stored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words of a lower-cased text (a fixed value).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9
#: Phrases whose every place is counted, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and wording of public license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Text of the templates' table that is broadcast at most.
BROADCAST_CHARS = 4_000_000
Templates = list[tuple[str, str]]


def reach(templates: Templates) -> int:
    """Words of the longest template, with repeats."""
    return max((len(t.split()) for _, t in templates), default=1)


def vocabulary(templates: Templates) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def _literal(words: list[str]) -> Column:
    """Words, none of which has a space, as one literal."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def _lower(text: Column) -> Column:
    """A-Z in lower case. Lower case of other letters changes no word's ASCII letters and no separator, but
    for the two letters that have ASCII ones in lower case: texts with these are translated letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _parts(docs: DataFrame) -> DataFrame:
    """doc_id, low (the text in lower case) and parts (its words, with an empty one where the text
    begins or ends with a separator)."""
    low = docs.select("doc_id", _lower(F.coalesce("text", F.lit(""))).alias("low"))
    return low.select("doc_id", "low", F.split("low", SEPARATOR, -1).alias("parts"))


def word_order(docs: DataFrame, templates: Templates) -> list[str]:
    """The templates' words by the number of documents that have them, rarest first. At most as many
    rows as there are template words reach the driver."""
    words = vocabulary(templates)
    seen = _parts(docs).select(F.explode(F.array_intersect(_literal(words), "parts")).alias("word")).groupBy("word").count()
    counts = dict.fromkeys(words, 0) | {r["word"]: r["count"] for r in seen.collect()}
    return sorted(words, key=lambda w: (counts[w], w))


def needed(template: list[str]) -> int:
    return math.ceil(CONTAINMENT * len(template) - 1e-9)


def _prefixes(docs: DataFrame, templates: list[tuple[str, list[str]]]) -> DataFrame:
    """A row for each prefix word of each template: token, at (its place from 1), label, words, need."""
    rows = [{"token": w, "at": k + 1, "label": label, "words": t, "need": needed(t)} for label, t in templates for k, w in enumerate(t[: len(t) - needed(t) + 1])]
    text = json.dumps(rows)
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<token:string,at:int,label:string,words:array<string>,need:int>>")))
    return F.broadcast(table) if len(text) <= BROADCAST_CHARS else table


def _blocks(order: list[str], width: int) -> Column:
    """The template words, in order, of each line and each window of words of a text."""
    lines = F.transform(F.split("low", "\n"), lambda b: F.array_intersect(_literal(order), F.split(b, SEPARATOR)))
    # Template words are never empty, so an empty part at either end takes the place of a word of the window
    # only at the text's ends, where windows have room.
    starts = F.sequence(F.lit(1), F.size("parts"), F.lit(width))
    windows = F.transform(starts, lambda i: F.array_intersect(_literal(order), F.slice("parts", i, 2 * width)))
    return F.concat(lines, windows)


def _containment() -> Column:
    """The share of a template's words in the block it was joined with, or null if that is too small."""
    size, whole = F.size("block"), F.size("words")
    at = F.array_position("block", F.col("token"))
    first = F.get(F.array_intersect(F.slice("words", F.lit(1), whole - F.col("need") + 1), "block"), F.lit(0))
    near = (size >= F.col("need")) & (at <= size - F.col("need") + 1) & (first == F.col("token")) & (1 + F.least(whole - F.col("at"), size - at) >= F.col("need"))
    overlap = F.size(F.array_intersect("words", "block"))
    return F.when(near, F.when(overlap >= F.col("need"), overlap / whole))


def scan(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the
    best containment found, 1 where a plain phrase stands)."""
    order = word_order(docs, templates)
    place = {w: i for i, w in enumerate(order)}
    sorted_words = [(label, sorted(set(t.split()), key=place.get)) for label, t in templates if t.split()]
    # A document without a prefix word of any template has no block to join.
    prefixes = sorted({w for _, t in sorted_words for w in t[: len(t) - needed(t) + 1]})
    least = min((needed(t) for _, t in sorted_words), default=1)
    parts = _parts(docs)
    size = F.size("parts")
    edge = lambda i: F.when(F.get("parts", i) == "", 1).otherwise(0)
    worth = lambda b: (F.size(b) >= least) & F.arrays_overlap(b, _literal(prefixes))
    d = parts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.greatest(size - edge(F.lit(0)) - edge(size - 1), F.lit(0)).cast("long").alias("n_words"),
        F.when(F.array_contains("parts", "license"), F.filter("parts", lambda w: w != "")).alias("words"),
        F.when(F.arrays_overlap("parts", _literal(prefixes)), F.array_distinct(F.filter(_blocks(order, reach(templates)), worth))).alias("blocks"),
    )

    def places(phrase: str) -> Column:
        ws = phrase.split()
        return F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get("words", i + k) == w, F.lit(False)) for k, w in enumerate(ws)]))

    tokens = lambda b: F.transform(F.array_intersect(_literal(prefixes), b), lambda w: F.struct(b.alias("block"), w.alias("token")))
    d = d.select("row", "doc_id", "n_words", *[F.when(F.col("words").isNotNull(), places(p)).alias(f"at{k}") for k, p in enumerate(PHRASES)], F.flatten(F.transform("blocks", tokens)).alias("tokens"))
    none = F.array().cast("array<int>")
    at = [F.coalesce(f"at{k}", none) for k in range(len(PHRASES))]
    every = F.concat(*at)
    base = F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, PHRASES.values(), strict=True)]))
    told = [F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base")]
    each = d.select("row", "doc_id", "n_words", *told, F.explode_outer("tokens").alias("t"))
    # A document without candidates has a token of its own, so such rows don't meet in one task.
    each = each.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("t.token", F.concat(F.lit("\0"), F.col("row").cast("string"))).alias("token"), "t.block")
    held = each.join(_prefixes(docs, sorted_words), "token", "left").withColumn("held", _containment())
    whole = held.groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").agg(F.max("held").alias("best"), F.collect_set(F.when(F.col("held").isNotNull(), F.col("label"))).alias("more"))
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "more"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).cast("double").alias("score"),
    )
