"""Secret scan: known shapes and sliding-window Shannon entropy, all in SQL functions.

Known shapes are regular expressions with a least length. Besides, every run of at least ``WINDOW``
characters that secrets are made of, with a digit or letters of both cases among them, is a candidate: a window slides over it,
the count of each character goes up where one enters and down where one leaves, and the entropy follows
from the change of the two counts. A candidate whose largest entropy reaches its character class's
threshold is a span, unless the allow-list (identifiers with a known shape, examples, alphabets in
order) suppresses it; examples and alphabets count only in the key part of a run. Letters of both cases
are an identifier only if they look like words (fooBar, Foo_Bar, FOO), as a few random keys do too. Known shapes are never suppressed.

Places are code points. Spark has no function for the places of all matches, so they are summed up
from the lengths of the matches and of what lies between them.

Input columns ``doc_id`` and ``text``; others are ignored. A null or empty text has no spans; repeated
rows each give a row; a null doc_id stays null; an empty table gives no rows. Every row is scanned by
itself, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm._shared import apart

#: Shapes: kind, expression, group that counts, its least length (fixed values). Access and hex runs that
#: are too short are left out by the expression itself, which finds the same long ones, as a run that
#: fails holds no other match; a short value after assign may hold the next key, so it is dropped later.
SHAPES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Cheap tests that a text with a match passes.
MAYBE = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA", "hex": r"[0-9a-f]{32}"}
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])|(?=[a-z+/_=-]*[A-Z])(?=[A-Z+/_=-]*[a-z]))[A-Za-z0-9+/_=-]{20,}"
#: Character classes, the first that a candidate belongs to, and the bits from which it is a secret.
CLASSES = [("entropy-hex", r"^[0-9a-fA-F]+$", 3.0), ("entropy-alnum", r"^[A-Za-z0-9]+$", 3.6), ("entropy-base64", r"^[A-Za-z0-9+/_=-]+$", 3.8)]
#: Whole runs with a known shape, and what marks an example or an alphabet.
_UNLIKE_WORDS = r"[a-z][A-Z](?![a-z])|[A-Z]{2}[a-z]|[A-Z][a-z][A-Z]"
SHAPED = rf"^[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$|^[0-9/_=-]+$|^(?!.*(?:{_UNLIKE_WORDS}))[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{{0,4}}$"
MARKED = r"(?i:example|dummy|sample|0123456789|abcdefghij)"
ALLOWED = f"{SHAPED}|{MARKED}"
KINDS = [*(k for k, *_ in SHAPES), *(k for k, *_ in CLASSES)]
MARK = "[REDACTED]"
_SPAN = "struct<start:int,kind:int,end:int,size:int>"
#: Characters of a long candidate that are cut out at a time, and whose windows are gone through at a time.
CUT, STRETCH = 1 << 17, 1 << 11
#: Counts of a window's characters lie in 64-bit words, so many to a word, so many bits each.
PER_WORD, COUNT_BITS = 12, 5


def _bound(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(rows: Column) -> tuple[Column, Column]:
    """Where chunks of an array start, counted from 0, and how long they are: about as many as each has rows."""
    size = F.ceil(F.sqrt(F.greatest(F.size(rows), F.lit(1)))).cast("int")
    return F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1, size)).otherwise(F.array().cast("array<int>")), size


def _running(rows: Column, emit, advance, kind: str) -> Column:
    """emit(at, row) for each row, ``at`` going from 0 to advance(at, row) behind it. Rows are taken by chunks,
    since an append copies its array: n rows cost n ** 1.5 copied references, not n ** 2."""

    def chunk(acc: Column, mine: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        got = F.aggregate(mine, zero, lambda a, row: F.struct(advance(a["at"], row).alias("at"), F.array_append(a["out"], emit(a["at"], row)).alias("out")))
        return _bound(got, lambda g: F.struct(g["at"].alias("at"), F.array_append(acc["out"], g["out"]).alias("out")))

    def every(rows: Column) -> Column:
        starts, size = _chunks(rows)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(starts, zero, lambda acc, i: chunk(acc, F.slice(rows, i + 1, size)))["out"])

    return _bound(rows, every)


def _spans(pieces: Column, hits: Column, sizes: Column, kind: int) -> Column:
    """Places of matches, from what lies between them and how long they are."""
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("hit")))
    rows = F.zip_with(lengths, sizes, lambda x, size: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), size.alias("size")))

    def emit(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["hit"]).alias("end"), x["size"].alias("size"))

    return F.when(F.size(hits) > 0, _running(rows, emit, lambda at, x: at + x["gap"] + x["hit"], _SPAN))


def _pieces(text: Column, size: int) -> Column:
    """Stretches of a text that overlap by a window less one character."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(text, i + 1, F.lit(size + WINDOW - 1)))


def largest_entropy(text: Column) -> Column:
    """The largest entropy, in bits, of WINDOW characters in a row. Long candidates are gone through by stretches,
    so that few characters are held apart at a time."""
    return F.array_max(F.transform(_pieces(text, CUT), lambda cut: F.array_max(F.transform(_pieces(cut, STRETCH), _slide))))


def _slide(text: Column) -> Column:
    """The largest entropy of a stretch, by incremental counts."""
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    words = -(-len(ALPHABET) // PER_WORD)
    ones = F.array(*[F.lit(1 << COUNT_BITS * (k % PER_WORD)).cast("long") for k in range(len(ALPHABET))])
    chars = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    chars = F.filter(chars, lambda k: k >= 0)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("in"))

    def count(n: Column, c: Column) -> Column:
        shift = (c % PER_WORD * COUNT_BITS).cast("int")
        word = F.get(n, F.floor(c / PER_WORD).cast("int"))
        return F.call_function("shiftright", word, shift).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(acc: Column, c: Column) -> Column:
        full = F.size(acc["in"]) == WINDOW
        gone = F.when(full, F.get(acc["in"], F.lit(0))).otherwise(-1)
        n_in, n_out = count(acc["n"], c), count(acc["n"], gone)
        total = acc["sum"] + F.when(gone == c, 0.0).otherwise(F.get(cost, n_in + 1) - F.get(cost, n_in) + F.when(full, F.get(cost, n_out - 1) - F.get(cost, n_out)).otherwise(0.0))
        up, down = F.floor(c / PER_WORD), F.when(full, F.floor(gone / PER_WORD)).otherwise(-1)
        counts = F.transform(acc["n"], lambda v, k: v + F.when(k == up, F.get(ones, c)).otherwise(0) - F.when(k == down, F.get(ones, gone)).otherwise(0))
        held = F.array_append(F.when(full, F.slice(acc["in"], 2, WINDOW - 1)).otherwise(acc["in"]), c)
        bits = F.when(F.size(acc["in"]) >= WINDOW - 1, math.log2(WINDOW) - total / WINDOW).otherwise(0.0)
        return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"), held.alias("in"))

    return F.aggregate(chars, zero, step)["best"]


def _allowed(text: Column) -> Column:
    """Whether the allow-list suppresses a run: as a whole by its shape, or by a mark in its key part. That is
    what follows the last = but padding and, of it, the parts between slashes as long as a window or, if
    there is none, the longest; each of these must be marked."""
    value = F.regexp_extract(text, "([^=]*)=*$", 1)
    pieces = F.split(value, "/")
    most = F.least(F.array_max(F.transform(pieces, F.length)), F.lit(WINDOW))
    marked = F.forall(F.filter(pieces, lambda p: F.length(p) >= most), lambda p: p.rlike(MARKED))
    return text.rlike(SHAPED) | (text.rlike(MARKED) & marked)


def _kind(text: Column) -> Column:
    """Number of the kind of a candidate's character class where its entropy reaches the threshold."""
    out = F.when(_allowed(text), -1)
    for k, (_, pattern, bits) in enumerate(CLASSES):
        out = out.when(text.rlike(pattern), F.when(largest_entropy(text) >= bits, len(SHAPES) + k).otherwise(-1))
    return out.otherwise(-1)


def _at_least(size: int):
    return lambda span: span["size"] >= size


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def with_spans(docs: DataFrame, name: str = "__spans") -> DataFrame:
    """All columns and the spans, ordered by place and kind: structs of start, kind, end, size."""
    text, tag = F.coalesce("text", F.lit("")), apart([*docs.columns, name])
    cols = {}
    for kind, pattern, group, _ in SHAPES:
        p, maybe = F.lit(pattern), text.rlike(MAYBE[kind])
        cols[f"{tag}p_{kind}"] = F.when(maybe, F.split(text, pattern, -1))
        cols[f"{tag}h_{kind}"] = F.when(maybe, F.regexp_extract_all(text, p, F.lit(0)))
        cols[f"{tag}g_{kind}"] = F.when(maybe, F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length))
    maybe = text.rlike(CANDIDATE)
    cols[f"{tag}p_e"] = F.when(maybe, F.split(text, CANDIDATE, -1))
    cols[f"{tag}h_e"] = F.when(maybe, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    d = docs.withColumns(cols)
    # A candidate's kind takes the place of its size until the spans are made.
    d = d.withColumn(f"{tag}k_e", F.transform(f"{tag}h_e", _kind))
    none = F.array().cast(f"array<{_SPAN}>")
    found = [F.filter(F.coalesce(_spans(F.col(f"{tag}p_{kind}"), F.col(f"{tag}h_{kind}"), F.col(f"{tag}g_{kind}"), k), none), _at_least(least)) for k, (kind, _, _, least) in enumerate(SHAPES)]
    raw = F.filter(F.coalesce(_spans(F.col(f"{tag}p_e"), F.col(f"{tag}h_e"), F.col(f"{tag}k_e"), -1), none), lambda s: s["size"] >= 0)
    found.append(F.transform(raw, lambda s: F.struct(s["start"].alias("start"), s["size"].alias("kind"), s["end"].alias("end"), s["size"].alias("size"))))
    return d.withColumn(name, F.array_sort(F.concat(*found))).drop(*cols, f"{tag}k_e")


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = with_spans(docs.select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["kind"] < len(SHAPES))
    counts = [F.size(F.filter("__spans", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(SHAPES)]
    return d.select("doc_id", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, every span replaced by a mark, and n_chars (if there is one) set anew."""
    name = f"{apart(docs.columns)}spans"
    d = with_spans(docs, name)
    # What stays: from the end of all spans before to the start of one that they do not reach, and the rest.
    emit = lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("a"), s["start"].alias("b")))
    between = F.array_compact(_running(F.col(name), emit, lambda at, s: F.greatest(at, s["end"]), "struct<a:int,b:int>"))
    rest = F.struct(F.array_max(F.transform(name, lambda s: s["end"])).alias("a"), F.length("text").alias("b"))

    def cut(stays: Column) -> Column:
        """The pieces that stay, cut from chunks of the text, as a cut reads what it cuts from."""
        starts, size = _chunks(stays)

        def of_chunk(i: Column) -> Column:
            def pieces(mine: Column) -> Column:
                base = F.get(mine, F.lit(0))["a"]
                part = F.substring(F.col("text"), base + 1, F.element_at(mine, -1)["b"] - base)
                return _bound(part, lambda t: F.transform(mine, lambda s: F.substring(t, s["a"] - base + 1, s["b"] - s["a"])))

            return _bound(F.slice(stays, i + 1, size), pieces)

        return F.array_join(F.flatten(F.transform(starts, of_chunk)), MARK)

    folded = _bound(F.array_append(between, rest), cut)
    d = d.withColumn("text", F.when(F.size(name) > 0, folded).otherwise(F.col("text"))).drop(name)
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else d
