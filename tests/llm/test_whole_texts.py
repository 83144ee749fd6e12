"""Texts that operators once passed over: wrapped notices, odd secrets, short items."""

import textwrap

import pytest

from tidelog.llm import license_join, qgram_filter, secret_scan


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# "])
@pytest.mark.parametrize("before", [0, 1, 21, 22, 43, 500])
def test_wrapped_notices_are_found(spark, mark, before):
    texts = [(k, "word\n" * before + "\n".join(mark + x for x in textwrap.wrap(t.upper(), 30)) + "\nmore words\n" * 60) for k, (_, t) in enumerate(license_join.TEMPLATES)]
    got = {r["doc_id"]: r for r in license_join.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(license_join.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1, (label, got[k])


def test_words_far_apart_are_no_notice(spark):
    texts = [(k, ("\n" + "x " * 40 + "\n").join(t.split())) for k, (_, t) in enumerate(license_join.TEMPLATES)]
    assert {(r["labels"], r["score"]) for r in license_join.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {("", 0.0)}


LETTERS, MIXED = "qZvWbKxRtYmJcPdLhGnF", "q7ZvW2bKx9RtY4mJcP1d"


@pytest.mark.parametrize(
    ("run", "found"),
    [
        (LETTERS, True), (MIXED, True), (f"sample_key={MIXED}", True), (f"example/{MIXED}", True), (f"dummy/{LETTERS}=", True), (f"key=sample{MIXED}", False),
        ("internationalizationHandlerFactory", False), ("Main/Java/InternationalText", False), ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", False),
    ],
)
def test_odd_secrets_are_found(spark, run, found):
    docs = spark.createDataFrame([(1, f"see {run} here")], "doc_id long, text string")
    assert (":4:" in secret_scan.scan(docs).first()["spans"]) == found
    assert secret_scan.redact(docs).first()["text"] == ("see [REDACTED] here" if found else f"see {run} here")


@pytest.mark.parametrize("long", [[], [(3, "a long item of the benchmark that stands nowhere in the texts")]])
def test_short_items_are_found(spark, long):
    docs = spark.createDataFrame([(1, "x An  Answer, an\nanswer"), (2, "answe"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " an ANSWER "), (2, "é"), (4, " "), *long], "item_id long, text string")
    assert [tuple(r) for r in qgram_filter.leaks(docs, items).collect()] == [(1, 1, 2, 23, 2, 0)]
    assert {r["doc_id"] for r in qgram_filter.without_leaks(docs, items).collect()} == {2, 3, 4}
