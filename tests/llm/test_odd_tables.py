"""Licences, quality rules and mixing on empty tables, long texts, ties, repeated rows and clashing columns."""

from pyspark.sql import functions as F

from tessera.llm import licences, mixing, quality

LONG = "filler words of a long text\n" * 40_000


def test_licences(spark):
    schema = "doc_id long, path string, text string, licence string, score double, row long"
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    rows = [
        (1, "a/x", mit, "x", 0.0, 1),
        (1, "a/x", mit, "x", 0.0, 1),
        (2, "a/y", None, "x", 0.0, 1),
        (3, "b/LICENSE", f"{mit}\n{apache}", None, None, None),
        (4, "b/z", "", None, None, None),
        (None, None, mit, None, None, None),
        (6, "c/long", LONG + apache, None, None, None),
    ]
    files = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["licence"], r["via"]) for r in licences.scan(files).collect())
    tied = "Apache-2.0" if [g for g in got if g[0] == 3][0][1] == "Apache-2.0" else "MIT"
    assert got == [(0, "MIT", "direct"), (1, "MIT", "direct"), (1, "MIT", "direct"), (2, "MIT", "inherited"), (3, tied, "direct"), (4, tied, "inherited"), (6, "Apache-2.0", "direct")]
    assert licences.scan(files.limit(0)).collect() == []


def test_equal_lines_tie_by_name(spark):
    both = [("MIT License", "MIT"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0")]
    rows = [(k, f"d{k}/f", t) for k, (t, _) in enumerate(both)]
    got = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == "MPL-2.0" and got[0] in ("MIT", None)


def test_quality(spark):
    schema = "doc_id long, text string, failed string, n_words int"
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, "x", 0), (1, good, "x", 0), (None, good, None, None), (3, None, None, None), (4, "", None, None), (5, LONG, None, None)]
    docs = spark.createDataFrame(rows, schema)
    book = quality.ledger(docs.select("doc_id", "text"))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["failed"] == 0) for r in book.collect()) == [(0, 60, True), (1, 60, True), (1, 60, True), (3, 0, False), (4, 0, False), (5, 240_000, False)]
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 3 and quality.keep(docs.limit(0)).collect() == []
    said = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(book).collect()}
    assert said["too_short"] == (2, 2) and said["repeated_words"][0] == 1
    assert quality.ablations(book.limit(0)).collect() == []


def test_mixing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, epoch string, budget int"
    rows = [(k % 7, f"text {k % 3}", None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", 1, "x", 2) for k in range(60)] + [(None, None, "en", "s1", None, None, None), (90, LONG, "de", "s2", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.choose(docs)
    assert got.columns == docs.columns and got.count() > 0 and mixing.choose(docs.limit(0)).collect() == []
    assert got.exceptAll(docs.unionAll(docs)).count() == 0  # a row at most twice
    again = mixing.choose(docs.orderBy(F.desc("doc_id")))
    assert got.exceptAll(again).count() == again.exceptAll(got).count() == 0  # whatever the order of rows
