"""The operators on hand-made rows, against brute force, and on the small tables against their SQL."""

import glob
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalogue, html_text, licences, mixing, near_dup, private, quality, toxic, vector_dup

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t or ""), "x", "y") for k, t in enumerate(texts)], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(n)]


ODD = [None, "", " \n ", "one", "two words", " ".join(words(300, 1)), " ".join(words(300, 1)), " ".join(words(30_000, 2))]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = con.execute(catalogue.oracle_sql()[name]).df(), catalogue.queries()[name](spark, FOLDER).toPandas()
    c = sorted(want.columns)
    flat = lambda df: df[c].astype(str).sort_values(c).reset_index(drop=True)
    assert c == sorted(got.columns) and flat(got).equals(flat(want))


# quality rules
def test_quality(spark):
    book = {r["doc_id"]: r for r in quality.ledger(documents(spark, [*ODD, "a b c d a b c x", "é#\nx\nx\n\n y"])).collect()}
    assert book[0]["n_words"] == 0 and book[8]["n_repeat_words"] == 6 and book[9]["n_dup_lines"] == 1 and book[9]["n_symbols"] == 1 and book[9]["word_chars"] == 5
    kept = quality.keep(documents(spark, ODD))
    assert kept.columns == documents(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {5, 6, 7}
    ab = {r["rule"]: r for r in quality.ablations(quality.ledger(documents(spark, ODD))).collect()}
    assert ab["too_short"]["n_only"] >= 1 and quality.ledger(documents(spark, [])).count() == 0


# near duplicates
def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:])))
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return sets, up


def test_near_duplicates(spark):
    rng, texts = random.Random(3), list(ODD)
    for g in range(6):
        base = words(120, 100 + g)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(40))
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
            if rng.random() < 0.3:
                base = w
    sets, want = brute(texts)
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    kept = near_dup.drop_near_duplicates(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == docs.columns and kept.count() == len(set(want)) + 1
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


# vectors
def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(20):
            rows.append((k, (centre + rng.normal(size=16) * 0.09).tolist(), c % 3))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, None, 1), (k + 3, [0.0] * 16, 1), (k + 4, [float("nan")] * 16, 1), (k + 5, rows[0][1], None), (k + 6, [1.0, None], 1), (k + 7, [], 0), (k + 8, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = Counter(), {i: i for i, _, _ in rows}
    for a, x, y in good:
        for b, z, u in good:
            if a < b and y == u and len(x) == len(z) and float(x @ z) >= 0.93:
                links[a] += 1
                links[b] += 1
                ra, rb = up[a], up[b]
                up = {i: min(ra, rb) if r in (ra, rb) else r for i, r in up.items()}
    assert sum(links.values()) > 100
    assert {i: got[i]["n_links"] for i in up} == {i: links[i] for i in up}
    assert {i: got[i]["component_id"] for i in up} == up
    assert vector_dup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# personal data
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and private.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_patterns_match_plain_expressions():
    rng = random.Random(9)
    pieces = ["a@b.c", "@b.c", "x.y@d", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", " ", ".", "-", "+1 (212) 555-0100", "+", "12", "é", "@", "\n", "0001.2.3.4.5", "a"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert private.base_spans(t) == plain_spans(t), t


def test_personal_data(spark):
    texts = [None, "", "phone: 5125558005 and again 5125558005 in 2020", "in 2020 we had 4179 items, version 3.", "password=e3b3ed3cc8548923d6 x@y.org"]
    got = {r["doc_id"]: r for r in private.personal_data(documents(spark, texts)).collect()}
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["spans"] == "" and got[3]["spans"] == ""
    assert got[2]["spans"] == "phone:7:17,phone:28:38"  # the second has no cue of its own
    masked = {r["doc_id"]: r for r in private.redact(documents(spark, texts)).collect()}
    assert masked[4]["text"] == "[SECRET] [EMAIL]" and masked[4]["n_chars"] == 16 and masked[0]["text"] is None


# web pages
def test_pages(spark):
    page = '<html><head><title>no</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>A  title</h1><p>First &amp; <b>best</b><br>line of the text, long enough.<script>var x="</p>";</script></p><p>Second paragraph of text here.</p></article><section id="comments"><p>Nice read!</p></section><aside>Related posts</aside><form><p>Your name</p></form><footer>&copy; me</footer>'
    rows = [(0, "u", None), (1, "u", ""), (2, "u", page), (3, "u", "<p"), (4, "u", "x < y"), (5, "u", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["text"] == "A title\nFirst & best line of the text, long enough.\nSecond paragraph of text here."
    assert got[0]["text"] == got[1]["text"] == "" and got[2]["n_chars"] == len(got[2]["text"])


def test_embedded_elements_keep_the_rest_of_the_page():
    first, last = "The first paragraph has a full sentence of text.", "The last paragraph has one more sentence, too."
    for mark in ('<svg class="icon"/>', "<math/>", "<select>", "<object>", "<noscript>", "<video>", "<canvas>", '<svg viewBox="0 0 1 1"><path d="M0 0"/></svg>'):
        found = [b[0] for b in html_text.blocks(f"<article><p>{first}</p>{mark}<p>{last}</p></article>")]
        assert found == [first, last], mark
    inside = "<math><mi>E</mi><mo>=</mo><mi>m</mi></math>"
    assert [b[0] for b in html_text.blocks(f"<article><p>Here {inside} holds.</p></article>")] == ["Here E=m holds."]
    held = "<article><p>One.</p><noscript><p>Text for readers without scripts.</p></noscript><script>var x;</article>"
    assert [b[0] for b in html_text.blocks(held)] == ["One.", "Text for readers without scripts."]


def test_block_labels_held_out():
    weights, chain = html_text.model()
    wrong = total = 0
    for page, labels in html_text.labelled_pages(80, seed=77):
        found = html_text.blocks(page)
        guess = html_text.crf.viterbi_two([sum(weights.get(f, 0.0) for f in fs) for fs in html_text.features(found)], chain)
        wrong, total = wrong + sum(a != b for a, b in zip(guess, labels)), total + len(labels)
    assert wrong / total < 0.02


# toxicity
def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights, bias, said = toxic.train(docs, labels)
    assert all(not e.startswith("=src") for e in weights) and len(said["parents"]) > 5
    got = toxic.score(docs, weights, bias).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.5
    assert toxic.train(docs, labels.limit(0))[0] == {} and toxic.score(documents(spark, ODD), weights, bias).count() == len(ODD)


def test_entries_are_counted_over_all_partitions(spark):
    """Clean rows count for an entry also where no toxic row of their partition has it."""
    texts = [("common awful", 1)] + [("common", 0)] * 7 + [("rare", 0)]
    want = {"=common": (1, 7), "=awful": (1, 0), "=rare": (0, 1)}
    for parts in (1, 9):
        rows = spark.createDataFrame(spark.sparkContext.parallelize(texts, parts), "__t string, __y int")
        found = rows.mapInArrow(toxic._counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()
        assert {r["entry"]: (r["t"], r["c"]) for r in found if r["entry"][0] == "="} == want


# mixing
def test_water_filling(spark):
    rows = [(k, lang, src, 10, "") for k, (lang, src) in enumerate([("en", "a0")] * 5 + [("en", "b0")] * 50 + [("de", "a0")] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_tokens long, salt string")
    leaves = {(r["lang"], r["source"]): r["budget"] for r in mixing.plan(df.withColumn("domain", F.lit("d0")), {"lang": {"en": 1, "de": 1}}, 1, 60).collect()}
    assert leaves == {("en", "a0"): 50, ("en", "b0"): 265, ("de", "a0"): 315}  # the shortage of a0 goes to its sibling
    got = mixing.select(df, {"lang": {"en": 1, "de": 1}}, 1, 60).groupBy("lang", "source").agg(F.sum("n_tokens")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("en", "a0"): 50, ("en", "b0"): 260, ("de", "a0"): 310}
    chosen = mixing.choose(documents(spark, ODD))
    assert chosen.columns == documents(spark, []).columns and mixing.choose(documents(spark, [])).count() == 0


# licences
def test_licences(spark):
    rows = [(1, "a/LICENSE", "The MIT License (MIT)"), (2, "a/b/x.c", "int x;"), (3, "a/b/y.c", "code\nLicensed under the Apache License, Version 2.0."), (4, "c/z.c", "none"), (5, None, None), (6, "top", "")]
    got = {r["doc_id"]: (r["licence"], r["via"], r["from_dir"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "direct", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "direct", None), 4: (None, "none", None), 5: (None, "none", None), 6: (None, "none", None)}
