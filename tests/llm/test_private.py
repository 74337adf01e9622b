"""The skip-chain field against enumeration, over many occurrences, and on odd tables."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import private
from tessera.llm.private import LABELS

M = len(LABELS)


@pytest.fixture(scope="module")
def field():
    return private.model()


def marked(field, text):
    return private.spans_of([text], field)[0][1]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 21, 50, 161, 200])
def test_every_occurrence_is_marked(field, n):
    for between in (" and then ", " one two three four five six seven eight nine ten eleven twelve of the long text here "):
        for value, cue, kind in (("5125558005", "phone:", "phone"), ("123456789", "ssn:", "ssn"), ("aa-bb-77-qq", "password:", "secret")):
            text = f"please {cue} {value}" + (between + value) * (n - 1) + " end"
            assert [s[1] for s in marked(field, text)] == [kind] * n, (n, value)
            late = f"so {value}" + (between + value) * (n - 2) + f" my {cue} {value}."
            assert [s[1] for s in marked(field, late)] == [kind] * n, (n, value)


@pytest.mark.parametrize("n", [1, 2, 30, 200])
def test_repeated_plain_numbers_are_not_marked(field, n):
    for value in ("2020", "4179", "5125558005", "7086638319846192"):
        assert marked(field, "so " + " and then ".join([value] * n)) == []
    assert marked(field, "call in " + " and then ".join(["2020"] * n)) == []


def test_kinds(field):
    assert [s[1] for s in marked(field, "password: hunter tango")][0] == "secret"
    assert [s[1] for s in marked(field, "ssn 123-45-6789")] == ["ssn"]
    assert marked(field, "the password is lost and the key of the house") == []


def brute(u, chains, links, trans):
    """Marginals by enumeration of all labellings."""
    n = len(u)
    total = np.zeros((n, M))
    for ys in itertools.product(range(M), repeat=n):
        s = sum(u[k, y] for k, y in enumerate(ys))
        s += sum(np.log(trans[ys[k], ys[k + 1]]) for a, b in chains for k in range(a, b - 1))
        s += sum(w for h, k, w in links if ys[h] == ys[k] > 0)
        for k, y in enumerate(ys):
            total[k, y] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_against_enumeration(field):
    rng = np.random.default_rng(4)
    none = np.zeros(0, np.int64)
    for n in (1, 2, 4):
        u = rng.normal(size=(n, M)) * 2
        got = field.beliefs(u, np.array([0]), np.array([False]), np.array([False]), none, none, np.zeros(0))
        assert np.allclose(got, brute(u, [(0, n)], [], field.trans), atol=1e-9)
    for _ in range(4):  # two chains and a link: no loop, so the messages are exact
        u, w = rng.normal(size=(4, M)) * 2, 2.5
        got = field.beliefs(u, np.array([0, 2]), np.array([False, False]), np.array([False, False]), np.array([1]), np.array([2]), np.array([w]))
        assert np.allclose(got, brute(u, [(0, 2), (2, 4)], [(1, 2, w)], field.trans), atol=1e-4)


def test_unaries_are_the_features(field):
    words = "call me: 5125558005, or token = abc12 x@y.zz (512) 555-0100 the ssn: 123-45-6789 end".split()
    u, _ = field.unaries(field.numbers(words))
    for k in range(len(words)):
        want = sum((field.weights[f] for f in private.features(words, k) if f in field.weights), np.zeros(M))
        assert np.allclose(u[k], want)


def test_words_without_form_are_plain():
    rng = random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("abcdefABCDEF-_.:,zk") for _ in range(rng.randint(1, 40)))
        assert private._FORM.search(w) or private._CUE.get(w.strip(private._STRIP).lower()) or private.shape(w) == private.PLAIN
    for w in ("AKIA" + "ABCD" * 4, "ghp_" + "a" * 30, "sk-" + "a" * 20, "xoxb-" + "a" * 10, "abcdef" * 6):
        assert private.shape(w) != private.PLAIN
        assert [s[1] for s in marked(private.model(), "it is " + w + " ok")] == ["secret"] or w == "abcdef" * 6


def test_runs_of_plain_words_are_exact(field):
    """Looking at words within reach gives what sweeps over whole documents give."""
    rng = random.Random(6)
    none = np.zeros(0, np.int64)
    for _ in range(20):
        words = []
        for _ in range(4):
            words += ["plain"] * rng.randint(0, 60) + rng.choice([["phone:", "5125558005"], ["5551234"], ["x@y.zz"], ["token", "=", "abcd1234"], ["2020"]])
        words += ["plain"] * rng.randint(0, 40)
        ids = field.numbers(words)
        u, _ = field.unaries(ids)
        whole = field.beliefs(u, np.array([0]), np.array([False]), np.array([False]), none, none, np.zeros(0))
        for a, b in field.segments(ids):
            part = field.beliefs(u[a:b], np.array([0]), np.array([a > 0]), np.array([b < len(ids)]), none, none, np.zeros(0))
            assert np.allclose(part, whole[a:b], atol=1e-7)
        covered = {k for a, b in field.segments(ids) for k in range(a, b)}
        assert all(whole[k].argmax() == 0 for k in range(len(words)) if k not in covered)


def test_time_in_proportion(field):
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        _, every = private.spans_of(["a@b.co 5125558005 \n" * n], field)[0]
        took.append(time.process_time() - began)
        assert len(every) >= n
    assert took[1] < 8 * took[0]


def test_odd_tables(spark, field):
    schema = "doc_id long, text string, spans string, n_email int"
    rows = [(1, "phone: 5125558005", "x", 1), (1, "phone: 5125558005", "x", 1), (None, "a@b.co", None, None), (3, None, None, None), (4, "", None, None), (5, "w " * 100_000 + "a@b.co", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in private.personal_data(docs).collect())
    assert got == [(0, "email:0:6"), (1, "phone:7:17"), (1, "phone:7:17"), (3, ""), (4, ""), (5, "email:200000:200006")]
    assert private.personal_data(docs.limit(0)).collect() == [] and private.redact(docs.limit(0)).collect() == []
    masked = private.redact(docs)
    assert masked.columns == docs.columns and masked.where(F.col("text").isNull()).count() == 1
