"""Label model on votes with known rates, voters of both signs, scores against a plain sum, odd tables."""

import math
import zlib

import numpy as np
import pandas as pd

from tessera.llm import toxic


def test_label_model_recovers_rates_and_is_not_the_given_label():
    rng = np.random.default_rng(0)
    n = 4000
    truth = (rng.random(n) < 0.3).astype(int)
    fires = np.array([[0.05, 0.6], [0.03, 0.5], [0.04, 0.4], [0.5, 0.1]])  # of clean and toxic rows
    votes = np.stack([(rng.random(n) < f[truth]) * (1 if f[1] > f[0] else -1) for f in fires], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1).astype(np.int8)  # a copy of the first voter
    given = np.where(rng.random(n) < 0.05, 1 - truth, truth)  # labels with errors
    post, said = toxic.label_model(votes, given)
    assert said["parents"][4] == 0 or said["parents"][0] == 4  # the copy counts once
    assert np.abs(said["votes"][1, :3, 2] - fires[:3, 1]).max() < 0.08 and abs(said["votes"][0, 3, 0] - 0.5) < 0.08
    wrong = given != truth
    assert ((post >= 0.5) == truth)[wrong].mean() > 0.6  # the votes, not the label, decide
    alone, _ = toxic.label_model(votes[:, :4], given)
    assert np.abs(post - alone).mean() < 0.02


def test_voters_of_both_signs():
    entries = pd.DataFrame([("=bad", 90, 0), ("bad", 90, 1), ("=nice", 2, 900), ("=word", 100, 1000)], columns=["entry", "toxic", "clean"])
    words, voters = toxic.lexicon(entries, 200, 2000)
    assert voters == ["=bad"] and set(words) == set(entries["entry"])
    assert toxic.clean_lexicon(entries, 200, 2000) == ["=nice"]
    bits = np.array([1 << 4] * 20 + [1 << 7] * 300 + [0] * 700)
    y = np.array([1] * 20 + [0] * 300 + [0] * 500 + [1] * 200)
    assert toxic.pattern_votes(bits, y) == [(4, 1), (7, -1)]


def test_entries():
    got = toxic.entries_of(toxic.words_of("Badder, BADDIE badly! ok"))
    assert got == {"=badder", "=baddie", "=badly", "=ok", "badd", "badde", "badder", "baddi", "baddie", "badl", "badly", "2:badd"}
    assert toxic.entries_of(toxic.words_of(None)) == toxic.entries_of(toxic.words_of(" ,. ")) == set()


def test_scores_are_the_plain_sum(spark):
    weights, bias = {"=bad": 2.0, "2:badd": 1.5, "good": -3.0}, -1.0
    texts = [None, "", "bad", "Bad baddie baddest", "goodness", "x " * 100_000]
    docs = spark.createDataFrame([(k, t, 0, 1.0) for k, t in enumerate(texts)] + [(2, "bad", 0, 1.0), (None, "bad", 1, 0.0)], "doc_id long, text string, held_out int, score double")
    got = toxic.score(docs, weights, bias).collect()
    assert len(got) == 8
    for r in got:
        t = "bad" if r["doc_id"] is None else texts[r["doc_id"]]
        z = bias + sum(weights.get(e, 0.0) for e in toxic.entries_of(toxic.words_of(t)))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-12) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1)
    assert toxic.score(docs.limit(0), weights, bias).collect() == []


def test_result_does_not_depend_on_partitions(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    one, many = (toxic.train(docs.repartition(k), labels.repartition(k)) for k in (1, 9))
    assert set(one[0]) == set(many[0]) and one[2]["voters"] == many[2]["voters"] and all(math.isclose(one[0][e], many[0][e], abs_tol=1e-6) for e in one[0])
    assert {-1, 1} == set(one[2]["signs"]) and min(one[2]["fired"]) > 0
    again = toxic.train(docs, labels.unionByName(labels))
    assert again[2]["voters"] == one[2]["voters"]
