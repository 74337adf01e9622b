"""Language-model scores: base against brute force, the mixture as a probability, cells against counts, adaptation."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm
from tessera.llm import mixture as M

DOCS = "doc_id long, text string, score string, held_out int"
ODD = [None, "", " \n ", "one", "two words", "x " * 40_000, "é ü  Ünd\ttab", "Ab aB AB"]


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)


def tokens_of(t):
    low = (t or "").translate({k: k + 32 for k in range(65, 91)})
    return [*(w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w), None]


RANK = np.full(256, 2 * M.TOP, np.uint8)
RANK[list(b" etaoinshrdlu\ncbfgjkmpqvwxyz.,")] = range(30)
BITS = 32


def test_base_against_brute_force(spark):
    texts = [*ODD, *[" ".join(words(200, 50 + k % 20)) for k in range(60)]]
    got = {r["doc_id"]: r for r in lm.language_scores(documents(spark, texts)).collect()}
    c, held = Counter(), {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))}
    for k, t in enumerate(texts):
        if not held[k]:
            c.update(tokens_of(t))
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(texts):
        tokens = tokens_of(t)
        assert got[k]["held_out"] == held[k] and got[k]["n_tokens"] == len(tokens) and got[k]["n_known"] == sum(c[x] > 0 for x in tokens) and got[k]["train_tokens"] == n
        assert math.isclose(got[k]["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), rel_tol=1e-9)
        assert got[k]["score"] < 0 and math.isclose(got[k]["bits_per_byte"], -got[k]["score"] * math.log2(10) / len(M.stream_of(t)), rel_tol=1e-9)


def test_odd_tables(spark):
    docs = documents(spark, [])
    assert lm.language_scores(docs).collect() == []
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1]
    alone = spark.createDataFrame([(k, "some text", "", 0) for k in held], DOCS)
    rows = lm.language_scores(alone).collect()
    assert len(rows) == len(held) and {r["train_tokens"] for r in rows} == {0} and all(r["n_known"] == 0 and r["score"] < 0 for r in rows)
    twice = spark.createDataFrame([(2, "same text here", "", 0), (2, "same text here", "", 0), (None, "other", "", 0)], DOCS)
    rows = lm.language_scores(twice).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows if r["doc_id"] == 2}) == 1


def brute_odds(trained):
    """{(context, key, told nibbles): counts of the next nibble}, from texts alone."""
    seen = {}
    for s in trained:
        for k, key, told, v in nibbles_of(s):
            seen.setdefault((k, key, told), Counter())[v] += 1
    return seen


def nibbles_of(s):
    start = 0
    for i, b in enumerate(s):
        inside = s[start:i]
        keys = (inside[-2:], inside[-3:], inside, (b"\0" * 5 + s[:i])[-5:])
        for told, v in M.path(b, RANK):
            for k, key in enumerate(keys):
                yield k, key, told, int(v)
        if b == M.SPACE:
            start = i + 1


def test_shards_return_the_odds_of_all_blocks():
    rng = random.Random(4)
    streams = [M.stream_of(" ".join(rng.choice(["the", "then", "zebra", "é", "a", "io", *words(3, k)]) for _ in range(120))) for k in range(9)]
    roles = [[1, 2, 0], [1, 1, 0], [0, 1, 2]]
    batch = pa.RecordBatch.from_pydict({"block": [0, 1, 2], "roles": roles, "streams": [lm._press(b"".join(streams[3 * k : 3 * k + 3])) for k in range(3)]})
    dealt = pa.Table.from_batches(list(lm._count(RANK, BITS, 3)([batch])))
    groups = {(k, j) for k, j in zip(dealt["kind"].to_pylist(), dealt["shard"].to_pylist())}
    back = pa.concat_tables([lm._shard(BITS)(dealt.filter(pa.compute.and_(pa.compute.equal(dealt["kind"], k), pa.compute.equal(dealt["shard"], j)))) for k, j in sorted(groups)])
    trained = Counter(w for s, r in zip(streams, sum(roles, [])) if r for w in s.split())
    assert sum(back.filter(pa.compute.equal(back["block"], lm._STATS))["shard"].to_pylist()) == len(trained)
    seen = brute_odds([s for s, r in zip(streams, sum(roles, [])) if r == 1])
    for block in range(3):
        texts = lm._Texts(back.filter(pa.compute.equal(back["block"], block)), RANK, BITS)
        assert texts.learned[0] == sum(len(s) for s, r in zip(streams, sum(roles, [])) if r == 2) and len(texts.learned) == 1 + M.start_weights().size + 8 * M.GATES * M.BUCKETS
        for s in streams[3 * block : 3 * block + 3]:
            coded, of, at, across = texts.read([s])
            assert np.append(texts.counts, 0)[of][:-1].tolist() == [trained[w] for w in s.split()]
            got = [M.bits_of(x.take(at)) for x in texts.inside] + [M.bits_of(across)]
            want = [[], [], [], []]
            for k, key, told, v in nibbles_of(s):
                c = seen.get((k, key, told), Counter())
                level = []
                for j in range(4):
                    on = [sum(n for x, n in c.items() if x >> (4 - j) == v >> (4 - j) and x >> (3 - j) & 1 == b) for b in (0, 1)]
                    level.append(round(max(-M.LIMIT, min(M.LIMIT, math.log((on[1] + M.PRIOR) / (on[0] + M.PRIOR)))) * M.SCALE))
                want[k].append(level)
            for k in range(4):
                assert np.abs(got[k].T - np.array(want[k])).max() <= 1  # rounding of halves


def mixer(rng):
    w = (M.start_weights() + rng.normal(size=M.start_weights().shape).astype(np.float32) * 0.01).astype(np.float32)
    return w, M.refinement(rng.integers(0, 50, (2, 4, M.GATES * M.BUCKETS)).astype(float))


def test_probabilities_add_to_one():
    """The probabilities of all first bytes, and of the escapes that spell a byte with a nibble of its own, add to one; whatever the counts and weights."""
    w, apm = mixer(np.random.default_rng(0))
    seen = brute_odds([M.stream_of(" ".join(words(400, 1)) + " the zebra é")])

    def p(b, rank):
        s = bytes([b])
        st, values, path = [[], [], [], []], [], M.path(b, rank)
        for told, v in path:
            values.append(v)
            for k, key in enumerate((b"", b"", b"", b"\0" * 5)):
                c = seen.get((k, key, told), Counter())
                st[k].append(M.odds(np.arange(16, dtype=np.uint64), np.array([c[x] for x in range(16)], np.float32))[v])
        gate = np.arange(len(path), dtype=np.uint8) * M.PLACES
        st = [np.array(x, "<u4") for x in st]
        coded = M.Coded([s], rank)
        assert coded.values.tolist() == values
        return float(np.exp(M.nibble_scores(coded, M.inside(st[:3], gate, w), st[3], gate, w, apm).sum(dtype=np.float64)))

    total = sum(p(b, RANK) for b in range(256))
    for b in range(256):
        if RANK[b] < 2 * M.TOP:  # the four nibbles that would spell it, too
            other = RANK.copy()
            other[b] = 2 * M.TOP
            total += p(b, other)
    assert math.isclose(total, 1, rel_tol=1e-3)


def test_short_texts_are_refined():
    """Texts below one kilobyte that differ from what the weights expect are read better with their own steps than without."""
    rng = np.random.default_rng(3)
    w, apm = M.start_weights(), M.refinement(np.zeros((2, 4, M.GATES * M.BUCKETS)))
    gains = []
    for seed in range(12):
        s = M.stream_of(" ".join(words(230, seed)))
        coded = M.Coded([s], RANK)
        known = M.Words(b"".join(w + b" " for w in dict.fromkeys(s.split())), RANK)
        at = coded.places(known, M.Numbers(known.keys).find(coded.keys))
        good = np.array([[M.SCALE * 2 * (v >> (3 - j) & 1) - M.SCALE for j in range(4)] for v in range(16)], np.int8).view("<u4").ravel()
        noise = rng.integers(-40, 40, (len(coded.values), 4)).astype(np.int8).view("<u4").ravel()
        within = M.inside([np.zeros(len(known.values), "<u4")] * 3, known.gate, w).take(at)
        for across in (good[coded.values], noise):  # a context that is always right, and one that means nothing
            one, none = (M.nibble_scores(coded, within, across, known.gate.take(at), w, apm, adapts).sum() for adapts in (True, False))
            gains.append(one > none)
    assert len(s) < 1000 and all(gains)


def test_strides_are_short():
    at, steps = 0, 0
    while at < 1000:
        at += M.stride(at)
        steps += 1
    assert steps >= 4 and all(M.stride(x) <= max(256, x // 16) for x in (0, 5000, 10**6))


def test_lookup_and_numbers():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 46, 5000, dtype=np.uint64))
    values = rng.integers(0, 1 << 32, len(keys)).astype("<u4")
    of = dict(zip(keys.tolist(), values.tolist()))
    ask = np.concatenate([rng.choice(keys, 600_000), rng.integers(0, 1 << 46, 1000, dtype=np.uint64)])
    assert M.lookup(ask, keys, values, 42).tolist() == [of.get(x, 0) for x in ask.tolist()]
    assert M.lookup(ask[:3], keys[:0], values[:0], 42).tolist() == [0, 0, 0]
    names = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for bits in (42, 60):  # with and without room for the place beside the name
        one, at = np.unique(ask, return_inverse=True)
        assert (M.by_rank(ask, lambda names: np.arange(len(names)), bits) == at).all()
    n = M.Numbers(names)
    assert not n.clash and n.find(names[::-1].copy()).tolist() == list(range(2999, -1, -1)) and M.Numbers(np.append(names, names[:1])).clash


def test_cells_grow_with_the_corpus():
    """Every context of the corpus has cells of its own."""
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (90_000, 8)).astype(np.uint8)
    found = M.Words(b"".join(x.tobytes() + b" " for x in np.unique(letters, axis=0)), RANK)
    prefixes = {x[:k].tobytes() for x in letters for k in range(9)}
    assert len(prefixes) > 1 << 18
    first = found.gate < M.PLACES
    slots = np.unique(found.names(2, M.hash_bits(1 << 26))[first] >> np.uint64(4))
    assert abs(len(slots) - len(prefixes)) < 0.002 * len(prefixes)


def test_repeated_documents_score_apart(spark):
    """A held-out text that training has too is more probable a byte than one that it hasn't."""
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 1]
    taught = [k for k in range(400) if k not in held]
    same, alone = held[:20], held[20:40]
    texts = {k: " ".join(words(150, 1000 + k)) for k in [*taught, *alone]}
    for a, b in zip(same, taught):
        texts[a] = texts[b]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.language_scores(spark.createDataFrame([(k, t, "", 0) for k, t in texts.items()], DOCS)).collect()}
    assert np.mean([got[k] for k in same]) < np.mean([got[k] for k in alone])


def counted(batch):
    """What a block deals, by kind and shard."""
    return {(r["kind"], r["shard"]): (r["a"], r["b"]) for x in lm._count(RANK, BITS, 2)([batch]) for r in x.to_pylist()}


def test_a_block_takes_bounded_memory():
    """Counting a block and making its texts ready take a small multiple of the letters of its distinct words, so two at a time fit in an executor."""
    letters = np.random.default_rng(7).integers(97, 123, (120_000, 12)).astype(np.uint8)
    letters[:, -1] = M.SPACE
    raw = letters.tobytes()
    streams = [raw[k : k + 1200] + b"\n" for k in range(0, len(raw), 1200)]
    batch = pa.RecordBatch.from_pydict({"block": [0], "roles": [[1] * (len(streams) - 1) + [2]], "streams": [lm._press(b"".join(streams))]})
    M._powers(1 << 18)
    tracemalloc.start()
    try:
        dealt = pa.Table.from_batches(list(lm._count(RANK, BITS, 2)([batch])))
        counting = tracemalloc.get_traced_memory()[1]
        kind, shard = dealt["kind"].to_pylist(), dealt["shard"].to_pylist()
        back = pa.concat_tables([lm._shard(BITS)(dealt.filter(pa.compute.and_(pa.compute.equal(dealt["kind"], k), pa.compute.equal(dealt["shard"], j)))) for k, j in sorted(set(zip(kind, shard)))])
        back = back.filter(pa.compute.equal(back["block"], 0))
        tracemalloc.reset_peak()
        lm._Texts(back, RANK, BITS)
        reading = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counting < 80 * len(raw) and reading < 110 * len(raw), (counting / len(raw), reading / len(raw))


def test_pieces_of_words_change_nothing(monkeypatch):
    """Words longer than a piece, words at its edge, bytes of several nibbles, and none at all."""
    texts = [" ".join(words(300, 2)) + " é ü zebra " + "x" * 500 + " ~ " + "yz" * 40, "", "a", " b" * 50]
    batch = pa.RecordBatch.from_pydict({"block": [0], "roles": [[1, 2, 1, 0]], "streams": [lm._press(b"".join(map(M.stream_of, texts)))]})
    raw = b"".join(w + b" " for w in dict.fromkeys(" ".join(texts).encode().split()))
    found = []
    for piece in (1 << 18, 64, 1):
        monkeypatch.setattr(M, "_PIECE", piece)
        of = M.Words(raw, RANK)
        found.append(([of.names(k, BITS).tolist() for k in range(M.INSIDE)], of.keys.tolist(), of.starts.tolist(), of.gate.tolist(), of.values.tolist(), counted(batch)))
        assert len(M.Words(b"", RANK).keys) == 1
    assert found[0] == found[1] == found[2]


def test_sums_of_cells():
    """Counts that fit beside a name and those that don't."""
    rng = np.random.default_rng(9)
    for bits, most in ((33, 1000), (56, 1000), (33, 1 << 31)):
        names = [rng.integers(0, 1 << 12, n, dtype=np.uint64) for n in (500, 0, 300)]
        counts = [rng.integers(0, most, len(x)).astype(np.uint32) for x in names]
        want = Counter()
        for x, n in zip(names, counts):
            for a, b in zip(x.tolist(), n.tolist()):
                want[a] += b
        name, n = lm._added(names.copy(), counts.copy(), bits)
        assert name.tolist() == sorted(want) and n.tolist() == [want[x] for x in sorted(want)]
    assert [len(x) for x in lm._added([], [], 33)] == [0, 0]
