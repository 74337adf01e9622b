"""Best fit against a plain search on random rows; pieces, hot groups and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dup, packing


def plain(items, capacity, cap):
    """The tightest open bin that holds a piece without its cluster and with fewer than cap of its source; of equally tight ones the one that came to that residual first."""
    bins, out, clock = [], [None] * len(items), 0
    for k in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, cluster, source = items[k]
        fits = [(b["left"], b["since"], n) for n, b in enumerate(bins) if b["left"] >= size and cluster not in b["clusters"] and b["sources"].count(source) < cap]
        if fits:
            n = min(fits)[2]
        else:
            n = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": [], "since": 0})
        b = bins[n]
        out[k] = (n, capacity - b["left"])
        clock += 1
        b["left"] -= size
        b["since"] = clock
        b["clusters"].add(cluster)
        b["sources"].append(source)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_a_plain_search(seed):
    rng = random.Random(seed)
    capacity, cap = rng.choice([10, 50, 100]), rng.choice([1, 2, 6])
    items = [(rng.randint(1, capacity), rng.randrange(rng.choice([2, 30])), rng.randrange(rng.choice([1, 5]))) for _ in range(rng.randint(1, 250))]
    assert packing.pack(items, capacity, cap) == plain(items, capacity, cap)


SIZED = "doc_id long, source string, n_tokens long, cluster long"


def test_pieces_of_long_documents_have_bins(spark):
    rows = [(1, "a", 250, 1), (2, "a", 100, 2), (3, "b", 50, 3), (4, None, 0, 4), (5, "c", None, 5), (6, "a", 60, 6)]
    got = packing.best_fit(spark.createDataFrame(rows, SIZED), capacity=100).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"], r["bin"] is not None))
    assert sorted(of[1]) == [(0, 100, True), (1, 100, True), (2, 50, True)] and of[2] == [(0, 100, True)] and of[4] == of[5] == [(0, 0, False)]
    bins = {}
    for r in got:
        if r["bin"] is not None:
            bins.setdefault((r["shard"], r["bin"]), []).append(r)
    assert sum(len(b) == 1 and b[0]["n_tokens"] == 100 and b[0]["residual"] == 0 for b in bins.values()) == 3
    assert all(sum(r["n_tokens"] for r in b) + b[0]["residual"] == 100 for b in bins.values())


def test_repeated_rows_are_spread_and_kept_apart(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.lit(1).cast("long").alias("cluster"))
    got = packing.best_fit(rows, capacity=100, shard_rows=500)
    assert got.count() == 3000 and got.groupBy("shard", "bin").count().where("count > 1").count() == 0
    per = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(per) == 6 and max(per) < 1000


def test_clusters_of_near_copies(spark):
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, base, "a", 1), (2, base + " end", "a", 1), (3, None, "b", 1), (4, "x " * 20, None, 1), (5, "long " * 30_000, "c", 1)], "doc_id long, text string, source string, n_tokens int")
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.sized(docs).collect()}
    assert sizes == {1: 61, 2: 62, 3: 1, 4: 21, 5: 30_001}
    own = packing.best_fit(packing.sized(docs)).where("doc_id < 3").select("shard", "bin").distinct().count()
    apart = packing.best_fit(packing.sized(docs, clusters=near_dup.near_duplicates(docs))).where("doc_id < 3").select("shard", "bin").distinct().count()
    assert own == 1 and apart == 2
    assert packing.best_fit(packing.sized(docs.limit(0))).collect() == []
