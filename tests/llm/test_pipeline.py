"""Each stage of the pipeline against a plain version of it on its own input; odd tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, packing, private, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and its result."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, FOLDER)
        got.write.parquet(f"file://{folder}/{k}")
        got = spark.read.parquet(f"file://{folder}/{k}")
        out.append((docs, got))
        docs = got
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_rules(stages):
    docs, got = stages[0]
    keep = [r for r in docs.collect() if not any(eval(sql, {}, dict(zip(quality.MEASURES, quality.measures_of(r["text"])))) for _, sql in quality.RULES)]
    assert rows(got) == Counter(map(tuple, keep)) and got.columns == docs.columns and 0 < len(keep) < docs.count()


def test_near_duplicates(stages):
    docs, got = stages[1]
    all_ = sorted(docs.collect(), key=lambda r: r["doc_id"])
    sets = []
    for r in all_:
        w = r["text"].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    up = list(range(len(all_)))
    for i in range(len(all_)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    assert rows(got) == Counter(tuple(r) for k, r in enumerate(all_) if up[k] == k) and len(set(up)) < len(all_)


def test_personal_data(stages):
    docs, got = stages[2]
    field, want = private.model(), {}
    for r in docs.collect():
        text, at, parts = r["text"], 0, []
        for s, kind, e in private.spans_of([text], field)[0][1]:
            if s >= at:
                parts += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        want[r["doc_id"]] = "".join([*parts, text[at:]])
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and got.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_source_mixing(stages):
    docs, got = stages[3]
    size = lambda t: len((t or "").split()) + 1
    have, chosen = defaultdict(int), defaultdict(int)
    times = Counter(r["doc_id"] for r in got.collect())
    for r in docs.collect():
        have[r["lang"], r["source"]] += size(r["text"])
    for r in got.collect():
        chosen[r["lang"], r["source"]] += size(r["text"])
    of = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert all(of[r["doc_id"]] == tuple(r) for r in got.collect()) and max(times.values()) <= mixing.MAX_EPOCHS
    plan = docs.select("lang", "source", mixing.domain_of(F.col("source")).alias("domain"), mixing.count_tokens(F.col("text")).alias("n_tokens")).groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    longest = defaultdict(int)
    for r in docs.collect():
        longest[r["lang"], r["source"]] = max(longest[r["lang"], r["source"]], size(r["text"]))
    for r in mixing.budgets(plan, mixing.WEIGHTS, mixing.MAX_EPOCHS, mixing.SHARE_PER_CENT).collect():
        leaf = r["lang"], r["source"]
        assert r["tokens"] == have[leaf] and r["budget"] - longest[leaf] < chosen[leaf] <= r["budget"]
    assert sum(chosen.values()) > 0.5 * sum(have.values()) * mixing.SHARE_PER_CENT / 100


def test_packing(stages):
    docs, got = stages[4]
    size = Counter()
    for r in docs.collect():
        size[r["doc_id"]] += len((r["text"] or "").split()) + 1
    have, bins = Counter(), defaultdict(list)
    for r in got.collect():
        have[r["doc_id"]] += r["n_tokens"]
        bins[r["shard"], r["bin"]].append(r)
    assert have == size
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) + b[0]["residual"] == packing.CAPACITY
        assert len({r["doc_id"] for r in b}) == len(b) and max(Counter(source[r["doc_id"]] for r in b).values()) <= packing.SOURCE_CAP


def test_run_and_odd_tables(spark, tmp_path, stages):
    assert corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece").count() == stages[4][1].count()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").collect() == []
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, "en", "s1", 5), (3, None, "en", "s1", None), (4, "", None, "s1", 0), (5, " ".join(f"v{k}" for k in range(50_000)), "de", "s2", 1)]
    odd = spark.createDataFrame(rows, docs.schema).withColumn("kept", F.lit("x")).withColumn("component_id", F.lit(1))
    odd.write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/odd").count() > 0
