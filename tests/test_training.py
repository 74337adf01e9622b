"""Training runs, bundles, contributions, text blocks, clusters against brute force, and the command line's parser."""

import dataclasses
import datetime as dt
import difflib
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.__main__ import parser
from tessera.functions import columns as C
from tessera.operators import explain, metrics, model, resolve, training
from tessera.plans.components import connected_components, stars_of
from tessera.plans.scratch import materialise, remove, scratch_dir
from tessera.sources import files

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    leads, messages, calls, stages = [], [], [], []
    for k in range(240):
        t = T0 + dt.timedelta(hours=12 * k)
        hot = rng.random() < 0.5
        leads.append((f"L{k:03d}", t, rng.choice(["web", "walk-in"]), rng.choice(["b1", "b2"]), rng.randint(18, 50)))
        for m in range(rng.randint(2, 5) if hot else rng.randint(0, 1)):
            messages.append((f"m{k}-{m}", f"L{k:03d}", t + dt.timedelta(minutes=7 * m + 1), "inbound", "lead", "what is the fee " + rng.choice(["today", "and emi", "for weekend batch"])))
        calls.append((f"L{k:03d}", t + dt.timedelta(hours=rng.randint(1, 30)), 60, rng.choice(["answered", "busy"])))
        if hot and rng.random() < 0.8 or rng.random() < 0.1:
            stages.append((f"L{k:03d}", "Admission Done", t + dt.timedelta(days=5)))
    return (
        spark.createDataFrame(leads, "lead_id string, created_at timestamp, source string, branch string, age int"),
        spark.createDataFrame(messages, "message_id string, lead_id string, sent_at timestamp, direction string, sender_type string, text string"),
        spark.createDataFrame(calls, "lead_id string, started_at timestamp, duration_sec long, outcome string"),
        spark.createDataFrame(stages, "lead_id string, stage string, changed_at timestamp"),
    )


@pytest.fixture(scope="module")
def data(world):
    leads, messages, calls, stages = world
    got = training.assemble(leads, messages, calls, None, stages, F.lit("2026-07-01").cast("timestamp"), "2026-04-20 00:00:00", 4, 0.4)
    return training.Dataset(*[materialise(getattr(got, f.name), f.name) for f in dataclasses.fields(got)])


def test_assembly_trains_saves_and_scores(spark, world, data):
    leads, messages, _, _ = world
    assert data.features.count() == data.target.where("target is not null").count() == data.ids.count() == 240
    folder = f"{scratch_dir(spark)}/bundle-test"
    numeric, categorical = ["age", "inbound_msg_count_before_t", "calls_answered_before_t"], ["source", "branch"]
    said = training.train(data, numeric, categorical, folder, "v7", "2026-04-20 00:00:00", trials=1, trees=4)
    assert said["champion"] in ("trees", "logistic") and f"Champion: **{said['champion']}**" in said["report"] and "Hidden from 2026-04-20" in said["card"]
    bundle = training.load_bundle(folder)
    x = model.standardise(data.features, {k: tuple(v) for k, v in bundle["scale"].items()})
    sizes = leads.limit(5).select("lead_id", F.lit(3).cast("long").alias("cluster_size"))
    ready = bundle["preprocessor"].transform(x)
    out = training.score_bundle(bundle, x, data.created_at, sizes, model.feature_names(ready))
    rows = out.collect()
    assert len(rows) == 240 and {r["band"] for r in rows} <= {"P1", "P2", "P3"} and all(len(r["reasons"]) == 3 and r["model_version"] == "v7" and 0 <= r["probability"] <= 1 for r in rows)
    assert sorted({r["duplicate_cluster_size"] for r in rows}) == [1, 3]
    with pytest.raises(ValueError):
        training.score_bundle(bundle, x.union(x.limit(1)), data.created_at)
    with pytest.raises(FileNotFoundError):
        training.load_bundle(folder + "-none")
    spark.createDataFrame([('{"version": "x"}',)], "value string").write.mode("overwrite").text(f"{folder}/bundle")
    with pytest.raises(ValueError, match="champion_name"):
        training.load_bundle(folder)
    remove(spark, folder)


def test_contributions_add_up_and_match_all_orders(spark, data):
    x = data.features.join(data.target.select("lead_id", F.col("target").alias("y")), "lead_id")
    names = ["age", "inbound_msg_count_before_t", "calls_answered_before_t"]
    ready = model.preprocessor(x, names, ["source"]).transform(x).cache()
    fitted, _ = model.fit_trees(ready, ready, trials=1, trees=3)
    trees = training.leaf_paths(fitted)
    every = model.feature_names(ready)
    rows, parts = training.contributions(fitted, ready, every)
    rows = fitted.transform(rows)
    got = rows.select("features", vector_to_array("rawPrediction")[1].alias("m"), *[p.alias(f"p{k}") for k, p in enumerate(parts.values())]).limit(20).toPandas()
    points = np.stack([v.toArray() for v in got["features"]])
    phi, base = training.shapley(trees, points)
    assert np.allclose(phi.sum(axis=1) + base, got["m"], atol=1e-6) and np.allclose(got[[f"p{k}" for k in range(len(every))]].to_numpy(), 2 * phi)
    # Shapley's definition: the mean gain of a feature over all orders
    import itertools

    def value(point, known):
        total = 0.0
        for leaves in trees:
            for v, path in leaves:
                p = 1.0
                for f, steps in path.items():
                    for kind, bound, left, share in steps:
                        p *= float((point[f] <= bound if kind == "at_most" else point[f] in bound) == left) if f in known else share
                total += v * p
        return total

    d = points.shape[1]
    for point, want in zip(points[:2], phi[:2]):
        gain = np.zeros(d)
        orders = list(itertools.permutations(range(d)))
        for order in orders:
            for k, f in enumerate(order):
                gain[f] += value(point, set(order[: k + 1])) - value(point, set(order[:k]))
        assert np.allclose(gain / len(orders), want, atol=1e-8)
    assert list(training.importance_contributions([0.1, 0.7, 0.2], ["a", "b", "c"], 2)) == ["b", "c"]
    reasons = rows.select(explain.top_reasons(parts, data.features.columns).alias("r")).first()["r"]
    assert len(reasons) == 3


def test_text_block_and_ablation(spark, world, data):
    leads, messages, _, _ = world
    text, axes = training.text_block(leads, messages, model.hashing_embedder(64), data.split.where("split = 'train'"), k=4)
    rows = text.collect()
    assert len(rows) == 240 and all(r["text_pca_00"] == 0 for r in rows if not r["has_text"]) and any(r["text_pca_00"] for r in rows)
    x = data.features.join(data.target.select("lead_id", F.col("target").alias("y")), "lead_id").join(data.split, "lead_id")
    ready = model.preprocessor(x, ["age"], ["source"]).transform(x)
    fitted, _ = model.fit_trees(ready, ready, trials=1, trees=2)
    got = training.ablation(fitted, x, ["age"], ["source"], text)
    assert set(got) == {"without_text", "with_text"} and all(len(m) == 6 for m in got.values())


def test_pooling_and_prefix():
    hidden = np.arange(12, dtype=float).reshape(1, 3, 4)
    want = hidden[0, :2].mean(axis=0)
    assert np.allclose(training.pooled(hidden, np.array([[1, 1, 0]]))[0], want / np.linalg.norm(want))
    assert training.with_prefix("a") == "query: a" and training.with_prefix("query: a") == "query: a" and training.with_prefix(None) == "query: "


def test_onnx_embedder_is_a_column_function():
    assert training.onnx_embedder("/no/model.onnx", "/no/tokenizer.json").returnType.simpleString() == "array<float>"


def test_capped_clusters_against_brute_force(spark):
    rng = random.Random(1)
    for cap in (2, 3, 5, 1000):
        pairs = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(130)})
        up, size, want = {}, {}, []

        def root(k):
            while up.get(k, k) != k:
                k = up[k]
            return k

        for a, b in pairs:
            ra, rb = root(a), root(b)
            if ra == rb:
                want.append((a, b, "already_connected"))
            elif size.get(ra, 1) + size.get(rb, 1) > cap:
                want.append((a, b, "cluster_size_cap"))
            else:
                want.append((a, b, "accepted"))
                up[max(ra, rb)] = min(ra, rb)
                size[min(ra, rb)] = size.get(ra, 1) + size.get(rb, 1)
        members, done = resolve.clusters(spark.range(120).withColumnRenamed("id", "lead_id"), spark.createDataFrame(pairs, "a long, b long"), cap)
        assert sorted(map(tuple, done.collect())) == want
        assert {r["lead_id"]: r["cluster"] for r in members.collect()} == {k: root(k) for k in range(120)}


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    for n, m in ((50, 40), (300, 290), (40, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))
        for a, b in edges:
            lo, hi = sorted((up[a], up[b]))
            up = [lo if x == hi else x for x in up]
        got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()}
        assert all(got[k] == up[k] for k in got) and {k for k in range(n) if up[k] != k} <= set(got)
    a, b = stars_of(np.array([5, 9, 2]), np.array([9, 11, 3]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 3), (5, 9), (5, 11)]


def test_isotonic_against_pooled_neighbours(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) / 40, rng.randrange(2)) for _ in range(300)]
    fix = model.calibrator("isotonic", spark.createDataFrame(rows, "p double, y int"))
    groups = [[x, sum(y for p, y in rows if p == x), sum(p == x for p, _ in rows)] for x in sorted({p for p, _ in rows})]
    pools = [[[x], s, n] for x, s, n in groups]
    k = 0
    while k + 1 < len(pools):
        if pools[k][1] * pools[k + 1][2] >= pools[k + 1][1] * pools[k][2]:
            pools[k : k + 2] = [[pools[k][0] + pools[k + 1][0], pools[k][1] + pools[k + 1][1], pools[k][2] + pools[k + 1][2]]]
            k = max(0, k - 1)
        else:
            k += 1
    want = {x: s / n for xs, s, n in pools for x in xs}
    got = {r["p"]: r["q"] for r in spark.createDataFrame(rows, "p double, y int").withColumn("q", fix(F.col("p"))).collect()}
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
    ends = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "p double").select(fix(F.col("p")).alias("q")).collect()
    assert abs(ends[0]["q"] - min(want.values())) < 1e-9 and abs(ends[1]["q"] - max(want.values())) < 1e-9 and ends[2]["q"] is None


def test_name_similarity_against_its_definition(spark):
    def ratio(a, b):
        """Twice the matched letters over all: the longest common block, then either side of it."""
        def matched(x, y):
            best = (0, 0, 0)
            for i in range(len(x)):
                for j in range(len(y)):
                    k = 0
                    while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            k, i, j = best
            return k + matched(x[:i], y[:j]) + matched(x[i + k :], y[j + k :]) if k else 0

        return 2 * matched(a, b) / (len(a) + len(b))

    rng = random.Random(5)
    names = ["".join(rng.choice("ab ch") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    for r in df.select("a", "b", C.name_similarity("a", "b").alias("s")).collect():
        assert abs(r["s"] - ratio(r["a"], r["b"])) < 1e-9 and abs(r["s"] - difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()) < 1e-9
    blank = spark.createDataFrame([(None, "x"), ("", "x")], "a string, b string").select(C.name_similarity("a", "b").alias("s")).collect()
    assert [r["s"] for r in blank] == [0.0, 0.0]


def test_scale_forms(spark):
    df = spark.range(5000).select(F.col("id").alias("lead_id"), (F.col("id") % 7 == 0).cast("int").alias("y"), (F.floor(F.col("id") / 9) / 1e6).alias("p"))
    want = {r["lead_id"] for r in df.orderBy(F.desc("p"), "lead_id").limit(500).collect()}
    assert {r["lead_id"] for r in metrics.top_fraction(df, 0.1, "lead_id").collect()} == want
    assert metrics.top_fraction(df.limit(0), 0.1, "lead_id").count() == 0


def test_content_hash_and_master(spark, tmp_path):
    import hashlib

    for k, text in enumerate(("ab", "c")):
        (tmp_path / f"{k}.txt").write_text(text)
    assert files.content_hash(spark, [str(tmp_path / "0.txt"), str(tmp_path / "1.txt")]) == hashlib.sha256(b"abc").hexdigest()


def test_commands():
    a = parser().parse_args(["dedupe", "--leads", "l", "--stages", "s", "--output", "o"])
    assert a.rule == "both_keys_or_exact_or_prefix" and a.max_cluster == 10
    with pytest.raises(SystemExit):
        parser().parse_args(["train", "--leads", "l"])


def test_dedupe_command(spark, tmp_path):
    from tessera import __main__ as commands

    lead = dict.fromkeys(files.RAW["leads"].fieldNames())
    rows = [lead | {"lead_id": f"L{k}", "created_at": f"2026-04-0{k + 1} 10:00:00", "source": "web", "branch": "b", "course_interest": "c", "full_name": "Asha Patel", "phone": "9876543210", "current_stage": "New", "updated_at": "2026-04-09 10:00:00"} for k in range(3)]
    schema = files.RAW["leads"]
    files.write(spark.createDataFrame([tuple(r[n] for n in schema.fieldNames()) for r in rows], schema), str(tmp_path / "leads"), "csv")
    files.write(spark.createDataFrame([("L1", "Admission Done", "2026-04-08T10:00:00+05:30", "x")], files.RAW["stage_history"]), str(tmp_path / "stages"), "csv")
    a = parser().parse_args(["dedupe", "--leads", str(tmp_path / "leads"), "--stages", str(tmp_path / "stages"), "--output", str(tmp_path / "gold")])
    commands.dedupe(spark, a)
    gold = spark.read.option("header", True).csv(str(tmp_path / "gold")).collect()
    assert len(gold) == 3 and {r["best_stage"] for r in gold} == {"Admission Done"} and {r["cluster_size"] for r in gold} == {"3"}
