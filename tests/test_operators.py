"""Semantics on hand-made rows: time windows, labels, text, resolution, metrics, models, registry, serving, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import explain, labels, metrics, model, pit, registry, resolve, serving, validate
from tessera.plans.components import connected_components
from tessera.sources import files
from tessera.streaming import live

T0 = dt.datetime(2026, 3, 1, 4, 30)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def world(spark):
    leads = spark.createDataFrame([("L1", T0, 25), ("L2", T0, None)], "lead_id string, created_at timestamp, age int")
    rows = [("m1", "L1", at(2), "outbound", "assistant", "hi"), ("m2", "L1", at(2) + dt.timedelta(minutes=7), "inbound", "lead", "What is the fee and EMI structure?"), ("m3", "L1", at(26), "inbound", "lead", "demo later"), ("m4", "L1", at(-1), "inbound", "lead", "too early"), ("m5", "L1", at(24), "inbound", "lead", "at the end")]
    messages = spark.createDataFrame(rows, "message_id string, lead_id string, sent_at timestamp, direction string, sender_type string, text string")
    calls = spark.createDataFrame([("L1", at(3), 120, "answered"), ("L1", at(4), -5, "answered"), ("L1", at(29), 9, "busy")], "lead_id string, started_at timestamp, duration_sec long, outcome string")
    return leads, messages, calls


def test_features_of_the_first_day(world):
    rows = {r["lead_id"]: r for r in pit.feature_matrix(*world, missing=["age"]).collect()}
    a, b = rows["L1"], rows["L2"]
    assert (a["inbound_msg_count_before_t"], a["outbound_msg_count_before_t"], a["kw_fee"], a["kw_emi"], a["kw_demo"]) == (1, 1, 1, 1, 0)
    assert a["mins_to_first_lead_reply_after_assistant"] == 7 and a["mins_to_first_counselor_call"] == 180 and a["calls_attempted_before_t"] == 1
    assert (a["creation_hour"], a["creation_weekday"]) == (4, 6)
    assert (b["inbound_msg_count_before_t"], b["mins_to_first_counselor_call"], b["age_missing"], b["has_inbound_text_before_t"]) == (0, -1.0, 1, 0)


def test_later_events_change_nothing(spark, world):
    leads, messages, calls = world
    more = messages.union(spark.createDataFrame([("m9", "L1", at(30), "inbound", "lead", "fees?")], messages.schema))
    assert sorted(pit.feature_matrix(leads, more, calls).collect()) == sorted(pit.feature_matrix(leads, messages, calls).collect())


def test_lead_text(spark):
    leads = spark.createDataFrame([("L1", T0), ("L2", T0)], "lead_id string, created_at timestamp")
    rows = [("a", "L1", at(-0.5), "inbound", "lead", "before cutoff"), ("b", "L1", at(22.5), "inbound", "lead", "just before cutoff"), ("c", "L1", at(24.5), "inbound", "lead", "after"), ("d", "L1", at(1), "inbound", "counselor", "no"), ("e", "L1", at(1), "inbound", "lead", "  ")]
    messages = spark.createDataFrame(rows, "message_id string, lead_id string, sent_at timestamp, direction string, sender_type string, text string")
    got = {r["lead_id"]: (r["text"], r["has_text"]) for r in pit.lead_text(leads, messages).collect()}
    assert got == {"L1": ("just before cutoff", 1), "L2": ("", 0)}


def test_labels(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    leads = spark.createDataFrame([(f"L{k}", T0) for k in range(1, 5)], "lead_id string, created_at timestamp")
    stages = spark.createDataFrame([("L1", "Admission Done", day(20)), ("L2", "Admitted", day(10)), ("L3", "Admission Done", day(31)), ("L4", "Admission Done", day(30))], "lead_id string, stage string, changed_at timestamp")
    got = {r["lead_id"]: r["target"] for r in labels.label_maturity(leads, stages, F.lit(day(30)), only_mature=True).collect()}
    assert got == {"L1": 1, "L2": 0, "L3": 0, "L4": 1}
    assert labels.label_maturity(leads, stages.limit(0), F.lit(day(29))).count() == 0
    assert labels.target_vector(leads, stages).where("target = 1").count() == 2


def test_split(spark):
    days = spark.range(160).select(F.col("id").alias("lead_id"), (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("created_at"))
    x = labels.time_split(days, "2026-04-19 18:30:00", 2, 0.25)
    s = {r["split"]: r for r in labels.describe_split(x).collect()}
    assert s["train"]["last"] < s["validation"]["first"] <= s["validation"]["last"] < s["calibration"]["first"]
    assert validate.disjoint(x, "lead_id", "split") is x
    with pytest.raises(ValueError):
        C.split_of(F.col("created_at"), "2026-04-19", 0)


def test_times(spark):
    row = spark.range(1).select(C.parse_naive(F.lit("2025-08-31 10:00:00")).alias("a"), C.parse_instant(F.lit("2025-08-31T19:28:31+05:30")).alias("b"), C.parse_epoch_ms(F.lit(1000)).alias("c"), C.parse_lenient(F.lit("what")).alias("d")).first()
    assert row["a"] == dt.datetime(2025, 8, 31, 4, 30) and row["b"] == dt.datetime(2025, 8, 31, 13, 58, 31) and row["c"] == dt.datetime(1970, 1, 1, 0, 0, 1) and row["d"] is None
    with pytest.raises(Exception):
        spark.range(1).select(C.parse_naive(F.concat(F.lit("2025-08-31 10:00:00Z"), F.col("id").cast("string").substr(9, 1)))).collect()


def test_masks_and_truncation(spark):
    row = spark.createDataFrame([("mail a.b@c.co or +91 9876543210, not 98765 43210 or 12345678901",)], "t string").select(C.mask_contacts(F.col("t")).alias("m"), C.truncate_tokens(F.col("t"), 2, "tail").alias("x")).first()
    assert row["m"] == "mail [EMAIL] or [PHONE], not 98765 43210 or 12345678901" and row["x"] == "or 12345678901"
    with pytest.raises(ValueError):
        C.truncate_tokens(F.col("t"), 2, "middle")


def test_resolution(spark):
    rows = [("L1", "website", "Asha Patel", "+91 98765 43210", "Asha@Example.com"), ("L2", "instagram", "Asha Patel", "09876543210", "asha@example.com"), ("L3", "website", "Rahul Shah", "9876543210", "rahul@example.com"), ("L4", "website", "Rohan Shah", "9999999999", "rahul@example.com")]
    leads = resolve.prepare(spark.createDataFrame([(*r, "b", "c", T0 + dt.timedelta(days=k)) for k, r in enumerate(rows)], "lead_id string, source string, full_name string, phone string, email string, branch string, course_interest string, created_at timestamp"))
    pairs = resolve.candidate_pairs(leads, {"phone": "phone_norm", "email": "email_norm"})
    assert {(r["a"], r["b"]): r["reasons"] for r in pairs.collect()} == {("L1", "L2"): ["email", "phone"], ("L1", "L3"): ["phone"], ("L2", "L3"): ["phone"], ("L3", "L4"): ["email"]}
    ev = resolve.evidence(pairs, leads)
    kept = ev.where(resolve.rule("key_and_name"))
    assert [(r["a"], r["b"], r["grade"]) for r in kept.collect()] == [("L1", "L2", "very_strong")]
    members, _ = resolve.clusters(leads, kept.select("a", "b"))
    stages = spark.createDataFrame([("L1", "New", T0), ("L2", "Admission Done", T0)], "lead_id string, stage string, changed_at timestamp")
    gold = {r["lead_id"]: r for r in resolve.golden(leads, members, stages, kept).collect()}
    assert len(gold) == 4 and gold["L2"]["canonical_lead_id"] == "L1" and gold["L1"]["best_stage"] == "Admission Done" and gold["L1"]["sources"] == '["instagram", "website"]'
    assert resolve.review_sample(ev, 4).count() == 4
    with pytest.raises(ValueError):
        resolve.rule("nonsense")


def test_capped_clusters(spark):
    leads = spark.createDataFrame([(f"L{k}",) for k in range(5)], "lead_id string")
    pairs = spark.createDataFrame([(f"L{a}", f"L{b}") for a in range(4) for b in range(a + 1, 4)], "a string, b string")
    members, done = resolve.clusters(leads, pairs, 2)
    assert {r["lead_id"]: r["cluster"] for r in members.collect()} == {"L0": "L0", "L1": "L0", "L2": "L2", "L3": "L2", "L4": "L4"}
    assert {r["status"]: r["count"] for r in done.groupBy("status").count().collect()} == {"accepted": 2, "cluster_size_cap": 4}
    with pytest.raises(ValueError):
        resolve.clusters(leads, pairs, 1)


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")).union(spark.createDataFrame([(100, 100), (200, 201)], "src long, dst long"))
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(60)}, 200: 200, 201: 200}


def test_metrics(spark):
    df = spark.createDataFrame([(k, y, p) for k, (y, p) in enumerate(zip([0, 0, 1, 0, 1, 1, 0, 1], [0.05, 0.10, 0.80, 0.20, 0.70, 0.90, 0.15, 0.60]))], "lead_id long, y int, p double")
    row = metrics.bundle(df, "lead_id").first()
    assert row["average_precision"] == 1 and row["roc_auc"] == 1 and row["lift_at_20"] == 2 and row["recall_at_20"] == 0.5 and 0 <= row["ece"] <= 1
    one = df.where("y = 0")
    assert metrics.average_precision(one).first()[0] is None and metrics.roc_auc(one).first()[0] is None
    tied = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "lead_id long, y int, p double")
    assert metrics.average_precision(tied).first()[0] == 0.5 and metrics.roc_auc(tied).first()[0] == 0.5
    t = metrics.thresholds(df).first()
    assert t["p1"] > t["p2"]


def test_models(spark):
    df = spark.range(400).select(F.col("id").alias("lead_id"), (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise("z").alias("c")).withColumn("y", (F.col("a") > 3).cast("int"))
    prepared = model.preprocessor(df, ["a"], ["c"]).transform(df)
    fitted = model.fit_logistic(prepared)
    trees, rows = model.fit_trees(prepared, prepared, trials=1)
    scored = model.probabilities(fitted, prepared)
    assert model.ranking_key(scored, "lead_id")[2] > 0.99 and len(rows) == 1 and model.champion((1, 1, 1), (1, 1, 1)) == "logistic"
    noisy = scored.withColumn("y", F.when(F.col("lead_id") % 5 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    for name in ("platt", "isotonic"):
        p = scored.select(model.calibrator(name, noisy)(F.col("p")).alias("q")).agg(F.min("q"), F.max("q")).first()
        assert 0 <= p[0] <= p[1] <= 1
    with pytest.raises(ValueError):
        model.calibrator("none", scored)
    emb = df.limit(40).withColumn("embedding", F.when(F.col("lead_id") > 0, model.hashing_embedder(24)(F.concat(F.lit("text "), "lead_id", "c"))))
    got = model.pca_columns(emb, model.fit_pca(emb, k=4), k=4)
    assert got.where("lead_id = 0").select("text_pca_03").first()[0] == 0 and got.count() == 40


def test_reasons(spark):
    df = spark.createDataFrame([(1, 0, 2.5, "web"), (0, 9, None, "shop")], "kw_fee int, creation_hour int, min_dist_to_branch double, source string")
    parts = {"kw_fee": F.lit(3.0), "num__creation_hour": F.lit(-2.0), "cat__source_web": F.lit(1.0), "min_dist_to_branch": F.lit(0.5), "age": F.lit(9.0)}
    got = [[x["en"] for x in r[0]] for r in df.select(explain.top_reasons(parts, df.columns)).collect()]
    assert got == [["Asked about fees", "Enquiry arrived around 00:00", "Lead came from web"], ["Enquiry arrived around 09:00", "", ""]]


def test_registry(spark, tmp_path):
    row = lambda v, s, a, e: spark.createDataFrame([(v, T0, None, "h", {"pr_auc": a, "ece": e}, s, ["f"])], registry.REGISTRY)
    r = registry.register(registry.register(registry.empty(spark, registry.REGISTRY), row("v1", "champion", 0.3, 0.05)), row("v2", "challenger", 0.3, 0.01))
    assert registry.champion(registry.promote(r, "v2")) == "v1"
    r = registry.register(r, row("v2", "challenger", 0.4, 0.05))
    after = registry.promote(r, "v2")
    assert registry.champion(after) == "v2" and after.where("status = 'retired'").count() == 1
    with pytest.raises(ValueError):
        registry.register(r, row("v3", "champion", 0.4, 0.05))
    log = str(tmp_path / "log")
    scores = spark.createDataFrame([("L1", T0, "v1", 0.5, "P2", [("a", "b")])], "lead_id string, asof timestamp, model_version string, probability float, band string, reasons array<struct<en:string,hi:string>>")
    registry.append_scores(scores, log)
    registry.append_scores(scores, log)
    assert registry.history(spark.read.parquet(log), "L1").count() == 2


def test_similar_and_requests(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 1, [0.0, 2.0]), ("c", 1, [1.0, 1.0]), ("d", 1, [0.0, 1.0])], "lead_id string, asof int, embedding array<double>")
    o = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "lead_id string, outcome int")
    assert [tuple(r) for r in serving.similar(v, o, "a", 5).collect()] == [("b", 1.0, 1), ("c", 0.707107, 0)]
    with pytest.raises(LookupError):
        serving.similar(v, o, "zz")
    scored = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "lead_id string, p double")
    assert [r["lead_id"] for r in serving.requested(spark, ["b", "a", "b"], scored).collect()] == ["b", "a", "b"]
    with pytest.raises(LookupError):
        serving.requested(spark, ["x"], scored)


def test_csv_contract(spark, tmp_path):
    good = tmp_path / "messages.csv"
    good.write_text("message_id,lead_id,sent_at,direction,sender_type,text\nm1,L1,2026-03-01T05:00:00Z,inbound,lead,hi\n")
    assert files.read(spark, "messages", str(good)).first()["sent_at"] == dt.datetime(2026, 3, 1, 5)
    for bad in ("m1,L1,2026-03-01T05:00:00Z,sideways,lead,hi\n", "m1,L1,2026-03-01T05:00:00Z,inbound,lead,a\nm1,L1,2026-03-01T05:00:00Z,inbound,lead,b\n", ",L1,2026-03-01T05:00:00Z,inbound,lead,a\n"):
        good.write_text("message_id,lead_id,sent_at,direction,sender_type,text\n" + bad)
        with pytest.raises(ValueError):
            files.read(spark, "messages", str(good))


def test_streamed_log(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    ddl = "lead_id string, asof timestamp, model_version string, probability float, band string, reasons array<struct<en:string,hi:string>>"
    spark.createDataFrame([("L1", T0, "v", 0.5, "P1", [("a", "b")])], ddl).write.parquet(src)
    live.log_scores(spark.readStream.schema(ddl).parquet(src), log, str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(log).count() == 1
