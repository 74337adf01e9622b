"""Registered queries of sources, contracts, registry, serving, calibration and reports, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import explain, metrics, model, pit, registry, reports, resolve, serving, training, validate
from tessera.plans import catalogue as base
from tessera.plans.components import connected_components
from tessera.plans.scratch import materialise, scratch_dir
from tessera.sources import files
from tessera.sources.tables import table
from tessera.streaming import live


def _path(s) -> str:
    return f"{scratch_dir(s)}/tessera/out-{uuid.uuid4().hex}"


def _csv(s, df, name):
    """The frame written as a CSV dataset and read through its contract."""
    path = _path(s)
    files.write(df.select(*files.RAW[name].fieldNames()), path, "csv")
    return files.read(s, name, path, negative_durations=True)


_SECOND = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
_INSTANT = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
STAGES = files.ENUMS["stage_history"]["stage"]


def _lead_rows(s, d):
    null = lambda n, t="string": f"cast(null as {t}) as {n}"
    return table(s, d, "events").where("event_type = 'signup'").selectExpr("concat('L', event_id) as lead_id", f"{_SECOND} as created_at", "'web' as source", "concat('b', user_id % 3) as branch", "'c, \"d\"' as course_interest", null("full_name"), null("phone"), null("email"), null("education_status"), "user_id % 60 as age", null("home_locality"), null("assigned_counselor_id"), "'New' as current_stage", f"{_SECOND} as updated_at", null("last_contacted_at"), null("legacy_score", "bigint"), null("legacy_score_version"))


def _message_rows(s, d):
    return table(s, d, "events").where("event_type in ('click', 'view')").selectExpr("concat('m', event_id) as message_id", "concat('L', user_id) as lead_id", f"{_INSTANT} as sent_at", "if(event_type = 'click', 'inbound', 'outbound') as direction", "if(event_type = 'click', 'lead', 'assistant') as sender_type", "props as text")


def _call_rows(s, d):
    return table(s, d, "events").where("event_type = 'error'").selectExpr("concat('c', event_id) as call_id", "concat('L', user_id) as lead_id", "'x' as counselor_id", "unix_millis(cast(date_trunc('second', ts) as timestamp)) as started_at_ms", "cast(floor(value) as bigint) as duration_sec", "if(value >= 60, 'answered', 'busy') as outcome", "cast(null as string) as notes")


def _cluster_rows(s, d):
    return table(s, d, "orders").selectExpr("concat('C_', o_custkey) as cluster_id", "cast(o_orderkey as string) as lead_id", "o_orderkey % 2 = 0 as is_canonical", "o_custkey % 5 + 1 as cluster_size", "cast(o_custkey as string) as canonical_lead_id", "'New' as best_stage", "cast(o_custkey as string) as stage_source", "'[\"a, b\"]' as sources", "false as weak_cluster", "'' as weak_reason")


def _table_scan(s, d):
    name = f"t_{uuid.uuid4().hex}"
    _message_rows(s, d).createOrReplaceTempView(name)
    return files.read_table(s, "messages", table=name).selectExpr("message_id", "unix_timestamp(sent_at) as sent", "direction", "text")


def _fallback(s, d):
    name = f"t_{uuid.uuid4().hex}"
    _cluster_rows(s, d).createOrReplaceTempView(name)
    return files.read_or_table(s, "lead_clusters", _path(s), table=name).select("lead_id", "cluster_id", "cluster_size")


def _roundtrip(s, d, form):
    path = _path(s)
    df = table(s, d, "customer").selectExpr("c_custkey", "c_name", "c_acctbal", "if(c_custkey % 7 = 0, null, c_mktsegment) as c_mktsegment")
    files.write(df, path, form)
    reader = s.read.schema(df.schema)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def _scores_csv(s, d):
    path = _path(s)
    files.write(table(s, d, "orders").selectExpr("o_orderkey as lead_id", "'x, y' as band", "round(o_totalprice / 1000000, 6) as probability", "'v1' as model_version"), path, "csv")
    return files.read_scores(s, path).withColumn("probability", F.round("probability", 6))


def _log_rows(s, d, version="v1"):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("lead_id"), F.col("o_orderdate").cast("timestamp").alias("asof"), F.lit(version).alias("model_version"), (F.col("o_totalprice") / 1e6).cast("float").alias("probability"), F.lit("P1").alias("band"), F.lit(None).cast("array<struct<en:string,hi:string>>").alias("reasons"))


def _score_log(s, d):
    path = _path(s)
    for v in ("v1", "v2"):
        registry.append_scores(_log_rows(s, d, v), path)
    return s.read.parquet(path).groupBy("model_version").agg(F.count("*").alias("n"), F.count("scored_at").alias("dated"), F.countDistinct("lead_id").alias("leads"))


def _append_and_size(s, d):
    sizes = table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("lead_id"), (F.col("o_custkey") % 5 + 1).alias("cluster_size"))
    return registry.append_and_size(_log_rows(s, d), _path(s), sizes)


def _history(s, d):
    log = _log_rows(s, d).unionByName(_log_rows(s, d, "v2")).withColumn("scored_at", F.col("asof"))
    return registry.history(log, version="v2", most=25).select("lead_id", "model_version", F.unix_timestamp("scored_at").alias("scored"))


def _stream(s, d):
    source, path = _path(s), _path(s)
    rows = materialise(_log_rows(s, d).repartition(4), "stream")
    rows.write.parquet(source)
    q = live.log_scores(s.readStream.schema(rows.schema).parquet(source), path, _path(s), once=True)
    q.awaitTermination()
    return s.read.parquet(path).groupBy("model_version", "band").agg(F.count("*").alias("n"), F.countDistinct("lead_id").alias("leads"))


def _registry(s, d):
    r = table(s, d, "region")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("r_regionkey"))
    return r.select(F.concat(F.lit("v"), "r_regionkey").alias("version"), day.alias("created_at"), F.struct(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("lower"), day.alias("upper")).alias("train_window"), F.sha2("r_name", 256).alias("data_sha256"), F.create_map(F.lit("pr_auc"), F.col("r_regionkey") / 8).alias("metrics"), F.when(F.col("r_regionkey") == 2, "champion").when(F.col("r_regionkey") == 1, "retired").otherwise("challenger").alias("status"), F.array(F.lit("a"), F.lower("r_name")).alias("feature_list"))


def _health(s, d):
    good, bare = _path(s), _path(s)
    _registry(s, d).write.parquet(good)
    _registry(s, d).where("status <> 'champion'").write.parquet(bare)
    rows = [(n, *registry.health(s, p).values()) for n, p in (("full", good), ("no champion", bare), ("absent", _path(s)))]
    return s.createDataFrame(rows, "registry string, database boolean, model boolean")


def _ddl(s, d):
    rows = [(n, f.name, f.dataType.simpleString()) for n, ddl in (("registry", registry.REGISTRY), ("scores", registry.SCORES)) for f in registry.empty(s, ddl).schema]
    return s.createDataFrame(rows, "name string, column string, type string")


def _vectors(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("lead_id"), F.lit(0).alias("asof"), F.lit("v1").alias("model_version"), "embedding")
    new = e.where("lead_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("has_text", (F.col("lead_id") % 2).cast("int"))
    out = files.verify_vectors(files.upsert_vectors(e, new, 64), 64)
    return out.select("lead_id", F.md5(C.vector_literal(F.col("embedding"), 64)).alias("literal"))


def _outcomes(s, d):
    old = table(s, d, "labels").select(F.col("doc_id").alias("lead_id"), F.col("quality").cast("int").alias("outcome"))
    new = table(s, d, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").alias("lead_id"), F.col("toxic").cast("int").alias("target"))
    return files.outcomes(old, new)


CHECKS = {
    "columns": lambda s, d: validate.columns(table(s, d, "orders"), ["o_orderkey", "no_such"]),
    "strict_columns": lambda s, d: validate.columns(table(s, d, "orders"), ["o_orderkey"], strict=True),
    "not_null": lambda s, d: validate.not_null(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), ["quality"]),
    "allowed": lambda s, d: validate.allowed(table(s, d, "orders"), "o_orderstatus", ["F", "O"]),
    "at_least_zero": lambda s, d: validate.at_least_zero(table(s, d, "customer"), ["c_acctbal"]),
    "unique": lambda s, d: validate.unique(table(s, d, "orders"), "o_custkey"),
    "unique_holds": lambda s, d: validate.unique(table(s, d, "orders"), "o_orderkey"),
    "complete": lambda s, d: validate.complete(table(s, d, "documents"), table(s, d, "labels"), "doc_id"),
    "none_of": lambda s, d: validate.none_of(table(s, d, "orders").withColumn("legacy_score", F.lit(1)), pit.FORBIDDEN),
    "both_classes": lambda s, d: validate.both_classes(table(s, d, "labels").withColumn("split", F.col("toxic")), "split", "toxic"),
    "binary_labels": lambda s, d: validate.binary_labels(table(s, d, "embeddings"), "label"),
    "disjoint": lambda s, d: validate.disjoint(table(s, d, "orders"), "o_custkey", "o_orderstatus"),
    "disjoint_holds": lambda s, d: validate.disjoint(table(s, d, "orders"), "o_orderkey", "o_orderstatus"),
    "join_one_to_one": lambda s, d: validate.join_one_to_one(table(s, d, "nation"), table(s, d, "nation").withColumn("n_nationkey", F.lit(1)), "n_nationkey"),
    "to_integer": lambda s, d: validate.to_integer(table(s, d, "orders"), "o_orderpriority").agg(F.sum("o_orderpriority")).collect(),
    "frozen_rule": lambda s, d: validate.frozen_rule({"rule": "exact_key"}, "both_keys"),
    "frozen_rule_holds": lambda s, d: validate.frozen_rule({"rule": "both_keys"}, "both_keys"),
    "relaxed": lambda s, d: validate.relaxed(table(s, d, "orders"), ["phone"]),
    "unknown_stage": lambda s, d: table(s, d, "orders").select(C.stage_rank(F.col("o_orderstatus"), strict=True).alias("r")).agg(F.sum("r")).collect(),
}


def _errors(s, d):
    from pyspark.errors import PySparkException

    out = []
    for name, run in CHECKS.items():
        try:
            run(s, d)
            out.append((name, False))
        except (ValueError, PySparkException):
            out.append((name, True))
    return s.createDataFrame(out, "check string, raised boolean")


def _ledger(s, d):
    parts = {
        "orders": validate.ledger(table(s, d, "orders"), ["o_orderkey"], {"o_orderstatus": ["F", "O"]}, ["o_totalprice"], integers=["o_orderpriority"], unique_keys=["o_orderkey", "o_custkey"]),
        "customer": validate.ledger(table(s, d, "customer"), ["c_name"], {}, ["c_acctbal"], integers=["c_custkey"]),
        "embeddings": validate.ledger(table(s, d, "embeddings"), binary=["label"]),
    }
    out = None
    for n, x in parts.items():
        x = x.withColumn("name", F.lit(n))
        out = x if out is None else out.unionByName(x)
    return out


#: Contact texts made of customer rows, in SQL that both engines read.
CONTACTS = {
    "id": "c_custkey",
    "phone": "case c_custkey % 7 when 0 then concat('+91 98765 ', lpad(cast(c_custkey % 100000 as string), 5, '0')) when 1 then concat('0', cast(9000000000 + c_custkey as string)) when 2 then concat('0091', cast(9000000000 + c_custkey as string)) when 3 then cast(c_custkey as string) when 4 then concat('91', cast(9000000000 + c_custkey as string)) when 5 then concat('98765 ', lpad(cast(c_custkey % 100000 as string), 5, '0')) end",
    "email": "case c_custkey % 3 when 0 then concat(' ', c_name, '@Example.COM ') when 1 then '' end",
    "name": "concat('  ', upper(c_name), '   ', c_mktsegment, ' ')",
}


def _contacts(s, d):
    return table(s, d, "customer").selectExpr(*[f"{x} as {n}" for n, x in CONTACTS.items()])


def _leads_of_contacts(s, d):
    return resolve.prepare(_contacts(s, d).select(F.col("id").alias("lead_id"), "phone", "email", F.col("name").alias("full_name")))


def _audit(s, d):
    people = base._persons(s, d)
    pairs = resolve.audit_pairs(people, {"phone": "phone_norm", "email": "email_norm"}, "created_at")
    return pairs, resolve.audit_evidence(pairs, people)


def _cluster_sizes(s, d):
    half = table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("lead_id"), (F.col("o_custkey") % 5 + 1).alias("cluster_size"))
    return serving.cluster_sizes(table(s, d, "orders").select(F.col("o_orderkey").alias("lead_id")), half)


def _full_scores(s, d):
    o = table(s, d, "orders")
    x = o.select(F.col("o_orderkey").alias("lead_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 1e5).alias("x"), F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 3).cast("int").alias("kw_fee"), (F.col("o_custkey") % 24).cast("int").alias("creation_hour"))
    parts = {"num__kw_fee": F.col("kw_fee") * 0.5, "cat__source_F": F.when(F.col("source") == "F", 0.75).otherwise(0.0), "num__creation_hour": F.col("creation_hour") * -0.03125}
    sizes = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("lead_id"), (F.col("o_custkey") % 5 + 1).alias("cluster_size"))
    out = model.score_batch(x, model.scorecard(None, {"x": 0.8}, -1.5), model.Platt(0.9, -0.2), 0.6, 0.3, "v1", sizes, explain.top_reasons(parts, x.columns))
    return base._r(out, "probability").select("lead_id", "asof", "model_version", "probability", "band", "duplicate_cluster_size", F.col("reasons")[0]["en"].alias("en1"), F.col("reasons")[2]["hi"].alias("hi3"))


def _requested(s, d):
    x = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("lead_id"), "o_totalprice")
    ids = [r[0] for r in table(s, d, "orders").groupBy("o_orderstatus").agg(F.min("o_orderkey").cast("string").alias("k")).orderBy(F.desc("o_orderstatus")).select("k").collect()]
    return serving.requested(s, [*ids, ids[0]], x)


def _golden_weak(s, d):
    people = base._persons(s, d)
    ev = materialise(base._evidence(s, d).where(resolve.rule("exact_key")), "evidence")
    members = materialise(resolve.clusters(people, ev.select("a", "b"), 10**9)[0], "members")
    stages = people.select("lead_id", F.lit("New").alias("stage"), F.col("created_at").alias("changed_at"))
    return resolve.golden(people, members, stages, ev).select("lead_id", "weak_cluster", "weak_reason")


def _star_clusters(s, d):
    people = base._persons(s, d)
    found = connected_components(resolve.star_links(people, {"phone": "phone_norm", "email": "email_norm"}), "a", "b")
    return people.select("lead_id").join(found, F.col("lead_id") == F.col("id"), "left").select("lead_id", F.coalesce("component", "lead_id").alias("cluster"))


def _capped(s, d):
    return resolve.clusters(base._persons(s, d), base._pairs(s, d).select("a", "b"), 3)


def _summary_capped(s, d):
    members, done = _capped(s, d)
    return resolve.summary(base._persons(s, d), base._pairs(s, d), materialise(members, "members"), done=done).select("leads", "candidate_pairs", (F.col("accepted") + F.col("already_connected") + F.col("cap_rejected")).alias("decided"), (F.col("largest") <= 3).alias("within_cap"), (F.col("leads") - F.col("accepted") == F.col("clusters")).alias("forest"))


def _coarse(s, d):
    return base._scores(s, d).withColumn("p", F.round("p", 2))


def _gradients(s, d):
    """What is left of the penalised likelihood's gradient at the fitted calibration and logistic model, nothing at the optimum."""
    scored = base._scores(s, d)
    n = scored.count()
    fix = model.calibrator("platt", scored)
    z = C.logit(F.col("p"))
    miss = 1 / (1 + F.exp(-(fix.slope * z + fix.intercept))) - F.col("y")
    a = scored.agg(F.avg(miss).alias("mean"), (F.avg(miss * z) + fix.slope / n).alias("slope")).select(F.lit("platt").alias("model"), "mean", "slope")
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("lead_id"), (F.col("o_totalprice") / 1e5).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    fit = model.fit_logistic(x.select(array_to_vector(F.array("x")).alias("features"), F.col("y").cast("double").alias("y")))
    w, b = float(fit.coefficients[0]), float(fit.intercept)
    miss = 1 / (1 + F.exp(-(w * F.col("x") + b))) - F.col("y")
    c = x.agg(F.avg(miss).alias("mean"), (F.avg(miss * F.col("x")) + w / n).alias("slope")).select(F.lit("logistic").alias("model"), "mean", "slope")
    small = lambda v: F.abs(F.col(v)) < 1e-4
    return a.unionByName(c).select("model", small("mean").alias("mean_settled"), small("slope").alias("slope_settled"))


def _pca(s, d):
    """The axes' scores have mean 0, are uncorrelated and hold as much variance as any other 2 of the fitted axes' order."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    x = model.pca_columns(e, model.fit_pca(e, k=4), k=4)
    names = [f"text_pca_{i:02d}" for i in range(4)]
    got = x.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.var_pop(n).alias(f"v{i}") for i, n in enumerate(names)], F.covar_pop(names[0], names[1]).alias("c"))
    return got.select((F.abs("c") < 1e-6).alias("uncorrelated"), ((F.col("v0") >= F.col("v1")) & (F.col("v1") >= F.col("v2")) & (F.col("v2") >= F.col("v3"))).alias("falling"), (F.abs("m0") < 1e-6).alias("centred"))


def _report(s, d):
    scored = base._scores(s, d)
    said = scored.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")).join(metrics.calibration_error(scored)).first().asDict()
    split = {f"{p}_{e}": f"{p} {e}" for p in ("train", "validation", "calibration") for e in ("min", "max")} | {"hidden_start": "2024-01-25"}
    text = training.model_card("trees", "platt", split, said) + training.evaluation_report("run", {"rows": scored.count()}, {"brier": said["brier"], "none": None}, {}, "trees", said, {"p1": 0.5, "p2": 0.25}, 3, "platt")
    return s.createDataFrame(list(enumerate(text.split("\n"))), "k long, line string")


def _hash(s, d):
    n = table(s, d, "orders").count()
    return s.createDataFrame([(model.metadata_hash({"version": "v1", "rows": n}),)], "hash string")


SENTENCES = {"age": "o_orderkey % 50", "creation_hour": "o_orderkey % 24", "creation_weekday": "o_orderkey % 7", "inbound_msg_count_before_t": "nullif(o_orderkey % 4, 0)", "outbound_msg_count_before_t": "o_orderkey % 5", "mean_msg_len_before_t": "o_orderkey % 90", "calls_attempted_before_t": "o_orderkey % 3", "calls_answered_before_t": "o_orderkey % 2", "min_dist_to_branch": "o_orderkey % 40 / 4.0", "mins_to_first_lead_reply_after_assistant": "o_orderkey % 30 - 1", "mins_to_first_counselor_call": "o_orderkey % 70 - 1", "source": "o_orderstatus", "branch": "o_orderstatus", "course_interest": "o_orderpriority", "education_status": "o_orderpriority"} | {f: f"o_orderkey % {k + 2} % 2" for k, f in enumerate(explain.FLAGS)}
ONE_HOT = ("cat__source_F", "cat__branch_O", "cat__course_interest_1-URGENT", "cat__education_status_5-LOW")


def _features() -> list[str]:
    plain = [f for f in SENTENCES if f not in ("source", "branch", "course_interest", "education_status")]
    return [*(f"num__{f}" for f in plain), *ONE_HOT]


def _sentences(s, d):
    x = table(s, d, "orders").where("o_orderkey is not null").selectExpr("o_orderkey as lead_id", *[f"{e} as {n}" for n, e in SENTENCES.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), explain.reason(f, x.columns).alias("r")) for f in _features()])).alias("v")
    return x.select("lead_id", rows).select("lead_id", "v.feature", "v.r.en", "v.r.hi").where("en is not null")


def _knn_all(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("lead_id"), "embedding", F.col("vec_id").alias("asof"), F.when(F.col("label") < 8, F.col("label") % 2).alias("outcome"))
    first = e.agg(F.max("lead_id")).first()[0]
    return serving.similar(e.drop("outcome"), e.where("outcome is not null").select("lead_id", "outcome"), first, 50)


def _full_matrix(s, d):
    leads = base._leads(s, d).withColumn("home_locality", F.concat(F.lit("n"), F.get_json_object("props", "$.k").cast("int") % 30)).withColumn("age", F.when(F.col("user_id") % 4 > 0, F.col("user_id")))
    dim = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("locality"), (F.col("n_nationkey") * 1.5).alias("d1"), (F.col("n_regionkey") * 4.0 + 1).alias("d2"))
    groups = leads.select("lead_id", F.col("user_id").alias("cluster_id"))
    out = pit.feature_matrix(leads, base._messages(s, d), base._calls(s, d), dim, ["d1", "d2"], base.WORDS, groups, present=["home_locality"], missing=["age"], key="user_id")
    return base._r(out, "mean_msg_len_before_t", "min_dist_to_branch", *pit.LATENCIES).drop("user_id", "props", "value", "age")


def _assembled(s, d):
    data = training.assemble(base._leads(s, d), base._messages(s, d), base._calls(s, d), None, base._stages(s, d), base._export(s, d), base.HIDDEN, 1, 0.25, base._leads(s, d).select("lead_id", F.col("user_id").alias("cluster_id")), base.DAYS, "won", "user_id", keywords=base.WORDS)
    x = training.reindex(data.target, data.ids).join(data.split, "lead_id").join(data.features.select("lead_id", "inbound_msg_count_before_t", "earlier_enquiries_count"), "lead_id")
    return x.join(data.created_at, "lead_id")


def queries() -> dict:
    q = {}
    q["csv_leads"] = lambda s, d: _csv(s, _lead_rows(s, d), "leads").selectExpr("lead_id", "unix_timestamp(created_at) as created", "branch", "course_interest", "age", "last_contacted_at is null as no_contact")
    q["csv_messages"] = lambda s, d: _csv(s, _message_rows(s, d), "messages").selectExpr("message_id", "lead_id", "unix_timestamp(sent_at) as sent", "direction", "sender_type", "text")
    q["csv_calls"] = lambda s, d: _csv(s, _call_rows(s, d), "calls").selectExpr("call_id", "unix_timestamp(started_at) as started", "duration_sec", "outcome")
    q["csv_stage_history"] = lambda s, d: _csv(s, table(s, d, "events").select(F.concat(F.lit("L"), "user_id").alias("lead_id"), F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 10 + 1).cast("int")).alias("stage"), F.expr(f"{_INSTANT} as changed_at"), F.col("event_id").cast("string").alias("changed_by")), "stage_history").selectExpr("changed_by", "stage", "unix_timestamp(changed_at) as changed").withColumn("rank", C.stage_rank(F.col("stage"), strict=True))
    q["csv_counselors"] = lambda s, d: _csv(s, table(s, d, "supplier").selectExpr("cast(s_suppkey as string) as counselor_id", "s_name as name", "'b' as branch", "'hi, en' as languages", "date_add(date'2020-01-01', cast(s_suppkey % 300 as int)) as joined_on"), "counselors").selectExpr("counselor_id", "name", "languages", "datediff(joined_on, date'2020-01-01') as days")
    q["csv_localities"] = lambda s, d: _csv(s, table(s, d, "nation").selectExpr("n_name as locality", "n_nationkey * 1.5 as km_to_riverside", "n_regionkey * 2.0 as km_to_central", "0.25 as km_to_lakeview"), "localities")
    q["csv_clusters"] = lambda s, d: _csv(s, _cluster_rows(s, d), "lead_clusters").select("lead_id", "cluster_id", "is_canonical", "cluster_size", "sources")
    q["table_scan"] = _table_scan
    q["table_fallback"] = _fallback
    q["csv_scores"] = _scores_csv
    for form in ("csv", "json", "parquet"):
        q[f"sink_{form}"] = lambda s, d, form=form: _roundtrip(s, d, form)
    q["table_hash"] = lambda s, d: files.table_hash(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    q["metadata_hash"] = _hash
    q["model_reports"] = _report
    q["table_ddl"] = _ddl
    q["vector_store"] = _vectors
    q["outcome_upsert"] = _outcomes
    q["score_log"] = _score_log
    q["append_and_size"] = _append_and_size
    q["score_history"] = _history
    q["score_stream"] = _stream
    q["registry_register"] = lambda s, d: registry.register(_registry(s, d), _registry(s, d).where("version = 'v3'").withColumn("status", F.lit("retired"))).select("version", "status", "data_sha256")
    q["registry_card"] = lambda s, d: registry.card(_registry(s, d), "v3").select("version", "train_window", "metrics", "status")
    q["registry_versions"] = lambda s, d: registry.versions(_registry(s, d)).limit(3).select("version")
    q["registry_champion"] = lambda s, d: registry.champion_row(_registry(s, d)).select("version", F.concat_ws(",", "feature_list").alias("features"))
    q["registry_promotion"] = lambda s, d: registry.promote(_registry(s, d), "v4").select("version", "status")
    q["health"] = _health
    q["contract_errors"] = _errors
    q["contract_ledger"] = _ledger
    q["presence_flags"] = lambda s, d: pit.presence_flags(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "lead_id"), ["text"], ["quality"])
    q["prepare_leads"] = lambda s, d: _leads_of_contacts(s, d).select("lead_id", "phone_norm", "email_norm", "name_norm")
    q["phone_shapes"] = lambda s, d: reports.count_by(_contacts(s, d).where("phone is not null"), C.phone_shape(F.col("phone")), "shape")
    q["token_prefix_names"] = lambda s, d: _contacts(s, d).select("id", C.token_prefix(F.substring(C.normalize_name(F.col("name")), 1, 4), C.normalize_name(F.col("name"))).alias("cut"), C.token_prefix(F.lit("customer"), C.normalize_name(F.col("name"))).alias("whole"))
    q["name_similarity_customers"] = lambda s, d: _contacts(s, d).select("id", F.round(C.name_similarity(C.normalize_name(F.col("name")), F.lit("customer building")), 6).alias("similarity"))
    q["mask_contacts_documents"] = lambda s, d: table(s, d, "documents").select("doc_id", F.md5(C.mask_contacts(F.col("text"))).alias("masked"))
    q["mask_contacts_customers"] = lambda s, d: _contacts(s, d).select("id", C.mask_contacts(F.concat_ws(" ", "phone", "phone", F.lit("x"), "email")).alias("masked"))
    q["keyword_flags_documents"] = lambda s, d: table(s, d, "documents").select("doc_id", *[C.keyword_flag(F.col("text"), w).alias(f"kw_{k}") for k, w in C.KEYWORDS.items()])
    q["cluster_sizes"] = _cluster_sizes
    q["reindex_labels"] = lambda s, d: training.reindex(table(s, d, "labels").select(F.col("doc_id").alias("lead_id"), "toxic"), table(s, d, "documents").select(F.col("doc_id").alias("lead_id"))).fillna(-1, ["toxic"])
    q["requested_scores"] = _requested
    q["confusion"] = lambda s, d: base._r(metrics.confusion(base._scores(s, d).select(F.col("y").alias("label"), (F.col("p") >= 0.4).alias("predicted"))), "precision", "recall")
    q["fresh_audit"] = lambda s, d: resolve.fresh_audit(base._evidence(s, d), base._pairs(s, d).where("a % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")), {"both_keys": 3, "phone_only": 7, "email_only": 5}).select("a", "b", "stratum")
    q["audit_pairs"] = lambda s, d: _audit(s, d)[0]
    q["audit_evidence"] = lambda s, d: _audit(s, d)[1]
    q["cluster_listing"] = lambda s, d: resolve.listing(base._members(s, d)).limit(200).select("cluster", "size", F.concat_ws(",", "members").alias("members"))
    q["largest_clusters"] = lambda s, d: resolve.largest_clusters(base._members(s, d))
    q["pairs_sorted"] = lambda s, d: base._pairs(s, d).select("a", "b").orderBy("a", "b").limit(100)
    q["hot_keys"] = lambda s, d: resolve.hot_keys(base._persons(s, d), {"phone": "phone_norm", "email": "email_norm"}, 2)
    q["clusters_star"] = _star_clusters
    q["golden_weak_reasons"] = _golden_weak
    q["dedupe_summary_capped"] = _summary_capped
    q["lead_detail"] = lambda s, d: base._r(serving.lead_detail(base._persons(s, d), base._scores(s, d).select("lead_id", F.col("p").alias("probability")), table(s, d, "orders").agg(F.max("o_orderkey")).first()[0]), "probability")
    q["score_batch_full"] = _full_scores
    q["reason_sentences"] = _sentences
    q["knn_unlabelled"] = _knn_all
    q["feature_matrix_full"] = _full_matrix
    q["dataset_assembly"] = _assembled
    q["isotonic_fit"] = lambda s, d: base._r(_coarse(s, d).select("lead_id", model.calibrator("isotonic", _coarse(s, d))(F.col("p")).alias("p")), "p")
    q["fits_settled"] = _gradients
    q["pca_axes"] = _pca
    q["l2_normalize_all"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(C.l2_normalize(F.col("embedding"))).alias("k", "x")).withColumn("x", F.round("x", 6))
    q["masked_mean"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(C.masked_mean(F.array(F.slice("embedding", 1, 3), F.slice("embedding", 4, 3), F.slice("embedding", 7, 3)), F.array(F.lit(1), F.lit(0), (F.col("vec_id") % 2).cast("int")), 3)).alias("k", "x")).withColumn("x", F.round("x", 6))
    q["vector_literals"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.md5(C.vector_literal(F.col("embedding"), 64)).alias("literal"))
    q["latest_vectors"] = lambda s, d: serving.latest_per_key(table(s, d, "embeddings").select("label", F.col("vec_id").alias("asof"), F.md5(C.vector_literal(F.col("embedding"), 64)).alias("literal")), "label", "asof")
    q["parse_times"] = lambda s, d: table(s, d, "events").selectExpr("event_id", f"{_SECOND} as naive", f"{_INSTANT} as instant", "unix_millis(cast(ts as timestamp)) as ms").select("event_id", F.unix_timestamp(C.parse_naive(F.col("naive"))).alias("naive"), F.unix_timestamp(C.parse_instant(F.col("instant"))).alias("instant"), F.unix_millis(C.parse_epoch_ms(F.col("ms"))).alias("ms"), F.unix_timestamp(C.parse_lenient(F.col("naive"))).alias("lenient"), F.unix_timestamp(C.parse_or_now(F.when(F.col("event_id") % 2 == 0, F.col("instant")).otherwise(F.lit("never")))).alias("or_now")).withColumn("or_now", F.when(F.col("or_now") < F.unix_timestamp() - 86400, F.col("or_now")).otherwise(F.lit(-1)))
    return q


def oracle_sql() -> dict:
    q = {}
    sec = "epoch(date_trunc('second', ts))::bigint"
    q["csv_leads"] = f"select concat('L', event_id) as lead_id, {sec} - 19800 as created, concat('b', user_id % 3) as branch, 'c, \"d\"' as course_interest, user_id % 60 as age, true as no_contact from events where event_type = 'signup'"
    who = "case event_type when 'click' then 'inbound' else 'outbound' end as direction"
    q["csv_messages"] = f"select concat('m', event_id) as message_id, concat('L', user_id) as lead_id, {sec} as sent, {who}, case event_type when 'click' then 'lead' else 'assistant' end as sender_type, props as text from events where event_type in ('click', 'view')"
    q["csv_calls"] = f"select concat('c', event_id) as call_id, {sec} as started, floor(value)::bigint as duration_sec, case when value >= 60 then 'answered' else 'busy' end as outcome from events where event_type = 'error'"
    names = ", ".join(f"'{x}'" for x in STAGES)
    ranks = ", ".join(str(C.STAGE_RANK[x.lower()]) for x in STAGES)
    q["csv_stage_history"] = f"select event_id::varchar as changed_by, [{names}][event_id % 10 + 1] as stage, {sec} as changed, [{ranks}][event_id % 10 + 1]::int as rank from events"
    q["csv_counselors"] = "select s_suppkey::varchar as counselor_id, s_name as name, 'hi, en' as languages, (s_suppkey % 300)::int as days from supplier"
    q["csv_localities"] = "select n_name as locality, n_nationkey * 1.5::double as km_to_riverside, n_regionkey * 2.0::double as km_to_central, 0.25::double as km_to_lakeview from nation"
    q["csv_clusters"] = "select o_orderkey::varchar as lead_id, concat('C_', o_custkey) as cluster_id, o_orderkey % 2 = 0 as is_canonical, o_custkey % 5 + 1 as cluster_size, '[\"a, b\"]' as sources from orders"
    q["table_scan"] = f"select concat('m', event_id) as message_id, {sec} as sent, {who}, props as text from events where event_type in ('click', 'view')"
    q["table_fallback"] = "select o_orderkey::varchar as lead_id, concat('C_', o_custkey) as cluster_id, o_custkey % 5 + 1 as cluster_size from orders"
    q["csv_scores"] = "select o_orderkey::varchar as lead_id, round(o_totalprice / 1000000, 6) as probability from orders"
    for form in ("csv", "json", "parquet"):
        q[f"sink_{form}"] = "select c_custkey, c_name, c_acctbal, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment from customer"
    row = "concat('{\"o_custkey\":', o_custkey, ',\"o_orderkey\":', o_orderkey, ',\"o_orderpriority\":\"', o_orderpriority, '\",\"o_orderstatus\":\"', o_orderstatus, '\"}')"
    q["table_hash"] = f"select count(*) as rows, sum(('0x' || substr(md5({row}), 1, 15))::ubigint)::varchar as digest from orders"
    q["metadata_hash"] = "select sha256(concat('{\"rows\": ', count(*), ', \"version\": \"v1\"}')) as hash from orders"
    ddl = [(n, c.split(" ", 1)[0], c.split(" ", 1)[1]) for n, cs in (("registry", ["version string", "created_at timestamp", "train_window struct<lower:timestamp,upper:timestamp>", "data_sha256 string", "metrics map<string,double>", "status string", "feature_list array<string>"]), ("scores", ["lead_id string", "asof timestamp", "model_version string", "probability float", "band string", "reasons array<struct<en:string,hi:string>>", "scored_at timestamp"])) for c in cs]
    q["table_ddl"] = f"select * from (values {base._rows(ddl)}) v(name, \"column\", type)"
    lit = lambda v: f"md5(concat('[', array_to_string(list_transform({v}, lambda x: printf('%.8f', x::double)), ','), ']'))"
    q["vector_store"] = f"select vec_id as lead_id, {lit('case when vec_id % 3 = 0 and vec_id % 2 = 1 then list_transform(embedding, lambda y: -y) else embedding end')} as literal from embeddings"
    q["outcome_upsert"] = "select doc_id as lead_id, (case when doc_id % 2 = 0 then toxic else quality end)::int as outcome from labels"
    q["score_log"] = "select v as model_version, count(*) as n, count(*) as dated, count(distinct o_orderkey) as leads from orders, (values ('v1'), ('v2')) t(v) group by v"
    q["append_and_size"] = "select o_orderkey::varchar as lead_id, case when o_orderkey % 2 = 0 then o_custkey % 5 + 1 else 1 end as cluster_size from orders"
    q["score_history"] = "select o_orderkey::varchar as lead_id, 'v2' as model_version, epoch(o_orderdate)::bigint as scored from orders order by o_orderdate desc, o_orderkey::varchar limit 25"
    q["score_stream"] = "select 'v1' as model_version, 'P1' as band, count(*) as n, count(distinct o_orderkey) as leads from orders"
    status = "case r_regionkey when 2 then 'champion' when 1 then 'retired' else 'challenger' end"
    q["registry_register"] = f"select concat('v', r_regionkey) as version, case r_regionkey when 3 then 'retired' else {status} end as status, sha256(r_name) as data_sha256 from region"
    q["registry_card"] = f"select 'v3' as version, '[2024-01-01T00:00:00Z,2024-01-04T00:00:00Z]' as train_window, concat('{{\"pr_auc\":', r_regionkey / 8, '}}') as metrics, {status} as status from region where r_regionkey = 3"
    q["registry_versions"] = "select concat('v', r_regionkey) as version from region order by r_regionkey desc limit 3"
    q["registry_champion"] = "select concat('v', r_regionkey) as version, concat('a,', lower(r_name)) as features from region where r_regionkey = 2"
    q["registry_promotion"] = "select concat('v', r_regionkey) as version, case r_regionkey when 4 then 'champion' when 2 then 'retired' when 1 then 'retired' else 'challenger' end as status from region"
    q["health"] = "select * from (values ('full', true, true), ('no champion', true, false), ('absent', false, false)) v(registry, \"database\", model)"
    dup = lambda c, t: f"(select count(*) > count(distinct {c}) from {t})"
    raised = {"columns": "true", "strict_columns": "true", "not_null": "exists (select 1 from documents where doc_id not in (select doc_id from labels))", "allowed": "exists (select 1 from orders where o_orderstatus not in ('F', 'O'))", "at_least_zero": "exists (select 1 from customer where c_acctbal < 0)", "unique": dup("o_custkey", "orders"), "unique_holds": dup("o_orderkey", "orders"), "complete": "exists (select 1 from documents where doc_id not in (select doc_id from labels))", "none_of": "true", "both_classes": "exists (select 1 from labels)", "binary_labels": "exists (select 1 from embeddings where label is null or label not in (0, 1))", "disjoint": "exists (select 1 from orders group by o_custkey having count(distinct o_orderstatus) > 1)", "disjoint_holds": "exists (select 1 from orders group by o_orderkey having count(distinct o_orderstatus) > 1)", "join_one_to_one": "(select count(*) > 1 from nation)", "to_integer": "exists (select 1 from orders where try_cast(o_orderpriority as bigint) is null)", "frozen_rule": "true", "frozen_rule_holds": "false", "relaxed": "true", "unknown_stage": "exists (select 1 from orders)"}
    q["contract_errors"] = " union all ".join(f"select '{n}' as \"check\", {x} as raised" for n, x in raised.items())
    count = lambda t, check, col, cond: f"select '{check}' as \"check\", '{col}' as \"column\", (select count(*) from {t} where {cond}) as bad, '{t}' as name"
    q["contract_ledger"] = " union all ".join([count("orders", "not_null", "o_orderkey", "o_orderkey is null"), count("orders", "allowed", "o_orderstatus", "o_orderstatus not in ('F', 'O')"), count("orders", "at_least_zero", "o_totalprice", "o_totalprice < 0"), count("orders", "integer", "o_orderpriority", "try_cast(o_orderpriority as bigint) is null"), count("customer", "not_null", "c_name", "c_name is null"), count("customer", "at_least_zero", "c_acctbal", "c_acctbal < 0"), count("customer", "integer", "c_custkey", "false"), count("embeddings", "binary", "label", "label is null or label not in (0, 1)"), *[f"select 'unique', '{c}', (select count(*) - count(distinct {c}) from orders), 'orders'" for c in ("o_orderkey", "o_custkey")]])
    q["presence_flags"] = "select doc_id as lead_id, case when trim(coalesce(text, ''), ' ') <> '' then 1 else 0 end as has_text, case when quality is null then 1 else 0 end as quality_missing from documents left join labels using (doc_id)"
    ct = "ct as (select " + ", ".join(f"{x} as {n}" for n, x in CONTACTS.items()) + " from customer)"
    norm = "nm as (select id, phone as raw, g, case when g like '0091%' then substr(g, 5) when length(g) = 12 and g like '91%' then substr(g, 3) when length(g) = 11 and g like '0%' then substr(g, 2) else g end as h, nullif(lower(trim(email)), '') as email, nullif(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'), '') as name from (select *, regexp_replace(phone, '\\D', '', 'g') as g from ct))"
    q["prepare_leads"] = f"with {ct}, {norm} select id as lead_id, case when length(h) = 10 then h end as phone_norm, email as email_norm, name as name_norm from nm"
    q["phone_shapes"] = f"with {ct} select case when regexp_matches(phone, '^\\+91[\\s-]?\\d{{5}}[\\s-]?\\d{{5}}$') then '+91' when regexp_matches(phone, '^0\\d{{10}}$') then 'leading zero' when regexp_matches(phone, '^\\d{{10}}$') then 'ten digits' when regexp_matches(phone, '^\\d{{5}}[\\s-]\\d{{5}}$') then 'spaced' else 'other' end as shape, count(*) as n from ct where phone is not null group by 1"
    q["token_prefix_names"] = f"with {ct}, {norm} select id, true as cut, starts_with(name, 'customer') as whole from nm"
    email = "regexp_replace(coalesce({0}, ''), '\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b', '[EMAIL]', 'gi')"
    phone = "'(^|[^0-9])(?:\\+91[\\s-]?)?[6-9]\\d{9}([^0-9]|$)', '\\1[PHONE]\\2', 'g'"
    masked = lambda t: f"regexp_replace(regexp_replace({email.format(t)}, {phone}), {phone})"
    q["mask_contacts_documents"] = f"select doc_id, md5({masked('text')}) as masked from documents"
    text = "concat_ws(' ', phone, phone, 'x', email)"
    q["mask_contacts_customers"] = f"with {ct} select id, {masked(text)} as masked from ct"
    q["keyword_flags_documents"] = "select doc_id, " + ", ".join(f"{base._flag('text', w)} as kw_{k}" for k, w in C.KEYWORDS.items()) + " from documents"
    q["cluster_sizes"] = "select o_orderkey as lead_id, case when o_orderkey % 2 = 0 then o_custkey % 5 + 1 else 1 end as cluster_size from orders"
    q["reindex_labels"] = "select doc_id as lead_id, coalesce(toxic, -1)::int as toxic from documents left join labels using (doc_id)"
    q["requested_scores"] = "with f as (select o_orderstatus, min(o_orderkey) as k from orders group by 1), r as (select (row_number() over (order by o_orderstatus desc) - 1)::int as pos, k from f), a as (select * from r union all select (select count(*) from r)::int, k from r where pos = 0) select a.pos, o_orderkey::varchar as lead_id, o_totalprice from a join orders on o_orderkey = k"
    q["confusion"] = f"with {base._SCORES}, c as (select count(*) filter (y = 1 and p >= 0.4) as tp, count(*) filter (y = 0 and p >= 0.4) as fp, count(*) filter (y = 1 and p < 0.4) as fn, count(*) filter (y = 0 and p < 0.4) as tn from sc) select *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) as recall from c"
    stratum = "case when phone_match and email_match then 'both_keys' when phone_match then 'phone_only' when email_match then 'email_only' else 'other' end"
    q["fresh_audit"] = f"with {base._PERSONS}, s as (select a, b, {stratum} as stratum from ev where a % 2 <> 0), r as (select *, row_number() over (partition by stratum order by md5(concat('42:', a, ':', b)), a, b) as k from s) select a, b, stratum from r where k <= case stratum when 'both_keys' then 3 when 'phone_only' then 7 when 'email_only' then 5 else 0 end"
    order = f"{base._PERSONS}, ap as (select pr.*, (y.created_at, b) < (x.created_at, a) as swapped from pr join pe x on x.lead_id = a join pe y on y.lead_id = b), au as (select case when swapped then b else a end as a, case when swapped then a else b end as b, case reasons when 'email+phone' then 'both_keys' else reasons || '_only' end as reason from ap)"
    q["audit_pairs"] = f"with {order} select a, b, reason from au"
    q["audit_evidence"] = f"with {order}, e as (select au.a, au.b, x.phone_norm = y.phone_norm as phone_match, x.email_norm = y.email_norm as email_match, x.name_norm = y.name_norm as name_exact from au join pe x on x.lead_id = au.a join pe y on y.lead_id = au.b) select *, name_exact as name_prefix_match, case when name_exact then 1.0 else 0.0 end::double as name_similarity, (phone_match and email_match) or name_exact as accepted from e"
    q["cluster_listing"] = f"with {base._CLUSTERS} select cluster, count(*) as size, string_agg(lead_id::varchar, ',' order by lead_id) as members from cl group by cluster order by min(lead_id), size limit 200"
    q["largest_clusters"] = f"with {base._CLUSTERS} select cluster, count(*) as size from cl group by cluster order by size desc, cluster limit 5"
    q["pairs_sorted"] = f"with {base._PERSONS} select a, b from pr order by a, b limit 100"
    q["hot_keys"] = f"with {base._PERSONS}, k as (select 'phone' as key, phone_norm as value, count(*) as n from pe group by 2 union all select 'email', email_norm, count(*) from pe group by 2) select *, n * (n - 1) // 2 as pairs from k where n > 2"
    q["clusters_star"] = f"with {base._CLUSTERS} select lead_id, cluster from cl"
    q["golden_weak_reasons"] = f"with {base._CLUSTERS}, z as (select distinct cluster from ev join cl on cl.lead_id = ev.a where not (phone_match and email_match)), k as (select cluster, count(*) as n from cl group by cluster) select lead_id, n >= 4 or z.cluster is not null as weak_cluster, concat_ws('; ', case when n >= 4 then 'cluster size ' || n end, case when z.cluster is not null then 'single key pair' end) as weak_reason from cl join k using (cluster) left join z using (cluster)"
    q["dedupe_summary_capped"] = f"with {base._PERSONS} select (select count(*) from pe) as leads, count(*) as candidate_pairs, count(*) as decided, true as within_cap, true as forest from pr"
    q["lead_detail"] = f"with {base._SCORES}, {base._PERSONS} select lead_id, source, branch, source as course_interest, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, round(p, 6) as probability from pe join sc using (lead_id) where lead_id = (select max(o_orderkey) from orders)"
    hour = "case when o_custkey % 24 > 0 then 'Enquiry arrived around ' || lpad((o_custkey % 24)::varchar, 2, '0') || ':00' end"
    parts = f"""list_filter([struct_pack(s := -0.75, f := 'cat__source_F', en := case when o_orderstatus = 'F' then 'Lead came from F' end, hi := 'Lead F se aaya hai'),
        struct_pack(s := -abs((o_custkey % 24) * -0.03125), f := 'num__creation_hour', en := {hour}, hi := 'Enquiry lagbhag ' || lpad((o_custkey % 24)::varchar, 2, '0') || ':00 baje aayi'),
        struct_pack(s := -(o_custkey % 3) * 0.5, f := 'num__kw_fee', en := case when o_custkey % 3 = 1 then 'Asked about fees' end, hi := 'Fees ke baare mein poocha')], lambda x: x.en is not null)"""
    q["score_batch_full"] = f"with s as (select *, 1 / (1 + exp(-(o_totalprice / 1e5 * 0.8 - 1.5))) as r, list_sort({parts}) as l from orders), t as (select *, least(greatest(r, 1e-6), 1 - 1e-6) as c from s), u as (select *, 1 / (1 + exp(-(0.9 * ln(c / (1 - c)) - 0.2))) as p from t) select o_orderkey as lead_id, o_orderdate + interval 24 hour as asof, 'v1' as model_version, round(p, 6) as probability, case when p >= 0.6 then 'P1' when p >= 0.3 then 'P2' else 'P3' end as band, case when o_orderkey % 2 = 0 then o_custkey % 5 + 1 else 1 end as duplicate_cluster_size, coalesce(l[1].en, '') as en1, coalesce(l[3].hi, '') as hi3 from u"
    q["reason_sentences"] = _sentence_sql()
    knn = "src as (select * from embeddings order by vec_id desc limit 1)"
    q["knn_unlabelled"] = f"with {knn} select e.vec_id as lead_id, round(list_cosine_similarity(e.embedding::double[], src.embedding::double[]), 6) as similarity, e.label % 2 as outcome from embeddings e, src where e.vec_id <> src.vec_id and e.label < 8 order by similarity desc, e.vec_id limit 50"
    old = base.oracle_sql()
    wide = old["feature_matrix"].replace("from leads l left join mf", ", coalesce(d, (select quantile_cont(d, 0.5) from dim)) as min_dist_to_branch, case when d is null then 1 else 0 end as locality_match_missing, (row_number() over (partition by user_id order by created_at, lead_id) - 1)::int as earlier_enquiries_count, case when props is null or json_extract_string(props, '$.k') is null then 0 else 1 end as has_home_locality, case when user_id % 4 > 0 then 0 else 1 end as age_missing from leads l left join dim on locality = 'n' || (json_extract_string(props, '$.k')::int % 30) left join mf").replace(" select l.lead_id, hour", ", dim as (select 'n' || n_nationkey as locality, least(n_nationkey * 1.5::double, n_regionkey * 4.0::double + 1) as d from nation) select l.lead_id, hour")
    q["feature_matrix_full"] = wide
    split = "case when created_at < timestamp '2024-01-18' then 'train' when created_at < timestamp '2024-01-23 06:00:00' then 'validation' when created_at < timestamp '2024-01-25' then 'calibration' end"
    q["dataset_assembly"] = f"with {base._BASE} select lead_id, target, {split} as split, coalesce(n_in, 0) as inbound_msg_count_before_t, (row_number() over (partition by user_id order by created_at, lead_id) - 1)::int as earlier_enquiries_count, created_at from lab left join mf using (lead_id) where is_mature"
    q["isotonic_fit"] = f"with {base._SCORES}, g as (select round(p, 2) as p, count(*) as n, sum(y) as pos from sc group by 1), r as (select *, row_number() over (order by p) as k, sum(n) over (order by p) as cn, sum(pos) over (order by p) as cp from g), ab as (select a.k as a, b.k as b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) as m from r a join r b on a.k <= b.k), ak as (select a, r.k, min(m) as m from ab join r on r.k between a and b group by a, r.k), iso as (select k, max(m) as v from ak group by k) select lead_id, round(v, 6) as p from sc join r on r.p = round(sc.p, 2) join iso using (k)"
    q["fits_settled"] = "select * from (values ('platt', true, true), ('logistic', true, true)) v(model, mean_settled, slope_settled)"
    q["pca_axes"] = "select true as uncorrelated, true as falling, true as centred"
    q["l2_normalize_all"] = "with e as (select vec_id, embedding::double[] as v from embeddings), n as (select *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) as r from e) select vec_id, (unnest(range(len(v))))::int as k, round(unnest(v) / r, 6) as x from n"
    q["masked_mean"] = "with e as (select vec_id, embedding::double[] as v, vec_id % 2 as m from embeddings), k as (select *, unnest(range(3))::int as k from e) select vec_id, k, round((v[k + 1] + m * v[k + 7]) / (1 + m), 6) as x from k"
    q["vector_literals"] = f"select vec_id, {lit('embedding')} as literal from embeddings"
    q["latest_vectors"] = f"select label, vec_id as asof, {lit('embedding')} as literal from embeddings qualify row_number() over (partition by label order by vec_id desc) = 1"
    q["parse_times"] = f"select event_id, {sec} - 19800 as naive, {sec} as instant, epoch_us(ts) // 1000 as ms, {sec} - 19800 as lenient, case when event_id % 2 = 0 then {sec} else -1 end as or_now from events"
    q["model_reports"] = _report_sql()
    return q


def _sentence_sql() -> str:
    """A row of each feature that has something to say, from the fixed sentences."""
    out = []
    esc = lambda t: t.replace("'", "''")
    fill = lambda t, v: "concat('" + esc(t).replace("{}", f"', {v}, '") + "')"
    add = lambda f, cond, en, hi: out.append(f"select o_orderkey as lead_id, '{f}' as feature, {en} as en, {hi} as hi from orders where {cond}")
    for f, (en, hi) in explain.FLAGS.items():
        add(f"num__{f}", f"{SENTENCES[f]} = 1", f"'{esc(en)}'", f"'{esc(hi)}'")
    for f, (en, hi, how, zero) in explain.NUMBERS.items():
        v = f"coalesce({SENTENCES[f]}, 0)"
        shown = f"lpad(({v})::varchar, 2, '0')" if how == "%02d" else f"printf('%.1f', round_even(({v})::decimal(9, 2), 1)::double)" if how == ".1" else f"({v})::bigint"
        add(f"num__{f}", "true" if zero else f"{SENTENCES[f]} is not null", fill(en, shown), fill(hi, shown))
    for f, (said, silent) in explain.LATENCIES.items():
        v = SENTENCES[f]
        add(f"num__{f}", f"{v} >= 0", fill(said[0], f"({v})"), fill(said[1], f"({v})"))
        add(f"num__{f}", f"{v} < 0", f"'{esc(silent[0])}'", f"'{esc(silent[1])}'")
    days = [", ".join(f"'{x[k]}'" for x in explain.WEEKDAYS) for k in (0, 1)]
    add("num__creation_weekday", "true", f"concat('Enquiry arrived on ', [{days[0]}][o_orderkey % 7 + 1])", f"concat('Enquiry ', [{days[1]}][o_orderkey % 7 + 1], ' ko aayi')")
    for f, (c, b, v) in zip(ONE_HOT, (("o_orderstatus", "source", "F"), ("o_orderstatus", "branch", "O"), ("o_orderpriority", "course", "1-URGENT"), ("o_orderpriority", "education_status", "5-LOW"))):
        en, hi = (t.replace("{}", v) for t in explain.CATEGORIES[b])
        add(f, f"{c} = '{v}'", f"'{esc(en)}'", f"'{esc(hi)}'")
    return " union all ".join(out)


def _report_sql() -> str:
    """The lines of both reports, with the numbers put in by SQL."""
    mark = {"brier": -1.5, "ece": -2.5}
    split = {f"{p}_{e}": f"{p} {e}" for p in ("train", "validation", "calibration") for e in ("min", "max")} | {"hidden_start": "2024-01-25"}
    text = training.model_card("trees", "platt", split, mark) + training.evaluation_report("run", {"rows": "ROWS"}, {"brier": mark["brier"], "none": None}, {}, "trees", mark, {"p1": 0.5, "p2": 0.25}, 3, "platt")
    rows = ", ".join(f"({k}, '{x}')" for k, x in enumerate(text.split("\n")))
    bins = f"{base._SCORES}, bi as (select {base._BINS} as bin, count(*) as n, avg(p) as mp, avg(y) as ob from sc group by 1), m as (select printf('%.6f', (select avg((p - y) ** 2) from sc)) as brier, printf('%.6f', sum(n * abs(mp - ob)) / sum(n)) as ece, (select count(*) from sc)::varchar as n from bi)"
    return f"with {bins} select k::bigint as k, replace(replace(replace(line, '-1.500000', brier), '-2.500000', ece), 'ROWS', m.n) as line from (values {rows}) v(k, line), m"

