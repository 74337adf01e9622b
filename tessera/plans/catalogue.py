"""Registered queries of the analytics library, each with its SQL. The star schema's tables stand for the datasets:
signups are enquiries, clicks and views of the same user messages, errors calls, purchases the target stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import explain, labels, metrics, model, pit, registry, reports, resolve, serving
from tessera.sources import files
from tessera.sources.tables import table

WORDS = {"low": ("1", "2", "3"), "mid": ("50", "51", "52"), "key": ("k",)}
DAYS, HIDDEN = 3, "2024-01-25 00:00:00"


def _leads(s, d):
    return table(s, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("lead_id"), "user_id", F.col("ts").alias("created_at"), "props", "value")


def _messages(s, d):
    click = F.col("event_type") == "click"
    return table(s, d, "events").where("event_type in ('click', 'view')").select(F.col("event_id").alias("message_id"), "user_id", F.col("ts").alias("sent_at"), F.when(click, "inbound").otherwise("outbound").alias("direction"), F.when(click, "lead").otherwise("assistant").alias("sender_type"), F.col("props").alias("text"))


def _calls(s, d):
    return table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("call_id"), "user_id", F.col("ts").alias("started_at"), F.col("value").alias("duration_sec"), F.when(F.col("value") >= 60, "answered").otherwise("no_answer").alias("outcome"))


def _stages(s, d):
    return table(s, d, "events").where("event_type = 'purchase'").select("user_id", F.lit("won").alias("stage"), F.col("ts").alias("changed_at"))


def _export(s, d):
    return F.lit(table(s, d, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


def _labelled(s, d, only_mature=True):
    return labels.label_maturity(_leads(s, d), _stages(s, d), _export(s, d), DAYS, "won", only_mature, "user_id")


def _scores(s, d):
    o = table(s, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("m"))
    return o.join(F.broadcast(top)).select(F.col("o_orderkey").alias("lead_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / F.col("m")).alias("p"))


def _persons(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("lead_id"), F.concat_ws("-", "o_custkey", "o_orderpriority", "o_orderstatus").alias("phone_norm"), F.concat_ws("-", F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM")).alias("email_norm"), F.col("o_orderstatus").alias("name_norm"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("course_interest"), F.col("o_orderdate").alias("created_at"))


def _pairs(s, d):
    return resolve.candidate_pairs(_persons(s, d), {"phone": "phone_norm", "email": "email_norm"})


def _evidence(s, d):
    return resolve.evidence(_pairs(s, d), _persons(s, d))


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _values(s, rows, ddl):
    return s.createDataFrame(rows, ddl)


CONTACTS = [(1, "+91 98765 43210", " Asha@Example.COM ", "  Asha   Patel "), (2, "09876543210", "asha@example.com", "asha patel"), (3, "00919876543210", "", "RAHUL"), (4, "12345", None, " "), (5, "919876543210", "x@y.z", "A B C"), (6, None, " q@r.s", None)]
NAMES = [(1, "a b", "ann bell cole"), (2, "asha", "asha"), (3, "ra sh", "rahul shah verma"), (4, "x y", "rahul shah verma"), (5, None, "a"), (6, "asha patel", "asha")]
TEXTS = [(1, "call 9876543210 or mail a.b@c.co now"), (2, "98765 43210"), (3, "+91 9876543210, X@Y.ORG"), (4, ""), (5, "fee and EMI for weekend batch"), (6, "not interested, price is high")]
MODELS = [("v1", "champion", 0.30, 0.05), ("v2", "challenger", 0.35, 0.04), ("v3", "challenger", 0.20, 0.01)]


def _registry(s):
    rows = [(v, st, {"pr_auc": a, "ece": e}) for v, st, a, e in MODELS]
    df = s.createDataFrame(rows, "version string, status string, metrics map<string,double>")
    return df.select("version", F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("struct<lower:timestamp,upper:timestamp>").alias("train_window"), F.lit("").alias("data_sha256"), "metrics", "status", F.array(F.lit("a")).alias("feature_list"))


def _knn(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("lead_id"), "embedding", F.col("vec_id").alias("asof"), (F.col("label") % 2).alias("outcome"))
    first = e.agg(F.min("lead_id")).first()[0]
    return serving.similar(e.drop("outcome"), e.select("lead_id", "outcome"), first, 10)


def _call_list(s, d):
    x = _scores(s, d).join(_persons(s, d).select("lead_id", "branch", "source", "created_at"), "lead_id").withColumn("probability", F.round("p", 6)).withColumn("band", C.band(F.col("p"), 0.8, 0.4))
    return serving.call_list(x, F.lit("1998-08-02 00:00:00").cast("timestamp"))


def _members(s, d):
    """Uncapped clusters: a cap above the largest component."""
    return resolve.clusters(_persons(s, d), _pairs(s, d).select("a", "b"), 10**9)[0]


def _golden(s, d):
    people = _persons(s, d)
    stages = people.select("lead_id", F.when(F.col("branch") == "F", "Admission Done").when(F.col("branch") == "O", "Contacted").otherwise("New").alias("stage"), F.col("created_at").alias("changed_at"))
    return resolve.golden(people, _members(s, d), stages)


def _reasons(s, d):
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("lead_id"), F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 3).cast("int").alias("kw_fee"), (F.col("o_custkey") % 24).cast("int").alias("creation_hour"), (F.col("o_totalprice") / 1000).alias("min_dist_to_branch"))
    parts = {"num__kw_fee": F.col("kw_fee") * 0.5, "cat__source_F": F.when(F.col("source") == "F", 0.75).otherwise(0.0), "num__creation_hour": F.col("creation_hour") * -0.03125}
    r = explain.top_reasons(parts, x.columns)
    return x.select("lead_id", *[r[k]["en"].alias(f"en{k + 1}") for k in range(3)], r[0]["hi"].alias("hi1"))


def queries() -> dict:
    q = {}
    q["feature_matrix"] = lambda s, d: _r(pit.feature_matrix(_leads(s, d), _messages(s, d), _calls(s, d), keywords=WORDS, key="user_id"), "mean_msg_len_before_t", *pit.LATENCIES).drop("user_id", "props", "value")
    q["pit_event_counts"] = lambda s, d: pit.message_features(_leads(s, d), _messages(s, d), WORDS, key="user_id").select("lead_id", "inbound_msg_count_before_t", "outbound_msg_count_before_t", F.round("mean_msg_len_before_t", 6).alias("mean_msg_len_before_t"))
    q["pit_reply_latency"] = lambda s, d: _r(pit.message_features(_leads(s, d), _messages(s, d), WORDS, key="user_id").select("lead_id", "mins_to_first_lead_reply_after_assistant").where("mins_to_first_lead_reply_after_assistant is not null"), "mins_to_first_lead_reply_after_assistant")
    q["pit_call_features"] = lambda s, d: _r(pit.call_features(_leads(s, d), _calls(s, d), "user_id"), "mins_to_first_counselor_call")
    q["lead_text"] = lambda s, d: pit.lead_text(_leads(s, d), _messages(s, d), 4, "head", "user_id")
    q["calendar_features"] = lambda s, d: pit.calendar_features(_leads(s, d))
    q["locality_features"] = lambda s, d: pit.locality_features(_leads(s, d).withColumn("home_locality", F.concat(F.lit("n"), F.get_json_object("props", "$.k").cast("int") % 30)), table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("locality"), (F.col("n_nationkey") * 1.5).alias("d1"), (F.col("n_regionkey") * 4.0 + 1).alias("d2")), ["d1", "d2"])
    q["labels_maturity"] = lambda s, d: _labelled(s, d, False)
    q["target_vector"] = lambda s, d: labels.target_vector(_leads(s, d), _stages(s, d), DAYS, "won", "user_id")
    q["mature_semi_join"] = lambda s, d: labels.semi(_leads(s, d).select("lead_id", "user_id"), _labelled(s, d))
    q["time_split"] = lambda s, d: labels.time_split(_leads(s, d).select("lead_id", "created_at"), HIDDEN, 1, 0.25)
    q["split_summary"] = lambda s, d: labels.describe_split(labels.time_split(_leads(s, d), HIDDEN, 1, 0.25))
    q["earlier_enquiries"] = lambda s, d: pit.earlier_enquiries(_leads(s, d), _leads(s, d).select("lead_id", F.col("user_id").alias("cluster_id")))
    q["group_rates"] = lambda s, d: _r(reports.group_rates(_labelled(s, d).join(_leads(s, d).select("lead_id", (F.col("user_id") % 7).alias("source")), "lead_id"), "source"), "rate")
    q["overall_rate"] = lambda s, d: _r(reports.group_rates(_labelled(s, d)), "rate")
    q["first_call_by_month"] = lambda s, d: _r(reports.first_call_by_month(_leads(s, d), _calls(s, d).join(_leads(s, d).select("user_id", "lead_id"), "user_id")), "mean_hours", "median_hours")
    q["silent_enquiries"] = lambda s, d: _r(reports.silent(_leads(s, d), pit.in_window(_leads(s, d), _messages(s, d), "sent_at", key="user_id")), "per_cent")
    q["duplicate_identifiers"] = lambda s, d: reports.duplicate_identifiers(_persons(s, d), {"phone": F.col("phone_norm"), "email": F.col("email_norm")})
    q["trap_audit"] = lambda s, d: reports.trap_audit(_leads(s, d), _calls(s, d), pit.FORBIDDEN, DAYS)
    q["normalize_contacts"] = lambda s, d: _values(s, CONTACTS, "id int, phone string, email string, name string").select("id", C.normalize_phone(F.col("phone")).alias("phone"), C.normalize_email(F.col("email")).alias("email"), C.normalize_name(F.col("name")).alias("name"))
    q["token_prefix"] = lambda s, d: _values(s, NAMES, "id int, a string, b string").select("id", C.token_prefix(F.col("a"), F.col("b")).alias("prefix"))
    q["mask_email_documents"] = lambda s, d: table(s, d, "documents").select("doc_id", F.md5(C.mask_email(F.col("text"))).alias("masked"))
    q["keyword_flags"] = lambda s, d: _values(s, TEXTS, "id int, text string").select("id", *[C.keyword_flag(F.col("text"), w).alias(f"kw_{k}") for k, w in C.KEYWORDS.items()])
    q["truncate_head"] = lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role", C.truncate_tokens(F.col("text"), 5, "head").alias("text"))
    q["truncate_tail"] = lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role", C.truncate_tokens(F.col("text"), 5, "tail").alias("text"))
    q["blocked_pairs"] = lambda s, d: _pairs(s, d).select("a", "b", F.concat_ws("+", "reasons").alias("reasons"))
    q["pair_evidence"] = lambda s, d: _evidence(s, d).select("a", "b", "phone_match", "email_match", "name_exact", "course_match", "grade", resolve.stratum().alias("stratum"))
    q["rule_sweep"] = lambda s, d: _r(resolve.rule_sweep(_evidence(s, d).withColumn("label", F.col("course_match").cast("int"))), "precision", "recall")
    q["anti_join_old_pairs"] = lambda s, d: _pairs(s, d).select("a", "b").join(_pairs(s, d).where("a % 2 = 0").select("a", "b"), ["a", "b"], "left_anti")
    q["clusters_uncapped"] = _members
    q["clusters_capped"] = lambda s, d: resolve.clusters(_persons(s, d), _pairs(s, d).select("a", "b"), 3)[0]
    q["golden_records"] = _golden
    q["dedupe_summary"] = lambda s, d: _r(resolve.summary(_persons(s, d), _pairs(s, d), _members(s, d)), "duplicate_rate")
    q["review_sample"] = lambda s, d: resolve.review_sample(_evidence(s, d), 150).drop("label", "note")
    q["brier"] = lambda s, d: _r(metrics.brier(_scores(s, d)), "brier")
    q["ece"] = lambda s, d: _r(metrics.calibration_error(_scores(s, d)), "ece")
    q["reliability"] = lambda s, d: _r(metrics.reliability(_scores(s, d)), "mean_predicted", "observed_rate")
    q["average_precision"] = lambda s, d: _r(metrics.average_precision(_scores(s, d)), "average_precision")
    q["roc_auc"] = lambda s, d: _r(metrics.roc_auc(_scores(s, d)), "roc_auc")
    q["lift_recall"] = lambda s, d: _r(metrics.lift_recall(_scores(s, d), 0.1, "lead_id"), "lift", "recall")
    q["metric_bundle"] = lambda s, d: _r(metrics.bundle(_scores(s, d), "lead_id"), "average_precision", "roc_auc", "lift_at_10", "recall_at_10", "lift_at_20", "recall_at_20", "brier", "ece")
    q["bands"] = lambda s, d: metrics.bands(_scores(s, d)).select("lead_id", "band")
    q["platt_apply"] = lambda s, d: _r(_scores(s, d).select("lead_id", model.Platt(0.9, -0.2)(F.col("p")).alias("p")), "p")
    q["knn_topk"] = _knn
    q["similar_summary"] = lambda s, d: serving.similar_summary(_knn(s, d))
    q["l2_normalize"] = lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(C.l2_normalize(F.col("embedding"))[0], 6).alias("x0"))
    q["latest_embedding"] = lambda s, d: serving.latest_per_key(table(s, d, "embeddings").select("label", F.col("vec_id").alias("asof")), "label", "asof")
    q["vector_upsert"] = lambda s, d: files.upsert(table(s, d, "embeddings").select("vec_id", F.lit("old").alias("version")), table(s, d, "embeddings").where("vec_id % 3 = 0").select("vec_id", F.lit("new").alias("version")), ["vec_id"])
    q["preprocess_numeric"] = lambda s, d: _r(model.standardise(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), model.numeric_parameters(table(s, d, "part"), ["p_size", "p_retailprice"])), "p_size", "p_retailprice")
    q["one_hot"] = lambda s, d: model.one_hot(table(s, d, "customer").select("c_custkey", "c_mktsegment"), table(s, d, "customer").where("c_custkey % 2 = 0"), "c_mktsegment")[0].drop("c_mktsegment")
    q["score_batch"] = lambda s, d: _r(model.score_batch(table(s, d, "orders").select(F.col("o_orderkey").alias("lead_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 1e5).alias("x")), model.scorecard(None, {"x": 0.8}, -1.5), None, 0.6, 0.3, "v1"), "probability")
    q["top3_reasons"] = _reasons
    q["registry_promote"] = lambda s, d: registry.promote(_registry(s), "v2").select("version", "status")
    q["lead_listing"] = lambda s, d: _r(serving.lead_listing(_persons(s, d), _scores(s, d).select("lead_id", F.col("p").alias("probability")), 5, 50), "probability")
    q["max_score_per_lead"] = lambda s, d: serving.max_score_per_lead(table(s, d, "orders").select(F.col("o_custkey").alias("lead_id"), F.col("o_totalprice").alias("probability")))
    q["call_list_filter"] = lambda s, d: _r(serving.filter_list(_call_list(s, d), {"branch": ["F", "O"], "band": []}, " urgent ", ["branch", "source"]).select("lead_id", "branch", "source", "probability", "band", "urgent", "age_hours", "waiting_minutes"), "age_hours", "waiting_minutes")
    q["kpi_rollup"] = lambda s, d: _r(serving.kpis(_call_list(s, d)), "avg_probability")
    q["facets"] = lambda s, d: serving.facet_options(table(s, d, "customer").select(F.col("c_mktsegment").alias("source")), "source", ["REFERRAL", "WALK-IN"])
    q["describe_columns"] = lambda s, d: _r(reports.describe(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "mean", "std")
    return q


# --- SQL -------------------------------------------------------------------------------------------

_BASE = """leads as (select event_id as lead_id, user_id, ts as created_at, props, value from events where event_type = 'signup'),
messages as (select event_id as message_id, user_id, ts as sent_at, case event_type when 'click' then 'inbound' else 'outbound' end as direction, props as text from events where event_type in ('click', 'view')),
calls as (select event_id as call_id, user_id, ts as started_at, value as duration_sec, case when value >= 60 then 'answered' else 'no_answer' end as outcome from events where event_type = 'error'),
stages as (select user_id, ts as changed_at from events where event_type = 'purchase'),
win as (select l.lead_id, l.created_at, m.* from leads l join messages m on m.user_id = l.user_id and m.sent_at >= l.created_at and m.sent_at < l.created_at + interval 24 hour),
firsts as (select lead_id, min(sent_at) filter (direction = 'outbound') as f from win group by lead_id),
mf as (select win.lead_id, count(*) filter (direction = 'inbound') as n_in, count(*) filter (direction = 'outbound') as n_out, coalesce(avg(length(text)) filter (direction = 'inbound'), 0.0) as mean_len,
  min(case when direction = 'inbound' and sent_at > f then epoch_us(sent_at) - epoch_us(f) end) / 6e7 as lat, coalesce(string_agg(text, ' ' order by sent_at, message_id) filter (direction = 'inbound'), '') as txt from win join firsts using (lead_id) group by win.lead_id),
cw as (select l.lead_id, l.created_at, c.* from leads l join calls c on c.user_id = l.user_id and c.started_at >= l.created_at and c.started_at < l.created_at + interval 24 hour where duration_sec >= 0),
cf as (select lead_id, count(*) as n_att, count(*) filter (outcome = 'answered') as n_ans, min(epoch_us(started_at) - epoch_us(created_at)) / 6e7 as first_call from cw group by lead_id),
lab as (select lead_id, user_id, created_at, created_at + interval 24 hour as t, case when exists (select 1 from stages s where s.user_id = l.user_id and s.changed_at >= l.created_at and s.changed_at <= l.created_at + interval 3 day) then 1 else 0 end as target,
  created_at <= (select max(ts) from events) - interval 3 day as is_mature from leads l)"""
_SCORES = "sc as (select o_orderkey as lead_id, case when o_orderstatus = 'F' then 1 else 0 end as y, o_totalprice / (select max(o_totalprice) from orders) as p from orders)"
_PERSONS = """pe as (select o_orderkey as lead_id, concat_ws('-', o_custkey, o_orderpriority, o_orderstatus) as phone_norm, concat_ws('-', o_custkey, strftime(o_orderdate, '%Y-%m')) as email_norm, o_orderstatus as name_norm, o_orderpriority as source, o_orderstatus as branch, o_orderdate as created_at from orders),
pr as (select a, b, string_agg(distinct reason, '+' order by reason) as reasons from (
  select x.lead_id as a, y.lead_id as b, 'phone' as reason from pe x join pe y on x.phone_norm = y.phone_norm and x.lead_id < y.lead_id union all
  select x.lead_id, y.lead_id, 'email' from pe x join pe y on x.email_norm = y.email_norm and x.lead_id < y.lead_id) group by a, b),
ev as (select pr.a, pr.b, x.phone_norm = y.phone_norm as phone_match, x.email_norm = y.email_norm as email_match, x.name_norm = y.name_norm as name_exact, x.source = y.source as course_match from pr join pe x on x.lead_id = a join pe y on y.lead_id = b)"""
_CLUSTERS = _PERSONS + """, sym as (select a, b from pr union all select b, a from pr),
walk as (with recursive w(a, b) as (select a, b from sym union select w.a, sym.b from w join sym on w.b = sym.a) select a, min(least(a, b)) as c from w group by a),
cl as (select lead_id, least(lead_id, coalesce(walk.c, lead_id)) as cluster from pe left join walk on walk.a = pe.lead_id)"""
_BINS = "+".join(f"(case when p >= {k / 10!r}::double then 1 else 0 end)" for k in range(1, 10))
_CALLS = "cx as (select sc.*, pe.branch, pe.source, pe.created_at, round(p, 6) as probability, case when p >= 0.8 then 'P1' when p >= 0.4 then 'P2' else 'P3' end as band, (epoch_us(timestamp '1998-08-02 00:00:00') - epoch_us(pe.created_at)) / 6e7 as wait from sc join pe using (lead_id)), cy as (select *, least(greatest(wait / 60, 0.0), 8640.0) as age_hours, greatest(wait, 0.0) as waiting_minutes, band = 'P1' and wait > 15 as urgent from cx)"


def _rows(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _flag(text: str, words: tuple[str, ...]) -> str:
    alternatives = "|".join(w.replace("'", "''") for w in words)
    return f"(case when regexp_matches(lower({text}), '\\b({alternatives})\\b') then 1 else 0 end)"


def oracle_sql() -> dict:
    q = {}
    flags = ", ".join(f"coalesce({_flag('txt', w)}, 0) as kw_{k}" for k, w in WORDS.items())
    q["feature_matrix"] = f"with {_BASE} select l.lead_id, hour(created_at)::int as creation_hour, (isodow(created_at) - 1)::int as creation_weekday, coalesce(n_in, 0) as inbound_msg_count_before_t, coalesce(n_out, 0) as outbound_msg_count_before_t, round(coalesce(mean_len, 0.0), 6) as mean_msg_len_before_t, round(coalesce(lat, -1.0), 6) as mins_to_first_lead_reply_after_assistant, case when trim(coalesce(txt, '')) <> '' then 1 else 0 end as has_inbound_text_before_t, {flags}, coalesce(n_att, 0) as calls_attempted_before_t, coalesce(n_ans, 0) as calls_answered_before_t, round(coalesce(first_call, -1.0), 6) as mins_to_first_counselor_call from leads l left join mf using (lead_id) left join cf using (lead_id)"
    q["pit_event_counts"] = f"with {_BASE} select lead_id, n_in as inbound_msg_count_before_t, n_out as outbound_msg_count_before_t, round(mean_len, 6) as mean_msg_len_before_t from mf"
    q["pit_reply_latency"] = f"with {_BASE} select lead_id, round(lat, 6) as mins_to_first_lead_reply_after_assistant from mf where lat is not null"
    q["pit_call_features"] = f"with {_BASE} select lead_id, n_att as calls_attempted_before_t, n_ans as calls_answered_before_t, round(first_call, 6) as mins_to_first_counselor_call from cf"
    q["lead_text"] = f"with {_BASE}, j as (select lead_id, string_agg(trim(text), chr(10) order by sent_at, message_id) as text from win where direction = 'inbound' group by lead_id), k as (select lead_id, coalesce(j.text, '') as text, list_filter(string_split_regex(coalesce(j.text, ''), '\\s+'), lambda x: x <> '') as w from leads left join j using (lead_id)) select lead_id, case when len(w) > 4 then array_to_string(w[1:4], ' ') else text end as text, case when text <> '' then 1 else 0 end as has_text from k"
    q["calendar_features"] = f"with {_BASE} select lead_id, hour(created_at)::int as creation_hour, (isodow(created_at) - 1)::int as creation_weekday from leads"
    q["locality_features"] = f"with {_BASE}, dim as (select 'n' || n_nationkey as locality, least(n_nationkey * 1.5::double, n_regionkey * 4.0::double + 1) as d from nation) select lead_id, coalesce(d, (select quantile_cont(d, 0.5) from dim)) as min_dist_to_branch, case when d is null then 1 else 0 end as locality_match_missing from leads left join dim on locality = 'n' || (json_extract_string(props, '$.k')::int % 30)"
    q["labels_maturity"] = f"with {_BASE} select lead_id, created_at, t, target, is_mature from lab"
    q["target_vector"] = f"with {_BASE} select lead_id, target from lab"
    q["mature_semi_join"] = f"with {_BASE} select lead_id, user_id from lab where is_mature"
    split = "case when created_at < timestamp '2024-01-18' then 'train' when created_at < timestamp '2024-01-23 06:00:00' then 'validation' when created_at < timestamp '2024-01-25' then 'calibration' end"
    q["time_split"] = f"with {_BASE} select lead_id, created_at, {split} as split from leads"
    q["split_summary"] = f"with {_BASE} select * from (select {split} as split, count(*) as rows, min(created_at) as first, max(created_at) as last from leads group by 1) where split is not null"
    q["earlier_enquiries"] = f"with {_BASE} select lead_id, (row_number() over (partition by user_id order by created_at, lead_id) - 1)::int as earlier_enquiries_count from leads"
    q["group_rates"] = f"with {_BASE} select user_id % 7 as source, count(*) as enquiries, sum(target)::bigint as admissions, round(avg(target), 6) as rate from lab where is_mature group by 1"
    q["overall_rate"] = f"with {_BASE} select count(*) as enquiries, coalesce(sum(target), 0)::bigint as admissions, round(avg(target), 6) as rate from lab where is_mature"
    q["first_call_by_month"] = f"with {_BASE}, f as (select l.lead_id, strftime(created_at, '%Y-%m') as month, min(epoch_us(started_at) - epoch_us(created_at)) / 6e7 / 60 as h from leads l join calls c on c.user_id = l.user_id and c.started_at >= l.created_at group by l.lead_id, created_at) select month, count(*) as n, round(avg(h), 6) as mean_hours, round(quantile_cont(h, 0.5), 6) as median_hours from f group by month"
    q["silent_enquiries"] = f"with {_BASE} select count(*) filter (lead_id not in (select lead_id from win)) as silent, count(*) as total, round(count(*) filter (lead_id not in (select lead_id from win)) * 100 / count(*), 6) as per_cent from leads"
    q["duplicate_identifiers"] = f"with {_PERSONS} select 'phone' as identifier, count(*) as repeated_values, sum(n)::bigint as rows_covered from (select count(*) as n from pe group by phone_norm) where n > 1 union all select 'email', count(*), sum(n)::bigint from (select count(*) as n from pe group by email_norm) where n > 1"
    q["trap_audit"] = f"with {_BASE} select (select count(*) - count(distinct lead_id) from leads) as repeated_ids, (select count(*) from calls where duration_sec < 0) as negative_durations, (select count(*) from leads where created_at > (select max(created_at) from leads) - interval 3 day) as immature, 0::bigint as forbidden_columns"
    digits = "regexp_replace(phone, '\\D', '', 'g')"
    q["normalize_contacts"] = f"with v(id, phone, email, name) as (values {_rows(CONTACTS)}), d as (select *, {digits} as g from v), e as (select *, case when g like '0091%' then substr(g, 5) when length(g) = 12 and g like '91%' then substr(g, 3) when length(g) = 11 and g like '0%' then substr(g, 2) else g end as h from d) select id, case when length(h) = 10 then h end as phone, nullif(lower(trim(email)), '') as email, nullif(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'), '') as name from e"
    q["token_prefix"] = f"with v(id, a, b) as (values {_rows(NAMES)}), t as (select id, string_split(a, ' ') as x, string_split(b, ' ') as y from v), o as (select id, case when len(x) < len(y) then x else y end as s, case when len(x) < len(y) then y else x end as l, len(x) <> len(y) as differ from t) select id, coalesce(differ and len(list_filter(range(1, len(s) + 1), lambda k: not starts_with(l[k], s[k]))) = 0, false) as prefix from o"
    q["mask_email_documents"] = "select doc_id, md5(regexp_replace(text, '\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[EMAIL]', 'gi')) as masked from documents"
    q["keyword_flags"] = f"with v(id, text) as (values {_rows(TEXTS)}) select id, " + ", ".join(f"{_flag('text', w)} as kw_{k}" for k, w in C.KEYWORDS.items()) + " from v"
    for name, cut in (("truncate_head", "w[1:5]"), ("truncate_tail", "w[-5:]")):
        q[name] = f"select conv_id, turn, role, case when len(w) > 5 then array_to_string({cut}, ' ') else text end as text from (select *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations)"
    q["blocked_pairs"] = f"with {_PERSONS} select a, b, reasons from pr"
    stratum = "case when phone_match and email_match then 'both_keys' when phone_match then 'phone_only' when email_match then 'email_only' else 'other' end"
    grade = "case when phone_match and email_match and name_exact then 'very_strong' when phone_match and email_match or name_exact then 'strong' else 'weak' end"
    q["pair_evidence"] = f"with {_PERSONS} select a, b, phone_match, email_match, name_exact, course_match, {grade} as grade, {stratum} as stratum from ev"
    # names have one letter, so their similarity is 0 or 1 and none begins another
    named, either = "(phone_match or email_match) and name_exact", "(phone_match and email_match) or ((phone_match or email_match) and name_exact)"
    rules = {"exact_key": "phone_match or email_match", "both_keys": "phone_match and email_match", "key_and_name": named, **{f"key_and_name_similarity_{k / 100:.2f}": named for k in range(50, 95, 5)}, "key_and_name_prefix": "false", "both_keys_or_key_and_name": either, "both_keys_or_name_prefix": "phone_match and email_match", "both_keys_or_exact_or_prefix": either}
    each = " union all ".join(f"select '{r}' as rule, course_match as t, {e} as g from ev" for r, e in rules.items())
    q["rule_sweep"] = f"with {_PERSONS}, x as ({each}), c as (select rule, count(*) filter (t and g) as tp, count(*) filter (not t and g) as fp, count(*) filter (t and not g) as fn, count(*) filter (not t and not g) as tn from x group by rule) select *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) as recall from c"
    q["anti_join_old_pairs"] = f"with {_PERSONS} select a, b from pr where a % 2 <> 0"
    q["clusters_uncapped"] = f"with {_CLUSTERS} select lead_id, cluster from cl"
    q["golden_records"] = f"""with {_CLUSTERS}, st as (select lead_id, case branch when 'F' then 'Admission Done' when 'O' then 'Contacted' else 'New' end as stage, case branch when 'F' then 7 when 'O' then 1 else 0 end as r, created_at from pe),
        a as (select cluster, min(row(created_at is null, created_at, pe.lead_id)) as o, count(*) as n, list_sort(list_distinct(list(source))) as s from pe join cl using (lead_id) group by cluster),
        b as (select cluster, first(stage order by r desc, created_at desc, lead_id desc) as best_stage, first(lead_id order by r desc, created_at desc, lead_id desc) as stage_source from st join cl using (lead_id) group by cluster),
        c as (select lead_id as canonical, created_at, cluster, row_number() over (partition by cluster order by created_at, lead_id) as k from pe join cl using (lead_id))
        select 'C_' || c.canonical as cluster_id, cl.lead_id, cl.lead_id = c.canonical as is_canonical, a.n as cluster_size, c.canonical as canonical_lead_id, best_stage, stage_source, '["' || array_to_string(a.s, '", "') || '"]' as sources, a.n >= 4 as weak_cluster, case when a.n >= 4 then 'cluster size ' || a.n else '' end as weak_reason
        from cl join a using (cluster) join b using (cluster) join c on c.cluster = cl.cluster and c.k = 1"""
    q["dedupe_summary"] = f"with {_CLUSTERS}, k as (select count(*) as n from cl group by cluster), s as (select (select count(*) from pe) as leads, (select count(*) from pr) as candidate_pairs, count(*) as clusters, count(*) filter (n > 1) as duplicate_clusters, coalesce(sum(n) filter (n > 1), 0)::bigint as duplicate_leads, count(*) filter (n >= 4) as large_clusters, max(n) as largest from k) select *, leads * (leads - 1) // 2 as naive_comparisons, leads * (leads - 1) // 2 - candidate_pairs as avoided, round(duplicate_leads / leads, 6) as duplicate_rate from s"
    h = f"{_PERSONS}, s as (select a, b, name_exact, {grade} as grade, {stratum} as stratum, md5(concat('42:', a, ':', b)) as h from ev), r as (select *, row_number() over (partition by stratum order by name_exact, h, a, b) as k from s), f as (select *, case when k > case stratum when 'other' then 0 else 50 end then 1 else 0 end as late from r where k <= 150)"
    q["review_sample"] = f"with {h} select a, b, stratum, grade from f order by late, h, a, b limit 150"
    q["brier"] = f"with {_SCORES} select round(avg((p - y) ** 2), 6) as brier from sc"
    bins = f"{_SCORES}, bi as (select {_BINS} as bin, count(*) as n, avg(p) as mp, avg(y) as ob from sc group by 1)"
    q["ece"] = f"with {bins} select round(sum(n * abs(mp - ob)) / sum(n), 6) as ece from bi"
    q["reliability"] = f"with {bins} select r.range::int as bin, coalesce(n, 0) as n, round(mp, 6) as mean_predicted, round(ob, 6) as observed_rate from range(10) r left join bi on bi.bin = r.range"
    cum = f"{_SCORES}, by_p as (select p, count(*) as n, sum(y) as pos from sc group by p), cu as (select *, sum(n) over (order by p desc) as cn, sum(pos) over (order by p desc) as cp from by_p)"
    q["average_precision"] = f"with {cum} select round(sum(pos * cp / cn) / (select sum(y) from sc), 6) as average_precision from cu"
    q["roc_auc"] = f"with {cum} select round(sum((n - pos) * (cp - pos + pos / 2)) / ((select sum(y) from sc) * (select count(*) - sum(y) from sc)), 6) as roc_auc from cu"
    q["lift_recall"] = f"with {_SCORES}, top as (select * from sc order by p desc, lead_id limit (select ceil(count(*) * 0.1)::bigint from sc)) select round((select avg(y) from top) / (select avg(y) from sc), 6) as lift, round((select sum(y) from top) / (select sum(y) from sc), 6) as recall"
    tops = ", ".join(f"t{f} as (select * from sc order by p desc, lead_id limit (select ceil(count(*) * 0.{f // 10})::bigint from sc))" for f in (10, 20))
    each = ", ".join(f"round((select avg(y) from t{f}) / (select avg(y) from sc), 6) as lift_at_{f}, round((select sum(y) from t{f}) / (select sum(y) from sc), 6) as recall_at_{f}" for f in (10, 20))
    q["metric_bundle"] = f"with {cum}, bi as (select {_BINS} as bin, count(*) as n, avg(p) as mp, avg(y) as ob from sc group by 1), {tops} select (select round(sum(pos * cp / cn) / (select sum(y) from sc), 6) from cu) as average_precision, (select round(sum((n - pos) * (cp - pos + pos / 2)) / ((select sum(y) from sc) * (select count(*) - sum(y) from sc)), 6) from cu) as roc_auc, {each}, (select round(avg((p - y) ** 2), 6) from sc) as brier, (select round(sum(n * abs(mp - ob)) / sum(n), 6) from bi) as ece"
    q["bands"] = f"with {_SCORES}, t as (select quantile_cont(p, 0.9) as p1, quantile_cont(p, 0.5) as p2 from sc) select lead_id, case when p >= p1 then 'P1' when p >= p2 then 'P2' else 'P3' end as band from sc, t"
    q["platt_apply"] = f"with {_SCORES}, z as (select lead_id, least(greatest(p, 1e-6), 1 - 1e-6) as c from sc) select lead_id, round(1 / (1 + exp(-(0.9 * ln(c / (1 - c)) - 0.2))), 6) as p from z"
    knn = "src as (select * from embeddings order by vec_id limit 1), kn as (select e.vec_id as lead_id, round(list_cosine_similarity(e.embedding::double[], src.embedding::double[]), 6) as similarity, e.label % 2 as outcome from embeddings e, src where e.vec_id <> src.vec_id and e.label is not null order by similarity desc, e.vec_id limit 10)"
    q["knn_topk"] = f"with {knn} select * from kn"
    q["similar_summary"] = f"with {knn} select coalesce(sum(outcome), 0)::bigint as admissions, count(*) as total from kn"
    q["l2_normalize"] = "select vec_id, round(embedding[1]::double / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 1e-12), 6) as x0 from embeddings"
    q["latest_embedding"] = "select label, max(vec_id) as asof from embeddings group by label"
    q["vector_upsert"] = "select vec_id, case when vec_id % 3 = 0 then 'new' else 'old' end as version from embeddings"
    q["preprocess_numeric"] = "select p_partkey, round((p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part), 6) as p_size, round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 6) as p_retailprice from part"
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    q["one_hot"] = "select c_custkey, " + ", ".join(f"(c_mktsegment = '{x}')::int as \"c_mktsegment_{x}\"" for x in segments) + " from customer"
    q["score_batch"] = "with s as (select *, 1 / (1 + exp(-(o_totalprice / 1e5 * 0.8 - 1.5))) as p from orders) select o_orderkey as lead_id, o_orderdate + interval 24 hour as asof, 'v1' as model_version, round(p, 6) as probability, case when p >= 0.6 then 'P1' when p >= 0.3 then 'P2' else 'P3' end as band, 1::bigint as duplicate_cluster_size from s"
    hour = "case when o_custkey % 24 > 0 then 'Enquiry arrived around ' || lpad((o_custkey % 24)::varchar, 2, '0') || ':00' end"
    parts = f"""list_filter([struct_pack(s := -0.75, f := 'cat__source_F', en := case when o_orderstatus = 'F' then 'Lead came from F' end, hi := 'Lead F se aaya hai'),
        struct_pack(s := -abs((o_custkey % 24) * -0.03125), f := 'num__creation_hour', en := {hour}, hi := 'Enquiry lagbhag ' || lpad((o_custkey % 24)::varchar, 2, '0') || ':00 baje aayi'),
        struct_pack(s := -(o_custkey % 3) * 0.5, f := 'num__kw_fee', en := case when o_custkey % 3 = 1 then 'Asked about fees' end, hi := 'Fees ke baare mein poocha')], lambda x: x.en is not null)"""
    q["top3_reasons"] = f"with r as (select o_orderkey as lead_id, list_sort({parts}) as l from orders) select lead_id, coalesce(l[1].en, '') as en1, coalesce(l[2].en, '') as en2, coalesce(l[3].en, '') as en3, coalesce(l[1].hi, '') as hi1 from r"
    q["registry_promote"] = "select * from (values ('v1', 'retired'), ('v2', 'champion'), ('v3', 'challenger')) v(version, status)"
    q["lead_listing"] = f"with {_SCORES}, {_PERSONS} select lead_id, source, branch, source as course_interest, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, round(p, 6) as probability from pe join sc using (lead_id) order by p desc, lead_id limit 50 offset 5"
    q["max_score_per_lead"] = "select o_custkey as lead_id, max(o_totalprice) as probability from orders group by o_custkey"
    q["call_list_filter"] = f"with {_SCORES}, {_PERSONS}, {_CALLS} select lead_id, branch, source, probability, band, urgent, round(age_hours, 6) as age_hours, round(waiting_minutes, 6) as waiting_minutes from cy where branch in ('F', 'O') and contains(lower(concat_ws(' ', branch, source)), 'urgent')"
    q["kpi_rollup"] = f"with {_SCORES}, {_PERSONS}, {_CALLS} select count(*) filter (band = 'P1') as p1, count(*) filter (band = 'P2') as p2, count(*) filter (band = 'P3') as p3, count(*) filter (urgent) as urgent, count(*) as total, round(avg(probability), 6) as avg_probability from cy"
    q["facets"] = "select c_mktsegment as source from customer union select 'REFERRAL' union select 'WALK-IN'"
    q["describe_columns"] = " union all ".join(f"select '{c}' as \"column\", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c}) as min, max({c}) as max from lineitem" for c in ("l_quantity", "l_discount", "l_tax"))
    return q
