"""Point-in-time features: what was known of an enquiry 24 hours after it was created."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import validate

#: Columns that a feature matrix must never carry.
FORBIDDEN = {"current_stage", "updated_at", "last_contacted_at", "legacy_score", "legacy_score_version"}
PERSONAL = {"full_name", "phone", "email", "home_locality", "assigned_counselor_id"}
COUNT_DEFAULTS = {"inbound_msg_count_before_t": 0, "outbound_msg_count_before_t": 0, "mean_msg_len_before_t": 0.0, "has_inbound_text_before_t": 0, "calls_attempted_before_t": 0, "calls_answered_before_t": 0}
LATENCIES = ("mins_to_first_lead_reply_after_assistant", "mins_to_first_counselor_call")


def in_window(spine: DataFrame, events: DataFrame, ts: str, hours: int = 24, key: str = "lead_id") -> DataFrame:
    """Events of each lead from its creation on and before the scoring moment: an equality join with a range residue.

    Events carry the key; with another key than the lead's id an event can fall into several leads' windows.
    """
    s = spine.select(F.col("lead_id").alias("_lead"), F.col(key).alias("_key"), F.col("created_at").alias("_from"), (F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("_to"))
    got = events.join(s, (events[key] == s["_key"]) & (events[ts] >= s["_from"]) & (events[ts] < s["_to"]))
    return got.withColumn("lead_id", F.col("_lead")).drop("_lead", "_key")


def message_features(spine: DataFrame, messages: DataFrame, keywords: dict = C.KEYWORDS, order: str = "sent_at", key: str = "lead_id") -> DataFrame:
    """Counts, mean length, reply latency and keyword flags of the window's messages; leads without any are absent.

    One shuffle: the reply's reference, the first assistant message, is a window minimum over the same key.
    """
    m = in_window(spine, messages, "sent_at", key=key)
    of_lead = (F.col("direction") == "inbound") & (F.col("sender_type") == "lead")
    first = F.min(F.when((F.col("direction") == "outbound") & (F.col("sender_type") == "assistant"), F.col("sent_at"))).over(W.partitionBy("lead_id"))
    m = m.withColumn("_first", first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(of_lead, F.struct(F.col(order).alias("o"), F.col("message_id").alias("i"), F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"]), " ")
    out = m.groupBy("lead_id").agg(
        F.count(F.when(F.col("direction") == "inbound", 1)).alias("inbound_msg_count_before_t"),
        F.count(F.when(F.col("direction") == "outbound", 1)).alias("outbound_msg_count_before_t"),
        F.avg(F.when(of_lead, F.length(F.coalesce("text", F.lit(""))))).alias("mean_msg_len_before_t"),
        F.min(F.when(of_lead & (F.col("sent_at") > F.col("_first")), C.minutes_between(F.col("_first"), F.col("sent_at")))).alias("mins_to_first_lead_reply_after_assistant"),
        text.alias("_text"),
    )
    flags = [C.keyword_flag(F.col("_text"), w).alias(f"kw_{k}") for k, w in keywords.items()]
    return out.select("lead_id", "inbound_msg_count_before_t", "outbound_msg_count_before_t", F.coalesce("mean_msg_len_before_t", F.lit(0.0)).alias("mean_msg_len_before_t"), "mins_to_first_lead_reply_after_assistant", (F.trim("_text") != "").cast("int").alias("has_inbound_text_before_t"), *flags)


def call_features(spine: DataFrame, calls: DataFrame, key: str = "lead_id") -> DataFrame:
    """Attempts, answers and minutes to the first call in the window; negative and null durations don't count."""
    c = in_window(spine, calls.where("duration_sec >= 0"), "started_at", key=key)
    return c.groupBy("lead_id").agg(F.count("*").alias("calls_attempted_before_t"), F.count(F.when(F.col("outcome") == "answered", 1)).alias("calls_answered_before_t"), F.min(C.minutes_between(F.col("_from"), F.col("started_at"))).alias("mins_to_first_counselor_call"))


def locality_features(leads: DataFrame, localities: DataFrame, distances: list[str]) -> DataFrame:
    """Least distance to a branch; an unmatched locality is flagged and gets the dimension's median."""
    dim = localities.select("locality", F.least(*distances).alias("d")) if len(distances) > 1 else localities.select("locality", F.col(distances[0]).alias("d"))
    median = dim.agg(F.expr("percentile(d, 0.5)").alias("_median"))
    joined = leads.select("lead_id", "home_locality").join(F.broadcast(dim) if _small(dim) else dim, F.col("home_locality") == F.col("locality"), "left").join(F.broadcast(median))
    return joined.select("lead_id", F.coalesce("d", "_median").alias("min_dist_to_branch"), F.col("d").isNull().cast("int").alias("locality_match_missing"))


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def calendar_features(leads: DataFrame) -> DataFrame:
    """Hour and weekday (Monday 0) of creation in UTC, the session's zone."""
    return leads.select("lead_id", F.hour("created_at").alias("creation_hour"), F.weekday("created_at").alias("creation_weekday"))


def presence_flags(leads: DataFrame, present: list[str], missing: list[str]) -> DataFrame:
    has = [(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int").alias(f"has_{c}") for c in present]
    return leads.select("lead_id", *has, *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in missing])


def earlier_enquiries(leads: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many members of a lead's cluster come before it by (created_at, lead_id); leads without a cluster are an error."""
    validate.complete(leads, validate.unique(clusters, "lead_id"), "lead_id")
    w = W.partitionBy("cluster_id").orderBy("created_at", "lead_id")
    return leads.select("lead_id", "created_at").join(clusters.select("lead_id", "cluster_id"), "lead_id").select("lead_id", (F.row_number().over(w) - 1).alias("earlier_enquiries_count"))


def feature_matrix(leads: DataFrame, messages: DataFrame, calls: DataFrame, localities: DataFrame | None = None, distances: list[str] | None = None, keywords: dict = C.KEYWORDS, clusters: DataFrame | None = None, fill_latencies: bool = True, present: list[str] = (), missing: list[str] = (), key: str = "lead_id") -> DataFrame:
    """One row per lead with all blocks; counts without events are 0, latencies -1 (if filled), and nothing forbidden or personal."""
    out = leads.join(calendar_features(leads), "lead_id")
    if present or missing:
        out = out.join(presence_flags(leads, list(present), list(missing)), "lead_id")
    out = out.join(message_features(leads, messages, keywords, key=key), "lead_id", "left").join(call_features(leads, calls, key), "lead_id", "left")
    if localities is not None:
        out = out.join(locality_features(leads, localities, distances), "lead_id", "left")
    if clusters is not None:
        out = out.join(earlier_enquiries(leads, clusters), "lead_id", "left")
    out = out.fillna(COUNT_DEFAULTS | {f"kw_{k}": 0 for k in keywords})
    if fill_latencies:
        out = out.fillna({c: -1.0 for c in LATENCIES})
    out = out.drop(*FORBIDDEN, *PERSONAL, "created_at")
    return validate.none_of(out, FORBIDDEN | PERSONAL)


def lead_text(spine: DataFrame, messages: DataFrame, most: int = 512, mode: str = "head", key: str = "lead_id") -> DataFrame:
    """(lead_id, text, has_text): the lead's own masked messages of the window by time, blanks left out, one a line, cut to tokens."""
    m = in_window(spine, messages.where("direction = 'inbound' and sender_type = 'lead'"), "sent_at", key=key).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.struct("sent_at", "message_id", C.mask_contacts(F.trim("text")).alias("t"))
    joined = m.groupBy("lead_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
    out = spine.select("lead_id").join(joined, "lead_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return out.select("lead_id", C.truncate_tokens(F.col("text"), most, mode).alias("text"), (F.col("text") != "").cast("int").alias("has_text"))
