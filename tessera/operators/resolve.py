"""Entity resolution: blocking, comparison, rules, size-capped clusters, golden records, review samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import validate
from tessera.plans.components import connected_components
from tessera.plans.scratch import materialise

RULES = ("exact_key", "both_keys", "key_and_name", *(f"key_and_name_similarity_{k / 100:.2f}" for k in range(50, 95, 5)), "key_and_name_prefix", "both_keys_or_key_and_name", "both_keys_or_name_prefix", "both_keys_or_exact_or_prefix")
MAX_CLUSTER, WEAK_SIZE = 10, 4


def prepare(leads: DataFrame) -> DataFrame:
    """Leads with phone_norm, email_norm and name_norm; the id must be unique."""
    validate.columns(leads, ["lead_id", "phone", "email", "full_name"])
    return validate.unique(leads, "lead_id").withColumns({"phone_norm": C.normalize_phone(F.col("phone")), "email_norm": C.normalize_email(F.col("email")), "name_norm": C.normalize_name(F.col("full_name"))})


def candidate_pairs(df: DataFrame, keys: dict[str, str], id_col: str = "lead_id") -> DataFrame:
    """(a, b, reasons): unordered pairs a < b that share a key, with the sorted names of the keys shared; keys: name to column.

    One equality join per key, so a null key pairs nothing and skew in a key is split at run time.
    """
    out = None
    for name, c in keys.items():
        x, y = df.select(F.col(id_col).alias("a"), F.col(c).alias("k")), df.select(F.col(id_col).alias("b"), F.col(c).alias("k"))
        got = x.join(y, "k").where("a < b").select("a", "b", F.lit(name).alias("reason"))
        out = got if out is None else out.unionAll(got)
    return out.groupBy("a", "b").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def evidence(pairs: DataFrame, df: DataFrame, similarity: bool = True, id_col: str = "lead_id") -> DataFrame:
    """Pairs with matches, name comparison and a grade. df: id, phone_norm, email_norm, name_norm, branch, course_interest, source."""
    fields = ["phone_norm", "email_norm", "name_norm", "branch", "course_interest", "source"]
    side = lambda s: df.select(F.col(id_col).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in fields])
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    eq = lambda c: C.same(F.col(f"{c}_a"), F.col(f"{c}_b"))
    ratio = C.name_similarity(F.col("name_norm_a"), F.col("name_norm_b")) if similarity else F.when(eq("name_norm"), F.lit(1.0)).otherwise(F.lit(0.0))
    p = p.select("a", "b", "reasons", eq("phone_norm").alias("phone_match"), eq("email_norm").alias("email_match"), eq("name_norm").alias("name_exact"), C.token_prefix(F.col("name_norm_a"), F.col("name_norm_b")).alias("name_prefix_match"), ratio.alias("_s"), eq("branch").alias("branch_match"), eq("course_interest").alias("course_match"), eq("source").alias("source_match"))
    key, both = F.col("phone_match") | F.col("email_match"), F.col("phone_match") & F.col("email_match")
    grade = F.when(both & F.col("name_exact"), "very_strong").when(both | key & F.col("name_exact"), "strong").when(key & (F.col("_s") >= 0.90), "medium").otherwise("weak")
    return p.withColumn("grade", grade).withColumn("name_similarity", F.round("_s", 6)).drop("_s")


def rule(name: str) -> Column:
    """The decision of a named rule over evidence columns."""
    key, both = F.col("phone_match") | F.col("email_match"), F.col("phone_match") & F.col("email_match")
    exact, prefix = F.col("name_exact"), F.col("name_prefix_match")
    if name.startswith("key_and_name_similarity_"):
        return key & (F.col("name_similarity") >= float(name.rsplit("_", 1)[1]))
    found = {"exact_key": key, "both_keys": both, "key_and_name": key & exact, "key_and_name_prefix": key & prefix, "both_keys_or_key_and_name": both | key & exact, "both_keys_or_name_prefix": both | key & prefix, "both_keys_or_exact_or_prefix": both | key & (exact | prefix)}
    if name not in found:
        raise ValueError(f"unknown rule: {name}; one of {', '.join(RULES)}")
    return found[name]


def stratum() -> Column:
    p, e = F.col("phone_match"), F.col("email_match")
    return F.when(p & e, "both_keys").when(p, "phone_only").when(e, "email_only").otherwise("other")


def rule_sweep(labelled: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(rule, tp, fp, fn, tn, precision, recall) of evidence rows with a 0/1 label, all rules in one pass."""
    guesses = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rule(r).alias("g")) for r in rules]))
    x = labelled.select(F.col("label").cast("boolean").alias("t"), guesses.alias("r")).select("t", "r.rule", "r.g")
    n = lambda c: F.count(F.when(F.expr(c), 1))
    got = x.groupBy("rule").agg(n("t and g").alias("tp"), n("not t and g").alias("fp"), n("t and not g").alias("fn"), n("not t and not g").alias("tn"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    return got.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def star_links(df: DataFrame, keys: dict[str, str], id_col: str = "lead_id") -> DataFrame:
    """(a, b): for each key value shared by several rows, a link from its smallest id to each other one.

    The components are those of candidate_pairs, at one row for each id and key instead of a row for each pair, however
    common a value is. It serves the rule exact_key, which accepts every pair.
    """
    out = None
    for name, c in keys.items():
        x = df.where(F.col(c).isNotNull()).select(F.lit(name).alias("key"), F.col(c).cast("string").alias("k"), F.col(id_col).alias("b"))
        out = x if out is None else out.unionAll(x)
    low = out.groupBy("key", "k").agg(F.min("b").alias("a"), F.max("b").alias("top")).where("a < top").select("key", "k", "a")
    return out.join(low, ["key", "k"]).where("a < b").select("a", "b").distinct()


def hot_keys(df: DataFrame, keys: dict[str, str], most: int = 1000) -> DataFrame:
    """(key, value, n, pairs) of the key values with more than ``most`` rows, whose pairs a run may not want to write out."""
    out = None
    for name, c in keys.items():
        x = df.where(F.col(c).isNotNull()).groupBy(F.lit(name).alias("key"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
        out = x if out is None else out.unionAll(x)
    return out.where(F.col("n") > most).withColumn("pairs", F.expr("n * (n - 1) div 2"))


def _replayer(cap: int):
    """Unions under the cap, over rows (_c, a, b) that come component by component in the order of (a, b)."""

    def replay(frames):
        up: dict = {}
        size: dict = {}
        held: list[tuple] = []
        at = None

        def root(k):
            while up.setdefault(k, k) != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def done():
            got = pd.DataFrame(held, columns=["a", "b", "status"])
            return got.assign(ca=[root(x) for x in got["a"]], cb=[root(x) for x in got["b"]])

        for frame in frames:
            ready = []
            for c, a, b in zip(frame["_c"], frame["a"], frame["b"]):
                if c != at:
                    if held:
                        ready.append(done())
                    up, size, held, at = {}, {}, [], c
                ra, rb = root(a), root(b)
                if ra == rb:
                    status = "already_connected"
                elif size.get(ra, 1) + size.get(rb, 1) > cap:
                    status = "cluster_size_cap"
                else:
                    status = "accepted"
                    low, high = min(ra, rb), max(ra, rb)
                    up[high], size[low] = low, size.get(ra, 1) + size.get(rb, 1)
                held.append((a, b, status))
            if ready:
                yield pd.concat(ready)
        if held:
            yield done()

    return replay


def clusters(df: DataFrame, pairs: DataFrame, cap: int = MAX_CLUSTER, id_col: str = "lead_id") -> tuple[DataFrame, DataFrame]:
    """((lead_id, cluster), (a, b, status)) of accepted pairs under a size cap.

    Greedy in the order of (a, b): a pair whose union would pass the cap is refused. Unions in different components
    never meet, so components are found first; each is then replayed in that order as its sorted rows stream through a
    task, many components a task, with the state of one component at a time. A cluster is named by its smallest id;
    leads without pairs are clusters of their own. Ids that are no whole numbers are numbered, not hashed.
    """
    if cap < 2:
        raise ValueError("a cluster must be allowed two members")
    pairs = materialise(pairs.select("a", "b"), "pairs")
    kind = df.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        comp = connected_components(pairs, "a", "b").select(F.col("id").cast(kind).alias("a"), F.col("component").alias("_c"))
    else:
        ids = materialise(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct().select("id", F.monotonically_increasing_id().alias("_n")), "ids")
        number = lambda c: ids.select(F.col("id").alias(c), F.col("_n").alias(f"_{c}"))
        found = connected_components(pairs.join(number("a"), "a").join(number("b"), "b"), "_a", "_b").select(F.col("id").alias("_n"), F.col("component").alias("_c"))
        comp = ids.join(found, "_n").select(F.col("id").alias("a"), "_c")
    ordered = pairs.join(materialise(comp, "components"), "a").select("_c", "a", "b").repartition("_c").sortWithinPartitions("_c", "a", "b")
    done = materialise(ordered.mapInPandas(_replayer(cap), f"a {kind}, b {kind}, status string, ca {kind}, cb {kind}"), "clusters")
    of = done.select(F.col("a").alias(id_col), F.col("ca").alias("cluster")).unionAll(done.select("b", "cb")).distinct()
    every = df.select(id_col).join(of, id_col, "left").select(id_col, F.coalesce("cluster", id_col).alias("cluster"))
    return every, done.select("a", "b", "status")


def listing(members: DataFrame) -> DataFrame:
    """(cluster, size, members) of all clusters by smallest member, then size."""
    per = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("lead_id")).alias("members"))
    return per.orderBy(F.col("members")[0], "size")


def largest_clusters(members: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, size) of the k largest clusters, ties by name."""
    return members.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(k)


def golden(df: DataFrame, members: DataFrame, stages: DataFrame, accepted: DataFrame | None = None, weak_size: int = WEAK_SIZE) -> DataFrame:
    """One row per lead: cluster_id, canonical lead, size, best stage and its lead, sources, weak flag and reason.

    Canonical is the earliest member (no time last, then id); the best stage has the highest rank, then the latest change,
    and a stage of no known rank is an error.
    accepted: evidence rows of accepted pairs; a cluster with one that rests on a single key is weak, as is a large one.
    """
    x = df.join(members, "lead_id")
    order = F.struct(F.col("created_at").isNull(), F.col("created_at"), F.col("lead_id"))
    source = F.nullif(F.trim("source"), F.lit(""))
    per = x.groupBy("cluster").agg(F.min(order).alias("o"), F.count("*").alias("cluster_size"), F.collect_set(source).alias("s"))
    by_lower = F.transform(F.array_sort(F.transform("s", lambda v: F.struct(F.lower(v).alias("l"), v.alias("v")))), lambda t: t["v"])
    per = per.select("cluster", F.col("o.lead_id").alias("canonical_lead_id"), "cluster_size", F.concat(F.lit('["'), F.array_join(by_lower, '", "'), F.lit('"]')).alias("sources"))
    rank = F.struct(C.stage_rank(F.col("stage"), strict=True).alias("r"), F.col("changed_at"), F.col("lead_id"))
    best = stages.join(members, "lead_id").groupBy("cluster").agg(F.max_by("stage", rank).alias("best_stage"), F.max_by("lead_id", rank).alias("stage_source"))
    per = per.join(best, "cluster", "left")
    if accepted is not None:
        single = accepted.where("not (phone_match and email_match)").select(F.col("a").alias("lead_id")).join(members, "lead_id").select("cluster", F.lit(True).alias("_single")).distinct()
        per = per.join(single, "cluster", "left")
    else:
        per = per.withColumn("_single", F.lit(False))
    why = F.concat_ws("; ", F.when(F.col("cluster_size") >= weak_size, F.concat(F.lit("cluster size "), "cluster_size")), F.when(F.col("_single"), F.lit("single key pair")))
    per = per.withColumn("weak_reason", why).withColumn("weak_cluster", F.col("weak_reason") != "").drop("_single")
    out = x.select("lead_id", "cluster").join(per, "cluster")
    return out.select(F.concat(F.lit("C_"), F.col("canonical_lead_id").cast("string")).alias("cluster_id"), "lead_id", (F.col("lead_id") == F.col("canonical_lead_id")).alias("is_canonical"), "cluster_size", "canonical_lead_id", "best_stage", "stage_source", "sources", "weak_cluster", "weak_reason")


def summary(n_leads: DataFrame, pairs: DataFrame, members: DataFrame, weak_size: int = WEAK_SIZE, done: DataFrame | None = None) -> DataFrame:
    """Totals of a run: comparisons made and avoided, clusters, duplicates, large clusters; with the pairs' statuses also how many were accepted, were connected already and were refused."""
    n = n_leads.agg(F.count("*").alias("leads"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("k"))
    c = sizes.agg(F.count("*").alias("clusters"), F.count(F.when(F.col("k") > 1, 1)).alias("duplicate_clusters"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicate_leads"), F.count(F.when(F.col("k") >= weak_size, 1)).alias("large_clusters"), F.max("k").alias("largest"))
    x = n.join(pairs.agg(F.count("*").alias("candidate_pairs"))).join(c)
    if done is not None:
        x = x.join(done.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(n) for n, s in (("accepted", "accepted"), ("already_connected", "already_connected"), ("cap_rejected", "cluster_size_cap"))]))
    x = x.withColumn("naive_comparisons", F.expr("leads * (leads - 1) div 2"))
    return x.withColumn("avoided", F.col("naive_comparisons") - F.col("candidate_pairs")).withColumn("duplicate_rate", F.col("duplicate_leads") / F.col("leads"))


def review_sample(graded: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """About size pairs, an equal share of each of the three strata with hard pairs (names differ) first, short strata filled by the others; empty label columns."""
    x = graded.withColumn("stratum", stratum()).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "a", "b")))
    w = W.partitionBy("stratum").orderBy(F.col("name_exact"), "_h", "a", "b")
    names = ("both_keys", "phone_only", "email_only")
    x = x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size)  # a stratum never gives more
    quota = F.when(F.col("stratum").isin(*names[:2]), -(-size // 3)).when(F.col("stratum") == names[2], size - 2 * (-(-size // 3))).otherwise(0)
    first = (F.col("_r") > quota).cast("int")
    return x.orderBy(first, "_h", "a", "b").limit(size).select("a", "b", "stratum", "grade", F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("note"))


def fresh_audit(graded: DataFrame, old: DataFrame, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Quota pairs of each stratum that are not in old (unordered); too few are an error."""
    key = lambda a, b: [F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")]
    fresh = graded.select("*", *key("a", "b")).join(old.select(*key("a", "b")), ["_x", "_y"], "left_anti").drop("_x", "_y").withColumn("stratum", stratum())
    w = W.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "a", "b")), "a", "b")
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("stratum") == name, n).otherwise(quota)
    out = materialise(fresh.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r"), "audit")
    got = {r["stratum"]: r["count"] for r in out.groupBy("stratum").count().collect()}
    if short := {k: n - got.get(k, 0) for k, n in quotas.items() if got.get(k, 0) < n}:
        raise ValueError(f"too few fresh pairs: {short}")
    return out


def audit_pairs(df: DataFrame, keys: dict[str, str], order: str, id_col: str = "lead_id") -> DataFrame:
    """(a, b, reason): candidate pairs of an audit, the row that comes first by ``order`` as a; reason both_keys, phone_only or email_only.

    Blank keys pair nothing, as null ones.
    """
    filled = df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in keys.values()})
    pairs = candidate_pairs(filled, keys, id_col)
    at = lambda s: df.select(F.col(id_col).alias(s), F.col(order).alias(f"_{s}"))
    x = pairs.join(at("a"), "a").join(at("b"), "b")
    swapped = F.struct("_b", "b") < F.struct(F.col("_a").alias("_b"), F.col("a").alias("b"))
    reason = F.when(F.size("reasons") > 1, "both_keys").otherwise(F.concat(F.col("reasons")[0], F.lit("_only")))
    return x.select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b"), reason.alias("reason"))


def audit_evidence(pairs: DataFrame, df: DataFrame, id_col: str = "lead_id") -> DataFrame:
    """(a, b, phone_match, email_match, name_exact, name_prefix_match, name_similarity, accepted) as an audit compares: blanks are never equal, equal names are prefixes of each other, and accepted is the frozen rule."""
    fields = ["phone_norm", "email_norm", "name_norm"]
    side = lambda s: df.select(F.col(id_col).alias(s), *[F.coalesce(F.col(c), F.lit("")).alias(f"{c}_{s}") for c in fields])
    x = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    eq = lambda c: (F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != "")
    prefix = eq("name_norm") | C.token_prefix(F.col("name_norm_a"), F.col("name_norm_b"), same_length=True)
    x = x.select("a", "b", eq("phone_norm").alias("phone_match"), eq("email_norm").alias("email_match"), eq("name_norm").alias("name_exact"), prefix.alias("name_prefix_match"), F.round(C.name_similarity("name_norm_a", "name_norm_b"), 6).alias("name_similarity"))
    return x.withColumn("accepted", rule("both_keys_or_exact_or_prefix"))
