"""Queries of the call list, of similar leads and of single requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, by a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def max_score_per_lead(log: DataFrame) -> DataFrame:
    return log.groupBy("lead_id").agg(F.max("probability").alias("probability"))


def similar(vectors: DataFrame, outcomes: DataFrame, lead_id, k: int = 10, id_col: str = "lead_id", vec_col: str = "embedding", order: str = "asof") -> DataFrame:
    """(lead_id, similarity, outcome) of the k rows most similar to a lead's latest vector; itself and unlabelled leads left out.

    A lead without a vector is an error, unlike one without neighbours. The source is one row, so it is broadcast;
    each task keeps its own best k.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be from 1 to 50")
    row = vectors.where(F.col(id_col) == lead_id).orderBy(F.desc(order)).select(vec_col).first()
    if row is None:
        raise LookupError(f"no vector of {lead_id}")
    source = F.lit([float(x) for x in row[0]])
    others = vectors.where(F.col(id_col) != lead_id).join(outcomes, id_col)
    return others.select(id_col, F.round(C.cosine(F.col(vec_col), source), 6).alias("similarity"), "outcome").orderBy(F.desc("similarity"), id_col).limit(k)


def similar_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum("outcome"), F.lit(0)).alias("admissions"), F.count("*").alias("total"))


def lead_listing(leads: DataFrame, scores: DataFrame, offset: int = 0, most: int | None = None) -> DataFrame:
    """Leads with blanks made null, defaults and their score (0 without), best first."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    x = leads.join(scores, "lead_id", "left")
    x = x.select("lead_id", F.coalesce(clean("source"), F.lit("Unknown")).alias("source"), *[F.coalesce(clean(c), F.lit("—")).alias(c) for c in ("branch", "course_interest")], F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
    x = x.orderBy(F.desc("probability"), "lead_id").offset(offset)
    return x.limit(most) if most is not None else x


def lead_detail(leads: DataFrame, scores: DataFrame, lead_id) -> DataFrame:
    """The listing's row of one lead; an unknown one is an error."""
    out = lead_listing(leads.where(F.col("lead_id") == lead_id), scores)
    if not out.limit(1).count():
        raise LookupError(f"unknown lead: {lead_id}")
    return out


def call_list(df: DataFrame, now: Column) -> DataFrame:
    """Adds age_hours (0 to 8640), waiting_minutes and urgent (P1 that waits over 15 minutes)."""
    wait = C.minutes_between(F.col("created_at"), now)
    return df.withColumn("age_hours", F.least(F.greatest(wait / 60, F.lit(0.0)), F.lit(8640.0))).withColumn("waiting_minutes", F.greatest(wait, F.lit(0.0))).withColumn("urgent", (F.col("band") == "P1") & (wait > 15))


def filter_list(df: DataFrame, facets: dict[str, list[str]], search: str = "", fields: list[str] = ()) -> DataFrame:
    """Rows of every chosen facet value (none chosen: all) whose fields have the search text."""
    for c, values in facets.items():
        if values:
            df = df.where(F.col(c).isin(*values))
    if needle := search.strip().lower():
        df = df.where(F.lower(F.concat_ws(" ", *fields)).contains(needle))
    return df.orderBy(F.desc("probability"), F.desc("urgent"), "lead_id")


def kpis(df: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return df.agg(*[n(F.col("band") == b).alias(b.lower()) for b in ("P1", "P2", "P3")], n(F.col("urgent")).alias("urgent"), F.count("*").alias("total"), F.coalesce(F.avg("probability"), F.lit(0.0)).alias("avg_probability"))


def facet_options(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values found and known ones, sorted."""
    extra = df.sparkSession.createDataFrame([(v,) for v in known], f"{column} string")
    return df.select(column).where(F.col(column).isNotNull()).union(extra).distinct().orderBy(column)


def cluster_sizes(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    return ids.join(clusters.select("lead_id", "cluster_size"), "lead_id", "left").select("lead_id", F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


def requested(spark, ids: list[str], scored: DataFrame, most: int = 500) -> DataFrame:
    """Scores in the order of a request, repeated ids repeated; unknown ids and too long requests are errors."""
    if not 1 <= len(ids) <= most:
        raise ValueError(f"a request has 1 to {most} ids")
    asked = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, lead_id string")
    out = F.broadcast(asked).join(scored, "lead_id")
    if missing := asked.join(scored, "lead_id", "left_anti").select("lead_id").distinct().collect():
        raise LookupError(f"unknown leads: {sorted(r[0] for r in missing)}")
    return out.orderBy("pos")


def position_in_cluster(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)
