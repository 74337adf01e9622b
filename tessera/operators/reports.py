"""Exploratory roll-ups and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C


def group_rates(labelled: DataFrame, by: str | None = None) -> DataFrame:
    """Enquiries, admissions and rate, by a column or overall."""
    x = labelled.groupBy(by) if by else labelled.groupBy()
    return x.agg(F.count("*").alias("enquiries"), F.coalesce(F.sum("target"), F.lit(0)).alias("admissions"), F.avg("target").alias("rate"))


def first_call_by_month(leads: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean and median hours from creation to the first call, by month of creation."""
    first = calls.join(leads.select("lead_id", "created_at"), "lead_id").where("started_at >= created_at").groupBy("lead_id", "created_at").agg(F.min("started_at").alias("s"))
    h = (C.minutes_between(F.col("created_at"), F.col("s")) / 60).alias("h")
    return first.select(F.date_format("created_at", "yyyy-MM").alias("month"), h).groupBy("month").agg(F.count("*").alias("n"), F.avg("h").alias("mean_hours"), F.expr("percentile(h, 0.5)").alias("median_hours"))


def silent(leads: DataFrame, messages: DataFrame) -> DataFrame:
    """Enquiries without any message and their percentage."""
    none = leads.join(messages.select("lead_id"), "lead_id", "left_anti").agg(F.count("*").alias("silent"))
    return none.join(leads.agg(F.count("*").alias("total"))).withColumn("per_cent", F.col("silent") * 100 / F.nullif(F.col("total"), F.lit(0)))


def count_by(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def duplicate_identifiers(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """For each key the values that occur more than once and the rows they cover."""
    out = None
    for name, key in keys.items():
        x = df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1")
        x = x.agg(F.lit(name).alias("identifier"), F.count("*").alias("repeated_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_covered"))
        out = x if out is None else out.unionAll(x)
    return out


def trap_audit(leads: DataFrame, calls: DataFrame, forbidden: set[str], days: int = 30) -> DataFrame:
    """Repeated ids (rows beyond the first), negative durations, immature leads, forbidden columns present."""
    a = leads.agg((F.count("*") - F.countDistinct("lead_id")).alias("repeated_ids"), F.max("created_at").alias("_m"))
    immature = leads.join(F.broadcast(a)).where(F.col("created_at") > F.col("_m") - F.expr(f"INTERVAL {days} DAYS")).agg(F.count("*").alias("immature"))
    neg = calls.agg(F.count(F.when(F.col("duration_sec") < 0, 1)).alias("negative_durations"))
    return a.drop("_m").join(neg).join(immature).withColumn("forbidden_columns", F.lit(len(set(leads.columns) & set(forbidden))).cast("long"))


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest of columns, one row each."""
    stats = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in names])
    return df.select(F.explode(stats).alias("r")).groupBy("r.column").agg(F.avg("r.x").alias("mean"), F.stddev_samp("r.x").alias("std"), F.min("r.x").alias("min"), F.max("r.x").alias("max"))
