"""Outcome labels, maturity and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C


def label_maturity(leads: DataFrame, stages: DataFrame, export: Column, days: int = 30, stage: str = "Admission Done", only_mature: bool = True, key: str = "lead_id") -> DataFrame:
    """(lead_id, created_at, t, target[, is_mature]): target 1 if the stage came within days of creation, ends included.

    A lead is mature if it was created days or more before the export.
    """
    won = stages.where(F.col("stage") == stage).select(F.col(key).alias("_key"), "changed_at")
    hit = leads.join(won, (leads[key] == won["_key"]) & (won["changed_at"] >= leads["created_at"]) & (won["changed_at"] <= leads["created_at"] + F.expr(f"INTERVAL {days} DAYS")), "left_semi").select("lead_id", F.lit(1).alias("_hit")).distinct()
    out = leads.join(hit, "lead_id", "left").select("lead_id", "created_at", C.scoring_moment(F.col("created_at")).alias("t"), F.coalesce("_hit", F.lit(0)).alias("target"), (F.col("created_at") <= export - F.expr(f"INTERVAL {days} DAYS")).alias("is_mature"))
    return out.where("is_mature").drop("is_mature") if only_mature else out


def target_vector(leads: DataFrame, stages: DataFrame, days: int = 30, stage: str = "Admission Done", key: str = "lead_id") -> DataFrame:
    """(lead_id, target) of all leads, mature or not."""
    return label_maturity(leads, stages, F.current_timestamp(), days, stage, False, key).select("lead_id", "target")


def time_split(df: DataFrame, hidden_start: str, weeks: int = 4, calibration: float = 0.20, created: str = "created_at") -> DataFrame:
    return df.withColumn("split", C.split_of(F.col(created), hidden_start, weeks, calibration))


def describe_split(df: DataFrame, created: str = "created_at") -> DataFrame:
    return df.where("split is not null").groupBy("split").agg(F.count("*").alias("rows"), F.min(created).alias("first"), F.max(created).alias("last"))


def semi(df: DataFrame, keys: DataFrame, key: str = "lead_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")
