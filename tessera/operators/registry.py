"""Model registry and append-only score log as tables with invariants kept by these functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import upsert

REGISTRY = "version string, created_at timestamp, train_window struct<lower:timestamp,upper:timestamp>, data_sha256 string, metrics map<string,double>, status string, feature_list array<string>"
SCORES = "lead_id string, asof timestamp, model_version string, probability float, band string, reasons array<struct<en:string,hi:string>>, scored_at timestamp"
STATUSES = ("champion", "challenger", "retired")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def check(registry: DataFrame) -> DataFrame:
    """Unique versions, known statuses, one champion at most."""
    r = registry.agg(F.count("*").alias("n"), F.countDistinct("version").alias("v"), F.count(F.when(F.col("status") == "champion", 1)).alias("c"), F.count(F.when(~F.col("status").isin(*STATUSES), 1)).alias("x")).first()
    if r["n"] != r["v"] or r["c"] > 1 or r["x"]:
        raise ValueError(f"registry: {r['n'] - r['v']} repeated versions, {r['c']} champions, {r['x']} unknown statuses")
    return registry


def register(registry: DataFrame, row: DataFrame) -> DataFrame:
    """The registry with a version put in or replaced."""
    return check(upsert(registry, row, ["version"]))


def champion_row(registry: DataFrame) -> DataFrame:
    """(version, feature_list) of the champion, one row or none."""
    return registry.where("status = 'champion'").select("version", "feature_list").limit(1)


def champion(registry: DataFrame) -> str | None:
    row = champion_row(registry).first()
    return row[0] if row else None


def card(registry: DataFrame, version: str) -> DataFrame:
    window = F.concat(F.lit("["), F.date_format("train_window.lower", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(","), F.date_format("train_window.upper", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("]"))
    return registry.where(F.col("version") == version).withColumn("train_window", window).withColumn("metrics", F.to_json("metrics"))


def versions(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("created_at"), "version")


def promote(registry: DataFrame, challenger: str) -> DataFrame:
    """The registry after trying to promote: without a champion the challenger becomes it; else only with a strictly
    better average precision and a calibration error not above the champion's, and the champion retires. All in one projection."""
    m = lambda name, default: F.coalesce(F.col("metrics")[name], F.lit(default))
    of = lambda who, c: F.max(F.when(who, c))
    old, new = F.col("status") == "champion", F.col("version") == challenger
    s = registry.agg(of(old, F.col("version")).alias("old"), of(old, m("pr_auc", 0.0)).alias("o_ap"), of(old, m("ece", float("inf"))).alias("o_ece"), of(new, m("pr_auc", 0.0)).alias("n_ap"), of(new, m("ece", float("inf"))).alias("n_ece"))
    wins = F.col("n_ap").isNotNull() & (F.col("old").isNull() | (F.col("n_ap") > F.col("o_ap")) & (F.col("n_ece") <= F.col("o_ece")))
    status = F.when(wins & new, "champion").when(wins & old, "retired").otherwise(F.col("status"))
    return registry.join(F.broadcast(s)).withColumn("status", status).select(*registry.columns)


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds rows to the log; there is no update or delete."""
    kept = [c.split()[0] for c in SCORES.split(", ") if c.split()[0] != "scored_at"]
    scores.select(*kept, F.current_timestamp().alias("scored_at")).write.mode("append").parquet(path)


def history(log: DataFrame, lead_id: str | None = None, version: str | None = None, most: int = 100) -> DataFrame:
    x = log.where(F.col("lead_id") == lead_id) if lead_id is not None else log
    x = x.where(F.col("model_version") == version) if version is not None else x
    return x.orderBy(F.desc("scored_at"), "lead_id").limit(most)


def append_and_size(scores: DataFrame, path: str, clusters: DataFrame) -> DataFrame:
    """Adds rows to the log and returns (lead_id, cluster_size) of their leads, 1 for one without a cluster."""
    from tessera.operators.serving import cluster_sizes

    append_scores(scores, path)
    return cluster_sizes(scores.select("lead_id").distinct(), clusters)


def health(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether the registry at a path can be read, and whether it has a champion."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return {"database": True, "model": champion(spark.read.parquet(path)) is not None}
    except (PySparkException, Py4JJavaError):
        return {"database": False, "model": False}
