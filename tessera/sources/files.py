"""Typed scans of the datasets, sinks and stores. Timestamps are instants; the session's zone is UTC."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import columns as C
from tessera.operators import validate

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _raw(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


#: The columns of the datasets as they stand in files; those named in NOT_NULL must have a value.
RAW = {
    "leads": _raw(lead_id=_S, created_at=_S, source=_S, branch=_S, course_interest=_S, full_name=_S, phone=_S, email=_S, education_status=_S, age=_L, home_locality=_S, assigned_counselor_id=_S, current_stage=_S, updated_at=_S, last_contacted_at=_S, legacy_score=_L, legacy_score_version=_S),
    "messages": _raw(message_id=_S, lead_id=_S, sent_at=_S, direction=_S, sender_type=_S, text=_S),
    "calls": _raw(call_id=_S, lead_id=_S, counselor_id=_S, started_at_ms=_L, duration_sec=_L, outcome=_S, notes=_S),
    "stage_history": _raw(lead_id=_S, stage=_S, changed_at=_S, changed_by=_S),
    "counselors": _raw(counselor_id=_S, name=_S, branch=_S, languages=_S, joined_on=T.DateType()),
    "localities": _raw(locality=_S, km_to_riverside=_D, km_to_central=_D, km_to_lakeview=_D),
    "lead_clusters": _raw(cluster_id=_S, lead_id=_S, is_canonical=T.BooleanType(), cluster_size=_L, canonical_lead_id=_S, best_stage=_S, stage_source=_S, sources=_S, weak_cluster=T.BooleanType(), weak_reason=_S),
}
NOT_NULL = {
    "leads": ["lead_id", "created_at", "source", "branch", "course_interest", "current_stage", "updated_at"],
    "messages": ["message_id", "lead_id", "sent_at", "direction", "sender_type"],
    "calls": ["call_id", "lead_id", "counselor_id", "started_at_ms", "duration_sec", "outcome"],
    "stage_history": ["lead_id", "stage", "changed_at", "changed_by"],
    "counselors": ["counselor_id", "name", "branch", "languages", "joined_on"],
    "localities": ["locality", "km_to_riverside", "km_to_central", "km_to_lakeview"],
    "lead_clusters": ["lead_id"],
}
#: The texts that enumerated columns may have.
ENUMS = {
    "stage_history": {"stage": ["New", "Lost", "Dormant", "Contacted", "Interested", "Visit Scheduled", "Center Visited", "Demo Scheduled", "Seat Reserved", "Admission Done"]},
    "messages": {"direction": ["inbound", "outbound"], "sender_type": ["lead", "assistant", "counselor"]},
    "calls": {"outcome": ["answered", "no_answer", "busy", "switched_off"]},
}
KEYS = {"leads": "lead_id", "messages": "message_id", "calls": "call_id"}
NOT_NEGATIVE = {"calls": ["duration_sec"], "localities": ["km_to_riverside", "km_to_central", "km_to_lakeview"]}
TIMES = {"leads": (C.parse_naive, ["created_at", "updated_at", "last_contacted_at"]), "messages": (C.parse_instant, ["sent_at"]), "stage_history": (C.parse_instant, ["changed_at"])}


def read(spark: SparkSession, name: str, path: str, negative_durations: bool = False, multi_line: bool = False) -> DataFrame:
    """Scans one CSV dataset with its declared columns, parses its times and checks its contract.

    Malformed rows, bad times, nulls, unknown values and repeated ids are errors. Files are split unless ``multi_line``
    says that fields may hold line ends, which makes each file one task. Only needed columns are read downstream, as
    the checks are actions of their own: one over all columns that have a rule, one over a unique key.
    """
    header = spark.read.option("header", True).csv(path).columns
    if header != RAW[name].fieldNames():
        raise ValueError(f"{name}: columns {header} instead of {RAW[name].fieldNames()}")
    df = spark.read.schema(RAW[name]).option("header", True).option("mode", "FAILFAST").option("multiLine", multi_line).option("escape", '"').csv(path)
    return check(df, name, negative_durations)


def check(df: DataFrame, name: str, negative_durations: bool = False) -> DataFrame:
    """The checks and derived columns of a dataset, whatever it was read from (a file, a JDBC table, a catalog table)."""
    validate.columns(df, RAW[name].fieldNames(), strict=True)
    enums, positive = ENUMS.get(name, {}), [] if negative_durations else NOT_NEGATIVE.get(name, [])
    bad = {(r["check"], r["column"]) for r in validate.ledger(df, NOT_NULL[name], enums, positive).where("bad > 0").collect()}
    if bad:  # a second look gives the examples
        validate.not_null(df, [c for k, c in sorted(bad) if k == "not_null"])
        for c, values in enums.items():
            validate.allowed(df, c, values)
        validate.at_least_zero(df, positive)
    if name in KEYS:
        validate.unique(df, KEYS[name])
    parse, names = TIMES.get(name, (None, []))
    df = df.withColumns({c: parse(F.col(c)) for c in names if df.schema[c].dataType == _S})
    return df.withColumn("started_at", C.parse_epoch_ms(F.col("started_at_ms"))) if name == "calls" else df


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(lead_id, probability) of a file of finished scores; no other column is parsed."""
    return spark.read.option("header", True).csv(path).select("lead_id", F.col("probability").cast("double").alias("probability"))


def read_table(spark: SparkSession, name: str, url: str | None = None, table: str | None = None, **options) -> DataFrame:
    """The same dataset from a database (url) or the catalog; filters and columns are pushed to it."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table or name, **options).load() if url else spark.table(table or name)
    return check(df.select(*RAW[name].fieldNames()), name)


def read_or_table(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """The file, or the database where there is no file."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path).limit(1).count()
    except (AnalysisException, Py4JJavaError):
        return read_table(spark, name, **options)
    return read(spark, name, path)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).option("escape", '"').csv(path) if form == "csv" else writer.format(form).save(path)


def write_json(data: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, sort_keys=True, ensure_ascii=False, default=str)


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def content_hash(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 of the files' bytes one after the other. It is meant for the small input files of a training run: a hash of a sequence has no parallel form, so the bytes pass the driver one file at a time. See table_hash."""
    h = hashlib.sha256()
    for p in paths:
        for r in spark.read.format("binaryFile").load(p).orderBy("path").select("content").toLocalIterator():
            h.update(r["content"])
    return h.hexdigest()


def table_hash(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table of any size, whatever the order of its rows: the sum of the first 60 bits of each row's MD5, in columns by name."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a newer one of their key, and the new rows."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_vectors(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Upsert on (lead_id, asof, model_version) of the rows that have text; another length is an error."""
    verify_vectors(old, dim)
    got = new.where("has_text = 1").drop("has_text")
    return upsert(old, verify_vectors(got, dim), ["lead_id", "asof", "model_version"])


def verify_vectors(df: DataFrame, dim: int) -> DataFrame:
    validate.columns(df, ["lead_id", "asof", "model_version", "embedding"])
    if df.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).limit(1).count():
        raise ValueError(f"an embedding is not of length {dim}")
    return df


def outcomes(old: DataFrame, labelled: DataFrame) -> DataFrame:
    """(lead_id, outcome) with the mature labels put in."""
    return upsert(old, labelled.select("lead_id", F.col("target").alias("outcome")), ["lead_id"])
