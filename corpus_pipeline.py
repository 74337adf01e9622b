"""The corpus pipeline: quality rules, near duplicates, personal data, source mixing, packing.

Each stage reads all that its predecessor kept, written as Parquet in between; all but the last return the
columns of ``documents``. Repeated passes of the mixing stage repeat rows, which the packing stage then keeps apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dup, packing, private, quality
from tessera.plans.scratch import remove, scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the policy keeps; null and empty texts fail it. Repeated rows are judged alike; an empty table stays empty."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without an id or without words all stay."""
    return near_dup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; null and empty texts stay as they are."""
    return private.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows chosen to the target weights, once for each pass over their leaf that holds them; ties in the order of a leaf go by hash, then by id. An empty table stays empty."""
    return mixing.choose(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where each document lies in the packed sequences. Rows that the mixing stage repeats never share a bin."""
    return packing.best_fit(packing.sized(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again. A stage's result
    is deleted when the next one's is written; the last stage reads its own when the returned rows are asked for."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs


#: Near duplicates by MinHash, the field of the personal data stage and best-fit packing are not SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None
