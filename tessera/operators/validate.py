"""Contract checks. Each raises ValueError with up to ten examples, or returns its input unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns(df: DataFrame, required: list[str], strict: bool = False) -> DataFrame:
    missing, extra = sorted(set(required) - set(df.columns)), sorted(set(df.columns) - set(required))
    if missing or strict and extra:
        raise ValueError(f"missing columns: {missing}" + (f", unexpected: {extra}" if strict else ""))
    return df


def ledger(df: DataFrame, nulls: list[str] = (), enums: dict[str, list[str]] | None = None, not_negative: list[str] = (), binary: list[str] = (), integers: list[str] = (), unique_keys: list[str] = ()) -> DataFrame:
    """(check, column, bad): how many rows break each rule, all in one pass but for a pass per unique key."""
    rules = [("not_null", c, F.col(c).isNull()) for c in nulls]
    rules += [("allowed", c, F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in (enums or {}).items()]
    rules += [("at_least_zero", c, F.col(c) < 0) for c in not_negative]
    rules += [("binary", c, F.col(c).isNull() | ~F.col(c).isin(0, 1)) for c in binary]
    rules += [("integer", c, F.col(c).isNotNull() & F.col(c).cast("string").try_cast("bigint").isNull()) for c in integers]
    one = df.agg(*[F.count(F.when(x, 1)).alias(f"r{k}") for k, (_, _, x) in enumerate(rules)])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(c).alias("column"), F.col(f"r{k}").alias("bad")) for k, (n, c, _) in enumerate(rules)])).alias("r")).select("r.*")
    for c in unique_keys:
        extra = df.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad"))
        out = out.unionByName(extra.select(F.lit("unique").alias("check"), F.lit(c).alias("column"), "bad"))
    return out


def relaxed(df: DataFrame, required: list[str]) -> DataFrame:
    """The required columns as text, others as they are; a missing one is an error."""
    return columns(df, required).withColumns({c: F.col(c).cast("string") for c in required})


def schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Names, types and not-null constraints of a declared schema, in one pass over the data."""
    columns(df, expected.fieldNames(), strict=True)
    wrong = {f.name: df.schema[f.name].dataType.simpleString() for f in expected if df.schema[f.name].dataType != f.dataType}
    if wrong:
        raise ValueError(f"wrong types: {wrong}")
    return not_null(df, [f.name for f in expected if not f.nullable])


def not_null(df: DataFrame, names: list[str]) -> DataFrame:
    if names:
        found = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names]).first().asDict()
        if bad := {c: n for c, n in found.items() if n}:
            raise ValueError(f"nulls: {bad}")
    return df


def allowed(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    _none(df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).select(column).distinct(), f"{column} has unknown values")
    return df


def at_least_zero(df: DataFrame, names: list[str]) -> DataFrame:
    for c in names:
        _none(df.where(F.col(c) < 0).select(c), f"{c} is negative")
    return df


def unique(df: DataFrame, key: str | list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    _none(df.groupBy(*keys).count().where("count > 1").orderBy(*keys), f"{', '.join(keys)} is not unique")
    return df


def complete(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Every key of df is in other."""
    _none(df.select(key).join(other.select(key), key, "left_anti").orderBy(key), f"{key} is missing from the block")
    return df


def none_of(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """No forbidden or personal column is in an output."""
    if found := sorted(set(df.columns) & set(forbidden)):
        raise ValueError(f"forbidden columns: {found}")
    return df


def both_classes(df: DataFrame, split: str, label: str) -> DataFrame:
    _none(df.groupBy(split).agg(F.countDistinct(label).alias("classes"), F.count("*").alias("rows")).where("classes < 2"), "a split lacks a class")
    return df


def binary_labels(df: DataFrame, label: str) -> DataFrame:
    _none(df.where(F.col(label).isNull() | ~F.col(label).isin(0, 1)), f"{label} must be 0 or 1")
    return df


def disjoint(df: DataFrame, key: str, split: str) -> DataFrame:
    _none(df.where(F.col(split).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1"), "splits overlap")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return unique(left, key).join(unique(right, key), key, "left")


def to_integer(df: DataFrame, column: str, nullable: bool = True) -> DataFrame:
    """Strict cast: text that is no integer fails the query (ANSI)."""
    out = df.withColumn(column, F.col(column).cast("bigint"))
    return out if nullable else not_null(out, [column])


def frozen_rule(spec: dict, expected: str) -> dict:
    if spec.get("rule") != expected or spec.get("tuned_on_audit"):
        raise ValueError("the rule file does not hold the frozen rule")
    return spec


def _none(df: DataFrame, said: str) -> None:
    if found := df.limit(10).collect():
        raise ValueError(f"{said}: {[tuple(r) for r in found]}")
