"""Ranking and calibration metrics of (y, p) tables. Every metric is one row; ties in p count together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C


def by_score(df: DataFrame) -> DataFrame:
    """(p, n, pos): rows and positives of each distinct score; the rank metrics work on it."""
    return df.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


RANGES = 1000


def _cumulative(df: DataFrame) -> DataFrame:
    """The scores with the rows and positives at or above them.

    A running sum without a partition would go through one task. Scores are cut into ranges first, at approximate
    quantiles of the distinct scores so that each range has about as many of them however they are
    spread; the ranges' sums are few, and each range then runs by itself.
    """
    scores = by_score(df)
    cuts = scores.agg(F.coalesce(F.percentile_approx("p", [k / RANGES for k in range(1, RANGES)], 10 * RANGES), F.array().cast("array<double>")).alias("cuts"))
    cuts = cuts.select(F.array_sort(F.array_distinct("cuts")).alias("cuts"))
    scores = scores.join(F.broadcast(cuts)).withColumn("r", _place("cuts", "p")).drop("cuts")
    ranges = scores.groupBy("r").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp"))
    above = W.orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("r", F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"))
    w = W.partitionBy("r").orderBy(F.desc("p"))
    return scores.join(ranges, "r").withColumn("cn", F.col("bn") + F.sum("n").over(w)).withColumn("cp", F.col("bp") + F.sum("pos").over(w))


def _place(cuts: str, p: str):
    """How many of the sorted cuts are at or below p, by halving."""
    return F.expr(f"""aggregate(sequence(1, 11), named_struct('lo', 0, 'hi', size({cuts})), (s, _) -> if(s.lo >= s.hi, s,
        if(get({cuts}, cast((s.lo + s.hi) div 2 as int)) <= {p}, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)""")


def average_precision(df: DataFrame) -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision; null without positives."""
    total = df.agg(F.sum("y").alias("t"))
    return _cumulative(df).join(F.broadcast(total)).agg((F.sum(F.col("pos") * F.col("cp") / F.col("cn")) / F.nullif(F.first("t"), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class."""
    c = _cumulative(df).withColumn("neg", F.col("n") - F.col("pos")).withColumn("above", F.col("cp") - F.col("pos"))
    pairs = F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    return c.agg((F.sum(F.col("neg") * (F.col("above") + F.col("pos") / 2)) / pairs).alias("roc_auc"))


def top_fraction(df: DataFrame, fraction: float, order: str) -> DataFrame:
    """The first ceil(n * fraction) rows, one at least, by falling p and rising order.

    The score at which the fraction ends comes from the cumulative table; rows above it are kept by a filter, and only
    the rows of that one score are put in order.
    """
    n = F.broadcast(df.agg(F.greatest(F.ceil(F.count("*") * F.lit(fraction)), F.lit(1)).alias("_k")))
    cut = _cumulative(df).join(n).where("cn >= _k").agg(F.max("p").alias("_cut"), F.max(F.struct("p", (F.col("_k") - F.col("cn") + F.col("n")).alias("left"))).alias("_m"))
    cut = F.broadcast(cut.select("_cut", F.col("_m.left").alias("_left")))
    marked = df.join(cut).where("p >= _cut")
    tied = marked.where("p = _cut").withColumn("_r", F.row_number().over(W.partitionBy("p").orderBy(order))).where("_r <= _left").drop("_r")
    return marked.where("p > _cut").unionByName(tied).drop("_cut", "_left")


def lift_recall(df: DataFrame, fraction: float, order: str) -> DataFrame:
    """(lift, recall) of the top fraction; null without positives."""
    total = df.agg(F.avg("y").alias("rate"), F.sum("y").alias("pos"))
    top = top_fraction(df, fraction, order).agg(F.avg("y").alias("top_rate"), F.sum("y").alias("top_pos"))
    return top.join(F.broadcast(total)).select((F.col("top_rate") / F.nullif(F.col("rate"), F.lit(0.0))).alias("lift"), (F.col("top_pos") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def _bin(bins: int):
    """How many inner edges are at or below p."""
    return sum((F.when(F.col("p") >= F.lit(k / bins), 1).otherwise(0) for k in range(1, bins)), F.lit(0))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row per bin, empty ones with nulls."""
    got = df.groupBy(_bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "observed_rate")


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    got = reliability(df, bins)
    return got.agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed_rate"))) / F.sum("n")).alias("ece"))


def bundle(df: DataFrame, order: str, calibration: bool = True) -> DataFrame:
    """All metrics in one row."""
    out = average_precision(df).join(roc_auc(df))
    for f in (0.1, 0.2):
        out = out.join(lift_recall(df, f, order).toDF(f"lift_at_{round(f * 100)}", f"recall_at_{round(f * 100)}"))
    return out.join(brier(df)).join(calibration_error(df)) if calibration else out


def thresholds(df: DataFrame, q1: float = 0.9, q2: float = 0.5) -> DataFrame:
    """Interpolated quantiles of p that start the first two bands."""
    return df.agg(F.expr(f"percentile(p, {q1})").alias("p1"), F.expr(f"percentile(p, {q2})").alias("p2"))


def bands(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(thresholds(df))).withColumn("band", C.band(F.col("p"), F.col("p1"), F.col("p2")))


def confusion(df: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision and recall; a zero denominator gives 0."""
    t, g = F.col(truth).cast("boolean"), F.col(guess).cast("boolean")
    n = lambda c: F.count(F.when(c, 1))
    got = df.agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    return got.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))
