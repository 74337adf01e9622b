"""Preprocessing, models, calibration, scoring and explanations on Spark ML."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import metrics

SEED, TRIALS, TREES = 42, 20, 2000


def numeric_parameters(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, population deviation) after median imputation; a constant column has deviation 1."""
    med = train.agg(*[F.expr(f"percentile({c}, 0.5)").alias(c) for c in names]).first()
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0))) for c in names]
    row = train.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(filled)]).first()
    return {c: (float(med[c] or 0.0), float(row[f"m{k}"] or 0.0), float(row[f"s{k}"] or 0.0) or 1.0) for k, c in enumerate(names)}


def standardise(df: DataFrame, parameters: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(med)) - mean) / dev for c, (med, mean, dev) in parameters.items()})


def most_frequent(train: DataFrame, column: str) -> str | None:
    """The commonest value, the smallest of ties."""
    row = train.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[0] if row else None


def one_hot(df: DataFrame, train: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns column_value of the training values in alphabetical order; unknown values are 0 everywhere, nulls the commonest."""
    fill = most_frequent(train, column)
    values = [r[0] for r in train.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
    x = F.coalesce(F.col(column), F.lit(fill))
    names = [f"{column}_{v}" for v in values]
    return df.select("*", *[(x == v).cast("int").alias(n) for n, v in zip(names, values)]), names


def preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]):
    """A fitted pipeline from prepared columns to ``features``: numerics as they are, categories one-hot, unseen ones all zero."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", stringOrderType="alphabetAsc", handleInvalid="keep") for c in categorical]
    stages += [OneHotEncoder(inputCol=f"{c}_ix", outputCol=f"{c}_hot", dropLast=True) for c in categorical]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_hot" for c in categorical]], outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def fit_logistic(train: DataFrame, label: str = "y", c: float = 1.0, rounds: int = 3000):
    """L2 logistic regression with penalty 1 / (c n), the intercept free."""
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1 / (c * max(1, train.count())), standardization=False, maxIter=rounds, tol=1e-9).fit(train)


SEARCH = {"maxDepth": [3, 4, 5, 6], "stepSize": [0.02, 0.05, 0.1, 0.2], "subsamplingRate": [0.7, 0.85, 1.0], "minInstancesPerNode": [5, 20, 50], "minInfoGain": [0.0, 1e-4], "featureSubsetStrategy": ["all", "sqrt", "0.7"], "maxBins": [32, 64, 128], "validationTol": [0.001, 0.01]}


def fit_trees(train: DataFrame, valid: DataFrame, label: str = "y", order: str = "lead_id", trials: int = TRIALS, seed: int = SEED, trees: int = TREES):
    """(best model, trial rows) of a random search over boosted trees, by (average precision, lift at 20 %, ROC AUC).

    Each draw grows up to ``trees`` trees and stops early when the loss of the validation rows no longer falls. The engine
    grows trees level by level and stops on the loss, so results differ from leaf-wise growth stopped on precision.
    """
    rng, best, rows = random.Random(seed), None, []
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    for k in range(min(trials, TRIALS)):
        draw = {n: rng.choice(v) for n, v in SEARCH.items()}
        fitted = GBTClassifier(featuresCol="features", labelCol=label, validationIndicatorCol="_valid", maxIter=trees, seed=seed + k, **draw).fit(both)
        key = ranking_key(probabilities(fitted, valid, label, order), order)
        rows.append(draw | {"trial": k, "trees": fitted.getNumTrees, "average_precision": key[0], "lift_at_20": key[1], "roc_auc": key[2]})
        if best is None or key > best[0]:
            best = (key, fitted)
    return best[1], rows


def feature_names(prepared: DataFrame) -> list[str]:
    """Names of the assembled vector's places, one-hot places as column_value."""
    found = prepared.schema["features"].metadata["ml_attr"]["attrs"]
    return [a["name"].replace("_hot_", "_") for a in sorted((a for kind in found.values() for a in kind), key=lambda a: a["idx"])]


def probabilities(model, df: DataFrame, label: str = "y", order: str = "lead_id") -> DataFrame:
    return model.transform(df).select(order, F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))


def ranking_key(scored: DataFrame, order: str) -> tuple[float, float, float]:
    r = metrics.average_precision(scored).join(metrics.lift_recall(scored, 0.2, order)).join(metrics.roc_auc(scored)).first()
    return tuple(float(r[c] or 0.0) for c in ("average_precision", "lift", "roc_auc"))


def champion(logistic: tuple, trees: tuple) -> str:
    """The better key; a tie goes to the simpler model."""
    return "trees" if trees > logistic else "logistic"


class Platt:
    """Logistic calibration on the logit."""

    def __init__(self, slope: float, intercept: float):
        self.slope, self.intercept = slope, intercept

    def __call__(self, p: Column) -> Column:
        return C.clip01(C.sigmoid(self.slope * C.logit(p) + self.intercept))


class Isotonic:
    """Monotone calibration: linear between knots, flat outside."""

    def __init__(self, knots: list[tuple[float, float]]):
        self.knots = knots

    def __call__(self, p: Column) -> Column:
        """By halving an array of knots: the expression grows with the logarithm of their number alone."""
        n, value = len(self.knots), p.cast("double")
        xs, ys = (F.array(*[F.lit(float(k[i])) for k in self.knots]) for i in (0, 1))
        start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"), value.alias("x"), xs.alias("xs"), ys.alias("ys"))
        half = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
        keep = lambda s, lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), s["x"].alias("x"), s["xs"].alias("xs"), s["ys"].alias("ys"))
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get(s["xs"], half(s)) <= s["x"], keep(s, half(s) + 1, s["hi"])).otherwise(keep(s, s["lo"], half(s))))

        def between(s):
            k = s["lo"]  # knots at or below x
            x0, x1, y0, y1 = F.get(s["xs"], k - 1), F.get(s["xs"], k), F.get(s["ys"], k - 1), F.get(s["ys"], k)
            return F.when(k == 0, F.get(s["ys"], F.lit(0))).when(k == n, F.get(s["ys"], F.lit(n - 1))).otherwise(y0 + (y1 - y0) * (s["x"] - x0) / (x1 - x0))

        rounds = F.sequence(F.lit(1), F.lit(n.bit_length()))
        return F.when(value.isNotNull(), C.clip01(F.aggregate(rounds, start, step, between)))


def calibrator(name: str, scored: DataFrame) -> Platt | Isotonic:
    """Fits platt or isotonic on rows (y, p); another name is an error."""
    if name == "platt":
        m = fit_logistic(scored.select(array_to_vector(F.array(C.logit(F.col("p")))).alias("features"), F.col("y").cast("double")))
        return Platt(float(m.coefficients[0]), float(m.intercept))
    if name == "isotonic":
        m = IsotonicRegression(featuresCol="f", labelCol="l").fit(scored.select(array_to_vector(F.array("p")).alias("f"), F.col("y").cast("double").alias("l")))
        return Isotonic(list(zip([float(x) for x in m.boundaries], [float(x) for x in m.predictions])))
    raise ValueError(f"unknown calibration method: {name}")


def fit_pca(train: DataFrame, vector: str = "embedding", k: int = 16):
    """A centred PCA fitted on rows that have a vector; fewer than k rows are an error."""
    x = train.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_vec"))
    if x.limit(k).count() < k:
        raise ValueError(f"at least {k} rows are needed")
    return Pipeline(stages=[StandardScaler(inputCol="_vec", outputCol="_centred", withMean=True, withStd=False), PCA(k=k, inputCol="_centred", outputCol="_axes")]).fit(x)


def pca_columns(df: DataFrame, fitted, vector: str = "embedding", k: int = 16) -> DataFrame:
    """text_pca_NN columns; rows without a vector get zeros."""
    has = df.where(F.col(vector).isNotNull()).withColumn("_vec", array_to_vector(F.col(vector).cast("array<double>")))
    z = vector_to_array("_axes")
    names = [f"text_pca_{i:02d}" for i in range(k)]
    out = fitted.transform(has).select(*df.columns, *[z[i].alias(n) for i, n in enumerate(names)])
    return out.unionByName(df.where(F.col(vector).isNull()).select("*", *[F.lit(0.0).alias(n) for n in names]))


def hashing_embedder(dim: int = 384):
    """An offline embedder with the interface of a model: 'query: ' prefix, hashed words and letter triples, unit length."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            if not t or not t.strip():
                out.append([0.0] * dim)
                continue
            t = t if t.startswith("query: ") else "query: " + t
            v = np.zeros(dim)
            for w in t.lower().split():
                for f in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
                    v[h % dim] += 1 if h >> 63 else -1
            out.append((v / max(1e-12, float(np.linalg.norm(v)))).tolist())
        return pd.Series(out)

    return embed


def scorecard(df: DataFrame, weights: dict[str, float], intercept: float) -> Column:
    """Probability of a linear model over plain columns."""
    return C.sigmoid(sum((F.col(c).cast("double") * w for c, w in weights.items()), F.lit(intercept)))


def score_batch(df: DataFrame, probability: Column, calibrate, p1: float, p2: float, version: str, clusters: DataFrame | None = None, reasons: Column | None = None) -> DataFrame:
    """(lead_id, asof, model_version, probability, band, duplicate_cluster_size[, reasons])."""
    p = C.clip01(calibrate(probability) if calibrate else probability)
    x = df.withColumn("probability", p).withColumn("band", C.band(F.col("probability"), p1, p2)).withColumn("asof", C.scoring_moment(F.col("created_at")))
    if clusters is not None:
        x = x.join(clusters.select("lead_id", F.col("cluster_size").alias("duplicate_cluster_size")), "lead_id", "left")
    else:
        x = x.withColumn("duplicate_cluster_size", F.lit(None).cast("long"))
    out = [F.col("lead_id"), F.col("asof"), F.lit(version).alias("model_version"), F.col("probability"), F.col("band"), F.coalesce("duplicate_cluster_size", F.lit(1)).alias("duplicate_cluster_size")]
    return x.select(*out, *([reasons.alias("reasons")] if reasons is not None else []))


def report(said: dict[str, float | None], title: str = "Evaluation") -> str:
    """Markdown table of metrics, six decimals, NA for none."""
    return "\n".join([f"# {title}", "", "| Metric | Value |", "|---|---|", *(f"| {k} | {'NA' if v is None else f'{v:.6f}'} |" for k, v in said.items())]) + "\n"


def metadata_hash(fields: dict) -> str:
    return hashlib.sha256(json.dumps(fields, sort_keys=True, default=str).encode()).hexdigest()
