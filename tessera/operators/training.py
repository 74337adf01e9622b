"""Training runs: dataset assembly, saved bundles, tree contributions, text features, ablation and reports."""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import explain, labels, metrics, model, pit, validate
from tessera.plans.scratch import materialise

REQUIRED = ("version", "champion_name", "preprocessor", "champion_model", "calibrator", "band_thresholds")
_MODELS = {"trees": GBTClassificationModel, "logistic": LogisticRegressionModel}


@dataclasses.dataclass
class Dataset:
    """One row per mature lead in every field, by lead_id."""

    features: DataFrame
    target: DataFrame
    created_at: DataFrame
    ids: DataFrame
    split: DataFrame


def assemble(leads: DataFrame, messages: DataFrame, calls: DataFrame, localities: DataFrame | None, stages: DataFrame, export: Column, hidden_start: str, weeks: int = 4, calibration: float = 0.20, clusters: DataFrame | None = None, days: int = 30, stage: str = "Admission Done", key: str = "lead_id", **blocks) -> Dataset:
    """Labels, mature leads, point-in-time features of these (with the clusters' block if given) and the time split."""
    labelled = labels.label_maturity(leads, stages, export, days, stage, True, key)
    mature = labels.semi(leads, labelled)
    if clusters is not None:
        clusters = labels.semi(clusters, labelled)
    features = pit.feature_matrix(mature, messages, calls, localities, clusters=clusters, key=key, **blocks)
    target = features.select("lead_id").join(labelled.select("lead_id", "target"), "lead_id", "left")
    split = labels.time_split(labelled.select("lead_id", "created_at"), hidden_start, weeks, calibration).select("lead_id", "split")
    return Dataset(features, target, labelled.select("lead_id", "created_at"), features.select("lead_id"), split)


def reindex(df: DataFrame, keys: DataFrame, key: str = "lead_id") -> DataFrame:
    """A row for each row of keys, with nulls where df has none; repeated keys of df are an error."""
    return keys.select(key).join(validate.unique(df, key), key, "left")


# bundles
def save_bundle(folder: str, preprocessor: PipelineModel, champion_model, fields: dict) -> None:
    """Writes the fitted parts and a JSON text of the rest (version, champion_name, calibrator, band_thresholds, ...)."""
    spark = SparkSession.active()
    preprocessor.write().overwrite().save(f"{folder}/preprocessor")
    champion_model.write().overwrite().save(f"{folder}/champion_model")
    said = fields | {"preprocessor": "preprocessor", "champion_model": "champion_model"}
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/bundle")


def load_bundle(folder: str) -> dict:
    """The saved bundle with its parts loaded; an absent folder or a missing key is an error."""
    from pyspark.errors import AnalysisException

    spark = SparkSession.active()
    try:
        rows = spark.read.text(f"{folder}/bundle").collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"no bundle in {folder}") from e
    said = json.loads("".join(r[0] for r in rows))
    if missing := sorted(set(REQUIRED) - set(said)):
        raise ValueError(f"bundle without {missing}")
    c = said["calibrator"]
    said["calibrator"] = None if c is None else model.Platt(*c["platt"]) if "platt" in c else model.Isotonic([tuple(k) for k in c["isotonic"]])
    said["preprocessor"] = PipelineModel.load(f"{folder}/preprocessor")
    said["champion_model"] = _MODELS[said["champion_name"]].load(f"{folder}/champion_model")
    return said


def score_bundle(bundle: dict, features: DataFrame, created: DataFrame, clusters: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Batch scores of a feature table: prediction, calibration, bands, cluster sizes and, given the transformed features' names, reasons.

    Ids must be there and unique; leads without a cluster have size 1.
    """
    validate.not_null(features, ["lead_id"])
    x = validate.unique(features, "lead_id").join(created.select("lead_id", "created_at"), "lead_id")
    x = bundle["champion_model"].transform(bundle["preprocessor"].transform(x)).withColumn("_p", vector_to_array("probability")[1])
    reasons = None
    if names is not None:
        x, parts = contributions(bundle["champion_model"], x, names)
        reasons = explain.top_reasons(parts, features.columns)
    t = bundle["band_thresholds"]
    return model.score_batch(x, F.col("_p"), bundle["calibrator"], t["p1"], t["p2"], bundle["version"], clusters, reasons)


# contributions
def leaf_paths(fitted: GBTClassificationModel) -> list[list[tuple[float, dict]]]:
    """For each tree its leaves as (value times the tree's weight, {feature: [(kind, bound, goes left, share of rows)]})."""

    def walk(node, above):
        if node.getClass().getSimpleName() == "LeafNode":
            return [(float(node.prediction()), above)]
        split, n = node.split(), float(node.impurityStats().count())
        kind = "at_most" if split.getClass().getSimpleName() == "ContinuousSplit" else "among"
        bound = float(split.threshold()) if kind == "at_most" else tuple(split.leftCategories())
        out = []
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            step = (kind, bound, left, float(child.impurityStats().count()) / n)
            f = int(split.featureIndex())
            out += walk(child, above | {f: [*above.get(f, []), step]})
        return out

    java = fitted._java_obj
    return [[(v * w, path) for v, path in walk(tree.rootNode(), {})] for tree, w in zip(java.trees(), list(java.treeWeights()))]


def shapley(trees: list[list[tuple[float, dict]]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features, base): exact Shapley values of the sum of trees, features outside a coalition averaged by the shares of rows.

    A leaf's game is a product over its path's features, so its values are sums over the coefficients of a polynomial.
    """
    out, base = np.zeros(x.shape), 0.0
    for leaves in trees:
        for value, path in leaves:
            names, d = list(path), len(path)
            share = [math.prod(s[3] for s in path[f]) for f in names]
            met = []
            for f in names:
                ok = np.ones(len(x), bool)
                for kind, bound, left, _ in path[f]:
                    ok &= ((x[:, f] <= bound) if kind == "at_most" else np.isin(x[:, f], bound)) == left
                met.append(ok.astype(float))
            base += value * math.prod(share)
            for i, f in enumerate(names):
                poly = np.zeros((len(x), d))
                poly[:, 0] = 1.0
                for j in range(d):
                    if j != i:
                        poly[:, 1:] = poly[:, 1:] * share[j] + poly[:, :-1] * met[j][:, None]
                        poly[:, 0] *= share[j]
                weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
                out[:, f] += value * (met[i] - share[i]) * (poly @ weight)
    return out, base


def contributions(fitted, transformed: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with the parts that features have in the log odds, and these as columns by name.

    Trees: exact Shapley values. Linear models: coefficient times value.
    """
    v = vector_to_array("features")
    if isinstance(fitted, LogisticRegressionModel):
        return transformed, {n: v[k] * float(w) for k, (n, w) in enumerate(zip(names, fitted.coefficients.toArray()))}
    trees = leaf_paths(fitted)

    @F.pandas_udf("array<double>")
    def parts(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(2 * shapley(trees, np.stack(x.to_numpy()))[0]))

    out = transformed.withColumn("_parts", parts(v))
    return out, {n: F.col("_parts")[k] for k, n in enumerate(names)}


def importance_contributions(importances: list[float], names: list[str], most: int | None = None) -> dict[str, Column]:
    """Value times importance of each feature; with ``most`` the global order of the most important ones alone, for a row that can't be explained by itself."""
    ranked = sorted(range(len(names)), key=lambda k: (-importances[k], names[k]))[:most]
    v = vector_to_array("features")
    if most is not None:
        return {names[k]: F.lit(float(importances[k])) for k in ranked}
    return {names[k]: v[k] * float(importances[k]) for k in ranked}


# text
def text_block(leads: DataFrame, messages: DataFrame, embed, train: DataFrame | None = None, fitted=None, k: int = 16, key: str = "lead_id", **text) -> tuple[DataFrame, object]:
    """((lead_id, text_pca_00.., has_text), fitted axes): lead text, its vector and k principal axes, fitted on the leads of ``train`` unless given.

    Leads without text have zeros and flag 0. ``embed`` is any column function from text to a vector, as model.hashing_embedder() or onnx_embedder().
    """
    t = pit.lead_text(leads, messages, key=key, **text)
    vectors = t.withColumn("embedding", F.when(F.col("has_text") == 1, embed(F.col("text"))))
    if fitted is None:
        fitted = model.fit_pca(labels.semi(vectors, train) if train is not None else vectors, k=k)
    return model.pca_columns(vectors.select("lead_id", "has_text", "embedding"), fitted, k=k).drop("embedding"), fitted


def onnx_embedder(model_path: str, tokenizer_path: str, most: int = 512, batch: int = 32):
    """A column function from text to a unit vector by an ONNX model: one session a worker, batches of texts, masked mean of the last layer.

    The paths must be readable on every executor; the tokenizer is a file of the tokenizers package.
    """

    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(most)
        tokenizer.enable_padding()
        for texts in parts:
            out = []
            for a in range(0, len(texts), batch):
                found = tokenizer.encode_batch([with_prefix(t) for t in texts.iloc[a : a + batch]])
                ids, mask = (np.array([getattr(e, n) for e in found], np.int64) for n in ("ids", "attention_mask"))
                hidden = session.run(["last_hidden_state"], {"input_ids": ids, "attention_mask": mask})[0]
                out += pooled(hidden, mask).tolist()
            yield pd.Series(out, dtype=object)

    embed.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # not as text, which the worker's signature needs
    return F.pandas_udf(embed, "array<float>")


def with_prefix(text: str | None) -> str:
    text = text or ""
    return text if text.startswith("query: ") else "query: " + text


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit length means of the rows of each item whose mask is not 0."""
    m = mask[:, :, None].astype(np.float64)
    mean = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


TREE_PARAMETERS = ("maxDepth", "maxIter", "stepSize", "subsamplingRate", "minInstancesPerNode", "featureSubsetStrategy", "maxBins")


def ablation(fitted: GBTClassificationModel, data: DataFrame, numeric: list[str], categorical: list[str], text: DataFrame, split: str = "split", label: str = "y", seed: int = model.SEED) -> dict[str, dict[str, float]]:
    """{without_text, with_text}: the six ranking metrics on the validation rows of trees with a fitted model's own parameters and number of trees.

    Both sides are trained from scratch on the train rows; they differ in the text columns only.
    """
    draw = {p: fitted.getOrDefault(p) for p in TREE_PARAMETERS} | {"maxIter": fitted.getNumTrees}
    names = [c for c in text.columns if c != "lead_id"]
    x = materialise(data.join(text, "lead_id", "left").fillna(0.0, names), "ablation")
    out = {}
    for side, extra in (("without_text", []), ("with_text", names)):
        train, valid = x.where(F.col(split) == "train"), x.where(F.col(split) == "validation")
        prepared = model.preprocessor(train, [*numeric, *extra], categorical)
        trees = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **draw).fit(prepared.transform(train))
        scored = model.probabilities(trees, prepared.transform(valid), label)
        out[side] = {k: float(v) for k, v in metrics.bundle(scored, "lead_id", calibration=False).first().asDict().items()}
    return out


# reports
def _table(said: dict[str, float | None]) -> list[str]:
    return ["| Metric | Value |", "|---|---:|", *(f"| {k} | {'NA' if v is None or math.isnan(v) else f'{v:.6f}'} |" for k, v in said.items()), ""]


def evaluation_report(command: str, split: dict, logistic: dict, trees: dict, champion: str, calibrated: dict, bands: dict, trials: int, method: str) -> str:
    """Markdown of a training run: command, time split, metrics of both models and of the calibration slice, thresholds."""
    out = ["# Evaluation", "", f"Champion: **{champion}**", "", "## Command", "", "```bash", command, "```", "", "## Time split", ""]
    out += [*(f"- `{k}`: {v}" for k, v in split.items()), ""]
    for title, said in (("Validation: logistic regression", logistic), ("Validation: boosted trees", trees), ("Calibration slice", calibrated)):
        out += [f"## {title}", "", *_table(said)]
    out += ["## Bands", "", f"- P1 from `{bands['p1']:.6f}`", f"- P2 from `{bands['p2']:.6f}`", "", f"Calibration: **{method}**. Trials of the tree search: `{trials}` of at most {model.TRIALS}."]
    return "\n".join(out) + "\n"


def model_card(champion: str, method: str, split: dict, calibrated: dict, seed: int = model.SEED) -> str:
    """Markdown card of the champion: model, windows of each part of the split, calibration."""
    out = ["# Model card", "", "## Model", "", f"- Champion: `{champion}`", f"- Calibration: `{method}`", f"- Seed: `{seed}`", "", "## Windows", ""]
    out += [f"- {part}: {split[part + '_min']} to {split[part + '_max']}" for part in ("train", "validation", "calibration")]
    out += [f"- Hidden from {split['hidden_start']}", "", "## Calibration", "", *(f"- {k}: {calibrated[k]:.6f}" for k in ("brier", "ece"))]
    return "\n".join(out) + "\n"


def split_info(dated: DataFrame, hidden_start: str) -> dict:
    """First and last times and rows of each part, as text, for the reports."""
    out: dict = {"hidden_start": hidden_start}
    for r in labels.describe_split(dated).orderBy("split").collect():
        out |= {f"{r['split']}_rows": r["rows"], f"{r['split']}_min": str(r["first"]), f"{r['split']}_max": str(r["last"])}
    return out


def train(data: Dataset, numeric: list[str], categorical: list[str], folder: str, version: str, hidden_start: str, command: str = "", method: str = "platt", trials: int = model.TRIALS, trees: int = model.TREES) -> dict:
    """Fits both models, calibrates the champion on its slice and writes the bundle; returns metrics, thresholds and texts of the reports."""
    x = data.features.join(data.target.select("lead_id", F.col("target").alias("y")), "lead_id").join(data.split, "lead_id")
    x = validate.both_classes(materialise(x.where("split is not null"), "training"), "split", "y")
    part = lambda s: x.where(F.col("split") == s)
    scale = model.numeric_parameters(part("train"), numeric)
    ready = lambda s: model.standardise(part(s), scale)
    prepared = model.preprocessor(ready("train"), numeric, categorical)
    got = {s: prepared.transform(ready(s)).persist() for s in ("train", "validation", "calibration")}  # read in every round of a fit
    linear = model.fit_logistic(got["train"])
    boosted, rows = model.fit_trees(got["train"], got["validation"], trials=trials, trees=trees)
    keys = [model.ranking_key(model.probabilities(m, got["validation"]), "lead_id") for m in (linear, boosted)]
    name = model.champion(*keys)
    best = boosted if name == "trees" else linear
    raw = model.probabilities(best, got["calibration"])
    fix = model.calibrator(method, raw)
    scored = raw.withColumn("p", fix(F.col("p")))
    one = lambda m: metrics.bundle(model.probabilities(m, got["validation"]), "lead_id", calibration=False).first().asDict()
    both = one(linear), one(boosted)
    calibrated, bands = metrics.bundle(scored, "lead_id").first().asDict(), metrics.thresholds(scored).first().asDict()
    split = split_info(data.created_at.join(data.split, "lead_id"), hidden_start)
    shape = {"platt": [fix.slope, fix.intercept]} if method == "platt" else {"isotonic": fix.knots}
    for part_of in got.values():
        part_of.unpersist()
    fields = {"version": version, "champion_name": name, "calibrator": shape, "band_thresholds": bands, "numeric": numeric, "categorical": categorical, "scale": scale, "feature_list": [*numeric, *categorical]}
    save_bundle(folder, prepared, best, fields)
    report = evaluation_report(command, split, *both, name, calibrated, bands, len(rows), method)
    return {"champion": name, "calibrated": calibrated, "bands": bands, "report": report, "card": model_card(name, method, split, calibrated), "metadata_hash": model.metadata_hash({k: fields[k] for k in ("version", "champion_name", "band_thresholds")})}
