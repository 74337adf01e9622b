"""Commands: python -m tessera COMMAND --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import explain, labels, model, pit, resolve, training
from tessera.sources import files

NUMERIC = ["age", "creation_hour", "creation_weekday", *pit.COUNT_DEFAULTS, *pit.LATENCIES, "min_dist_to_branch"]
CATEGORICAL = ["source", "branch", "course_interest", "education_status"]


def _dataset(spark, a, clusters=None) -> training.Dataset:
    read = lambda n, p: files.read(spark, n, p, multi_line=a.multi_line)
    found = files.read(spark, "lead_clusters", clusters) if clusters else None
    export = F.lit(a.export_date).cast("timestamp")
    return training.assemble(read("leads", a.leads), read("messages", a.messages), read("calls", a.calls), read("localities", a.localities), read("stage_history", a.stages), export, a.hidden_start, a.validation_weeks, a.calibration_fraction, found, distances=["km_to_riverside", "km_to_central", "km_to_lakeview"])


def train(spark, a) -> None:
    said = training.train(_dataset(spark, a, a.lead_clusters), NUMERIC, CATEGORICAL, a.output_dir, a.version, a.hidden_start, "python -m tessera train", a.calibration_method, a.trials)
    for name in ("report", "card"):
        spark.createDataFrame([(said.pop(name),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.output_dir}/{name}")
    print(json.dumps(said, indent=2, default=str))


def score(spark, a) -> None:
    bundle, data = training.load_bundle(a.model_dir), _dataset(spark, a, a.lead_clusters)
    x = model.standardise(data.features, {k: tuple(v) for k, v in bundle["scale"].items()})
    sizes = files.read(spark, "lead_clusters", a.lead_clusters) if a.lead_clusters else None
    files.write(training.score_bundle(bundle, x, data.created_at, sizes), a.output, "parquet", "overwrite")


def explained(spark, a) -> None:
    bundle, data = training.load_bundle(a.model_dir), _dataset(spark, a, a.lead_clusters)
    x = model.standardise(data.features, {k: tuple(v) for k, v in bundle["scale"].items()})
    if a.max_rows is not None:
        x = x.orderBy("lead_id").limit(a.max_rows)
    ready = bundle["preprocessor"].transform(x)
    rows, parts = training.contributions(bundle["champion_model"], ready, model.feature_names(ready))
    reasons = explain.top_reasons(parts, data.features.columns)
    flat = [reasons[k][lang].alias(f"reason_{k + 1}_{lang}") for k in range(3) for lang in ("en", "hi")]
    files.write(rows.select("lead_id", *flat), a.output, "csv", "overwrite")


def ablation(spark, a) -> None:
    bundle, data = training.load_bundle(a.model_dir), _dataset(spark, a, a.lead_clusters)
    leads, messages = files.read(spark, "leads", a.leads), files.read(spark, "messages", a.messages)
    of_train = data.split.where("split = 'train'")
    text, _ = training.text_block(leads, messages, model.hashing_embedder(), of_train)
    x = data.features.join(data.target.select("lead_id", F.col("target").alias("y")), "lead_id").join(data.split, "lead_id")
    print(json.dumps(training.ablation(bundle["champion_model"], x, bundle["numeric"], bundle["categorical"], text), indent=2))


def dedupe(spark, a) -> None:
    leads = resolve.prepare(files.read(spark, "leads", a.leads))
    pairs = resolve.evidence(resolve.candidate_pairs(leads, {"phone": "phone_norm", "email": "email_norm"}), leads)
    accepted = pairs.where(resolve.rule(a.rule))
    members, done = resolve.clusters(leads, accepted, a.max_cluster)
    gold = resolve.golden(leads, members, files.read(spark, "stage_history", a.stages), accepted)
    files.write(gold, a.output, "csv", "overwrite")
    resolve.summary(leads, pairs, members, done=done).show(vertical=True)
    resolve.largest_clusters(members).show()


def evaluate(spark, a) -> None:
    resolve.rule_sweep(spark.read.option("header", True).option("inferSchema", True).csv(a.labels)).orderBy("rule").show(truncate=False)


def outcomes(spark, a) -> None:
    export = F.lit(a.export_date).cast("timestamp")
    labelled = labels.label_maturity(files.read(spark, "leads", a.leads), files.read(spark, "stage_history", a.stages), export)
    files.write(labelled.select("lead_id", F.col("target").alias("outcome")), a.output, "parquet", "overwrite")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    subs = top.add_subparsers(required=True)

    def command(name, run, needed, optional=()):
        p = subs.add_parser(name)
        p.set_defaults(run=run, multi_line=False)
        for n in needed:
            p.add_argument("--" + n, required=True)
        for n, d in optional:
            p.add_argument("--" + n, default=d, type=type(d) if d is not None else str)

    data = ["leads", "messages", "calls", "stages", "localities", "export-date"]
    cut = [("hidden-start", "2026-07-04 18:30:00"), ("validation-weeks", 4), ("calibration-fraction", 0.20), ("lead-clusters", None)]
    command("train", train, [*data, "output-dir"], [*cut, ("calibration-method", "platt"), ("trials", 12), ("version", "v1")])
    command("score", score, [*data, "model-dir", "output"], cut)
    command("explain", explained, [*data, "model-dir", "output"], [*cut, ("max-rows", None)])
    command("ablation", ablation, [*data, "model-dir"], cut)
    command("dedupe", dedupe, ["leads", "stages", "output"], [("rule", "both_keys_or_exact_or_prefix"), ("max-cluster", resolve.MAX_CLUSTER)])
    command("evaluate", evaluate, ["labels"])
    command("outcomes", outcomes, ["leads", "stages", "export-date", "output"])
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if getattr(a, "max_rows", None) is not None:
        a.max_rows = int(a.max_rows)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
