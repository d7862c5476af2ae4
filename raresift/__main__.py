"""Jobs for ``spark-submit``: train, score, stream, curate, contaminants, importance, columns and quality.

    spark-submit raresift/__main__.py train --training t.csv --contaminants c.csv --bundles models --name run1
    spark-submit raresift/__main__.py score --catalogue c.parquet --bundles models --name run1 --output verdicts
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession, types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raresift.constants import CONTAMINANT_LABEL_COLUMN, GATE_THRESHOLD, ID_COLUMN, LABEL_COLUMN, SPECIALIST_THRESHOLD  # noqa: E402
from raresift.operators.cleaning import coerce_features  # noqa: E402
from raresift.operators.curation import row_delta  # noqa: E402
from raresift.operators.cleaning import drop_columns  # noqa: E402
from raresift.operators.models import CascadeConfig, feature_importance  # noqa: E402
from raresift.operators.profiling import quality_report  # noqa: E402
from raresift.plans.score import score_to_files  # noqa: E402
from raresift.plans.train import TrainConfig, profile_contaminants, train  # noqa: E402
from raresift.schema import preset  # noqa: E402
from raresift.sources.bundle import load_bundle, save_bundle  # noqa: E402
from raresift.sources.tables import format_of, read_catalogue, read_known_lists, read_optional_table, read_table, rewrite_without  # noqa: E402
from raresift.streaming.score_stream import score_stream, stream_catalogue  # noqa: E402


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="raresift", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *needed: str) -> argparse.ArgumentParser:
        made = jobs.add_parser(name)
        for option in needed:
            made.add_argument(f"--{option}", required=True)
        made.add_argument("--id", default=ID_COLUMN, help="id column")
        made.add_argument("--format", default=None, help="csv, parquet, ...; guessed from the path when left out")
        return made

    training = job("train", "training", "bundles", "name")
    training.add_argument("--contaminants", default=None)
    training.add_argument("--label", default=LABEL_COLUMN)
    training.add_argument("--preset", default="default")
    training.add_argument("--reconstruction", choices=("linear", "dense"), default="linear")
    training.add_argument("--augment", action="store_true")
    training.add_argument("--sweep", type=float, nargs="+", default=[SPECIALIST_THRESHOLD])
    for name in ("score", "stream"):
        made = job(name, "catalogue", "bundles", "name", "output")
        made.add_argument("--known", nargs="*", default=[], help="tables whose ids are skipped")
        made.add_argument("--done", nargs="*", default=[], help="earlier verdicts whose ids are skipped")
        made.add_argument("--output-format", default="parquet")
        made.add_argument("--gate-threshold", type=float, default=GATE_THRESHOLD)
        made.add_argument(
            "--specialist-threshold", default=str(SPECIALIST_THRESHOLD), help="a number, or 'best' for the one found in training"
        )
        if name == "score":
            made.add_argument("--shards", type=int, default=None)
        else:
            made.add_argument("--checkpoint", required=True)
            made.add_argument("--once-per-id", action="store_true", help="remember scored ids; skip one that arrives again")
    job("curate", "first", "second", "target", "output")
    made = job("contaminants", "catalogue", "output")
    made.add_argument("--preset", default="default")
    made.add_argument("--label", default=CONTAMINANT_LABEL_COLUMN)
    made = job("importance", "catalogue", "output", "target")
    made.add_argument("--preset", default="default")
    made.add_argument("--numbers", nargs="*", default=None, help="columns read as numbers; the preset's when left out")
    made.add_argument("--trees", type=int, default=100)
    made.add_argument("--depth", type=int, default=10)
    job("columns", "catalogue", "output").add_argument("--drop", nargs="+", required=True)
    job("quality", "catalogue").add_argument("--preset", default="default")
    return top


def _threshold(asked: str, best: float | None) -> float:
    if asked != "best":
        return float(asked)
    if best is None:
        raise ValueError("the bundle was saved without a best threshold")
    return best


def run(spark: SparkSession, options: argparse.Namespace) -> object:
    if options.job == "train":
        features = preset(options.preset)
        config = TrainConfig(
            name=options.name,
            reconstruction=options.reconstruction,
            sweep=tuple(options.sweep),
            cascade=CascadeConfig(use_augmentation=options.augment),
        )
        labelled = read_catalogue(spark, options.training, features, options.id, options.label, options.format)
        # A path without a table is no reason to stop: the fit then uses noise, and the answer says so.
        junk = read_optional_table(spark, options.contaminants, options.format)
        made = train(labelled, junk, features, options.label, options.id, config)
        place = save_bundle(spark, made.bundle, options.bundles)
        for name, report in {**made.profile, **made.reports}.items():
            report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{place}/reports/{name}")
        return {"bundle": place, "threshold": made.threshold, "filter": made.bundle.filter_type, "contaminants": junk is not None}
    if options.job == "contaminants":
        features = preset(options.preset)
        reports = profile_contaminants(read_table(spark, options.catalogue, options.format), features, options.label)
        for name, report in reports.items():
            report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{options.output}/{name}")
        return {"reports": sorted(reports)}
    if options.job == "importance":
        table = read_table(spark, options.catalogue, options.format)
        numbers = [name for name in options.numbers or preset(options.preset) if name in table.columns]
        table = coerce_features(table, numbers)
        found = feature_importance(table, options.target, options.id, options.trees, options.depth)
        found.coalesce(1).write.mode("overwrite").option("header", True).csv(options.output)
        return {"features": [row.feature for row in found.collect()]}  # a bounded top list
    if options.job == "columns":
        kind = format_of(options.catalogue, options.format)
        writer = drop_columns(read_table(spark, options.catalogue, kind), options.drop).write.mode("overwrite").format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(options.output)
        return {"columns": read_table(spark, options.output, kind).columns}
    if options.job == "quality":
        features = preset(options.preset)
        table = coerce_features(read_catalogue(spark, options.catalogue, features, options.id, fmt=options.format), features)
        return [row.asDict() for row in quality_report(table, features).collect()]  # one row per feature
    if options.job == "curate":
        first, second, target = (read_table(spark, getattr(options, name), options.format) for name in ("first", "second", "target"))
        return {"removed": rewrite_without(target, row_delta(first, second), options.output, format_of(options.target, options.format))}
    bundle = load_bundle(spark, options.bundles, options.name)
    limits = {"gate": options.gate_threshold, "threshold": _threshold(options.specialist_threshold, bundle.best_threshold)}
    known = read_known_lists(spark, options.known, options.done, options.id)
    if options.job == "score":
        catalogue = read_catalogue(spark, options.catalogue, bundle.features, options.id, fmt=options.format)
        return score_to_files(catalogue, bundle, options.output, options.id, known, options.output_format, options.shards, **limits)
    kind = format_of(options.catalogue, options.format)
    schema = read_table(spark, options.catalogue, kind).schema
    texts = T.StructType([T.StructField(field.name, T.StringType()) for field in schema]) if kind == "csv" else schema
    source = stream_catalogue(spark, options.catalogue, texts, kind)
    query = score_stream(source, bundle, options.output, options.checkpoint, options.id, known, options.output_format, **limits, once_per_id=options.once_per_id)
    query.awaitTermination()
    return {"batches": len(query.recentProgress)}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(arguments)
    session = spark or SparkSession.builder.appName(f"raresift-{options.job}").getOrCreate()
    print(json.dumps(run(session, options)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
