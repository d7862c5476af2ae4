"""A trained system as one folder: models (Spark ML's own format, or a table of nodes or context rows), parameters and metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession

from raresift.constants import FILTER_ISOLATION, FILTER_RECONSTRUCTION
from raresift.operators.encoding import LabelCodes
from raresift.operators.incontext import ContextClassifier, load_context
from raresift.operators.isolation import IsolationFilter, NODE_SCHEMA, isolation_from, strange
from raresift.operators.models import Cascade, CodedModel
from raresift.operators.reconstruction import DenseReconstruction, LinearReconstruction, above, reconstruction_from
from raresift.operators.scaling import MinMax
from raresift.operators.trees import TreeEnsemble, load_ensemble

OWN_KINDS = {"TreeEnsemble": load_ensemble, "ContextClassifier": load_context}
MODEL_KINDS = {"RandomForestClassificationModel": RandomForestClassificationModel}
MODEL_NAMES = ("gatekeeper", "specialist", "generalist")


@dataclass(frozen=True)
class Bundle:
    """Everything that scoring needs."""

    name: str
    scaler: MinMax
    filter_type: str
    filter_model: LinearReconstruction | DenseReconstruction | IsolationFilter
    threshold: float | None
    cascade: Cascade
    labels: LabelCodes | None = None
    #: Specialist threshold of the best F1 in the training sweep.
    best_threshold: float | None = None

    @property
    def features(self) -> list[str]:
        return list(self.scaler.features)

    def anomalous(self) -> Column:
        """Reconstruction errors are strange when high, isolation scores when negative."""
        return strange() if self.filter_type == FILTER_ISOLATION else above(self.threshold)

    def filtered(self, df: DataFrame) -> DataFrame:
        """Add ``filter_score`` and ``is_anomaly`` to scaled rows."""
        return self.filter_model.score(df).withColumn("is_anomaly", self.anomalous())


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first().value


def save_bundle(spark: SparkSession, bundle: Bundle, folder: str) -> str:
    """Write the bundle below ``folder/name``; any file system Spark can write will do."""
    place = f"{folder.rstrip('/')}/{bundle.name}"
    models: dict[str, dict] = {}
    for name in MODEL_NAMES:
        coded: CodedModel = getattr(bundle.cascade, name)
        models[name] = {"codes": list(coded.codes), "kind": type(coded.model).__name__ if coded.model else None}
        if isinstance(coded.model, TreeEnsemble | ContextClassifier):
            models[name]["about"] = coded.model.describe()
            coded.model.save(spark, f"{place}/{name}")
        elif coded.model:
            coded.model.write().overwrite().save(f"{place}/{name}")
    description = bundle.filter_model.describe()
    if isinstance(bundle.filter_model, IsolationFilter):
        nodes = description.pop("nodes")
        spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{place}/filter_nodes")
    parameters = {
        "scaler": {"low": list(bundle.scaler.low), "high": list(bundle.scaler.high)},
        "labels": list(bundle.labels.labels) if bundle.labels else None,
        "models": models,
        "filter": description,
        "best_threshold": bundle.best_threshold,
    }
    metadata = {
        "features": bundle.features,
        "rare_classes": list(bundle.cascade.rare_codes),
        "filter_type": bundle.filter_type,
        "ae_threshold": bundle.threshold,
        "exp_name": bundle.name,
    }
    _write_text(spark, json.dumps(parameters), f"{place}/parameters")
    # Last, so that a folder with metadata is a complete one.
    _write_text(spark, json.dumps(metadata), f"{place}/metadata.json")
    return place


def _load_model(spark: SparkSession, place: str, entry: dict):
    if entry["kind"] is None:
        return None
    if entry["kind"] in OWN_KINDS:
        return OWN_KINDS[entry["kind"]](spark, place, entry["about"])
    return MODEL_KINDS[entry["kind"]].load(place)


def load_bundle(spark: SparkSession, folder: str, name: str) -> Bundle:
    place = f"{folder.rstrip('/')}/{name}"
    try:
        metadata = json.loads(_read_text(spark, f"{place}/metadata.json"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no bundle at {place}") from error
        raise
    parameters = json.loads(_read_text(spark, f"{place}/parameters"))
    models = {name: CodedModel(_load_model(spark, f"{place}/{name}", entry), tuple(entry["codes"])) for name, entry in parameters["models"].items()}
    features = tuple(metadata["features"])
    filter_type = metadata.get("filter_type", FILTER_ISOLATION)
    description = parameters["filter"]
    if filter_type == FILTER_RECONSTRUCTION:
        filter_model = reconstruction_from(description)
    else:
        # Bounded by trees * 2 * sample rows.
        nodes = [tuple(row) for row in spark.read.parquet(f"{place}/filter_nodes").collect()]
        filter_model = replace(isolation_from({**description, "nodes": []}), nodes=tuple(sorted(nodes)))
    return Bundle(
        name=metadata["exp_name"],
        scaler=MinMax(features, tuple(parameters["scaler"]["low"]), tuple(parameters["scaler"]["high"])),
        filter_type=filter_type,
        filter_model=filter_model,
        threshold=metadata.get("ae_threshold"),
        cascade=Cascade(features, **models, rare_codes=tuple(metadata.get("rare_classes", ()))),
        labels=LabelCodes(tuple(parameters["labels"])) if parameters["labels"] else None,
        best_threshold=parameters.get("best_threshold"),
    )
