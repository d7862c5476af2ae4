"""Fitting and scoring with Spark ML: the three models of the cascade, and a plain classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from raresift.constants import (
    MAX_FEATURE_MISSING_PERCENT,
    MERGED_RARE_CODE,
    NOTABLE_IMPORTANCE,
    RARE_CODES,
    SEED,
    TOP_FEATURES,
)
from raresift.functions.values import position_of_max
from raresift.operators.cleaning import id_like_columns, impute_constant, require_target
from raresift.operators.encoding import factorize, merged_code
from raresift.operators.incontext import ContextClassifier, fit_context
from raresift.operators.metrics import with_balanced_weight
from raresift.operators.profiling import importance_table, missing_counts
from raresift.operators.sampling import augmented_specialist_sample, group_counts, specialist_sample
from raresift.operators.sizing import small_table
from raresift.operators.trees import TreeEnsemble, fit_balanced_forest, fit_boosted
from raresift.schema import require_columns, split_by_type
from raresift.session import ensure_checkpoint_dir

VECTOR = "_features"
# Memory for the split statistics of one group of tree nodes, MiB.
TREE_MEMORY_MB = 512
# Rows that a task of a Spark ML fit keeps and reads again for every level.
FIT_ROWS = 250_000


def with_vector(df: DataFrame, features: Sequence[str], output: str = VECTOR) -> DataFrame:
    require_columns(df, features)
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


@dataclass(frozen=True)
class CodedModel:
    """A fitted model whose internal classes 0..k-1 stand for the given codes."""

    model: Model | TreeEnsemble | ContextClassifier | None  # None when only one class was seen
    codes: tuple[int, ...]

    def probabilities(self, df: DataFrame, output: str) -> DataFrame:
        """Add the class probabilities as an array, in the order of ``codes``."""
        if len(self.codes) == 1:
            return df.withColumn(output, F.array(F.lit(1.0)))
        if isinstance(self.model, TreeEnsemble | ContextClassifier):
            return df.withColumn(output, self.model.probability(vector_to_array(VECTOR)))
        return self.model.transform(df).withColumn(output, vector_to_array("probability")).select(*df.columns, output)

    def classify(self, df: DataFrame, label: str, confidence: str) -> DataFrame:
        """Add the most likely code and its probability."""
        scored = self.probabilities(df, "_p")
        codes = F.array(*[F.lit(code) for code in self.codes])
        return scored.withColumns({label: F.get(codes, position_of_max(F.col("_p"))), confidence: F.array_max("_p")}).drop("_p")

    def probability_of(self, df: DataFrame, code: int, output: str) -> DataFrame:
        """Add the probability of one code; zero when the model never saw it."""
        if code not in self.codes:
            return df.withColumn(output, F.lit(0.0))
        return self.probabilities(df, "_p").withColumn(output, F.get("_p", F.lit(self.codes.index(code)))).drop("_p")


def _reindexed(df: DataFrame, code: str, output: str, counts: dict | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """Add class positions 0..k-1 as double, which Spark ML asks for."""
    codes = tuple(sorted(group_counts(df, code) if counts is None else counts))
    table = small_table(
        df.sparkSession, {"_code": codes, output: [float(i) for i in range(len(codes))]}, {"_code": pa.int64(), output: pa.float64()}
    )
    return df.join(F.broadcast(table), F.col(code) == F.col("_code")).drop("_code"), codes  # one row per class


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """As many partitions as keep each near ``FIT_ROWS`` rows; a table that needs one only is returned as it is."""
    parts = -(-rows // FIT_ROWS)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else df


def _fit(estimator, df: DataFrame, code: str, features: Sequence[str], weighted: bool) -> CodedModel:
    ensure_checkpoint_dir(df.sparkSession)
    wanted = df.select(code, *features)
    counts = group_counts(wanted, code)
    indexed, codes = _reindexed(wanted, code, "_label", counts)
    if not codes:
        raise ValueError("cannot fit a classifier without rows")
    if len(codes) == 1:
        return CodedModel(None, codes)
    if weighted:
        indexed = with_balanced_weight(indexed, code, "_weight")
    kept = ["_label", VECTOR, *(["_weight"] if weighted else [])]
    table = _dealt(with_vector(indexed, features).select(*kept), sum(counts.values()))
    estimator = estimator.copy({estimator.getParam("featuresCol"): VECTOR, estimator.getParam("labelCol"): "_label"})
    if weighted:
        estimator = estimator.copy({estimator.getParam("weightCol"): "_weight"})
    # The copy leaves the training summary behind. It holds the session, and a model that carries it cannot be
    # sent to executors once the session has observed a query.
    return CodedModel(estimator.fit(table).copy(), codes)


def forest(trees: int, depth: int, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True, checkpointInterval=10
    )


def _fit_bagged(df: DataFrame, code: str, id_col: str, features: Sequence[str], trees: int, depth: int, seed: int) -> CodedModel:
    """A forest whose trees see all classes alike; the draws are keyed by id."""
    indexed, codes = _reindexed(df.select(id_col, code, *features), code, "_label")
    if not codes:
        raise ValueError("cannot fit a classifier without rows")
    if len(codes) == 1:
        return CodedModel(None, codes)
    return CodedModel(fit_balanced_forest(indexed, features, "_label", id_col, len(codes), trees, depth, seed), codes)


def _fit_context(df: DataFrame, code: str, features: Sequence[str], views: int, seed: int) -> CodedModel:
    """A classifier over the rows of a bounded sample."""
    indexed, codes = _reindexed(df.select(code, *features), code, "_label")
    if not codes:
        raise ValueError("cannot fit a classifier without rows")
    if len(codes) == 1:
        return CodedModel(None, codes)
    return CodedModel(fit_context(indexed, features, "_label", len(codes), views, seed), codes)


def _fit_softmax(df: DataFrame, code: str, features: Sequence[str], rounds: int, depth: int, rate: float, weighted: bool) -> CodedModel:
    """Boosted trees for any number of classes, all classes in one loss."""
    indexed, codes = _reindexed(df.select(code, *features), code, "_label")
    if not codes:
        raise ValueError("cannot fit a classifier without rows")
    if len(codes) == 1:
        return CodedModel(None, codes)
    if weighted:
        indexed = with_balanced_weight(indexed, code, "_weight")
    return CodedModel(fit_boosted(indexed, features, "_label", len(codes), "_weight" if weighted else None, rounds, depth, rate), codes)


@dataclass(frozen=True)
class CascadeConfig:
    """Sizes of the three models. The defaults are the published ones; the gate's depth is set here."""

    rare_codes: tuple[int, ...] = RARE_CODES
    gate_trees: int = 300
    gate_depth: int = 10
    specialist_views: int = 32
    generalist_rounds: int = 200
    generalist_depth: int = 6
    generalist_rate: float = 0.1
    use_augmentation: bool = False
    seed: int = SEED


@dataclass(frozen=True)
class Cascade:
    """Gatekeeper (balanced bags), specialist (bounded context) and generalist (softmax boosting) over the same features."""

    features: tuple[str, ...]
    gatekeeper: CodedModel
    specialist: CodedModel
    generalist: CodedModel
    rare_codes: tuple[int, ...] = field(default=RARE_CODES)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p_rare, spec_label, spec_conf, gen_label, gen_conf``: no row moves; own trees score Arrow batches."""
        scored = with_vector(df, self.features)
        scored = self.gatekeeper.probability_of(scored, MERGED_RARE_CODE, "p_rare")
        scored = self.specialist.classify(scored, "spec_label", "spec_conf")
        scored = self.generalist.classify(scored, "gen_label", "gen_conf")
        return scored.drop(VECTOR)


def train_cascade(
    df: DataFrame, features: Sequence[str], code: str, id_col: str, config: CascadeConfig = CascadeConfig()
) -> Cascade:
    """Fit the three models on a scaled table with integer class codes."""
    rare = config.rare_codes
    merged = df.withColumn("_merged", merged_code(F.col(code), rare))
    gatekeeper = _fit_bagged(merged, "_merged", id_col, features, config.gate_trees, config.gate_depth, config.seed)

    if config.use_augmentation:
        table = augmented_specialist_sample(df, features, code, id_col, rare, seed=config.seed)
    else:
        table = specialist_sample(df, code, id_col, rare, seed=config.seed)
    specialist = _fit_context(table, "spec_code", features, config.specialist_views, config.seed)

    common = df.filter(~F.col(code).isin(*rare))
    generalist = _fit_softmax(
        common, code, features, config.generalist_rounds, config.generalist_depth, config.generalist_rate, weighted=True
    )
    return Cascade(tuple(features), gatekeeper, specialist, generalist, tuple(rare))


def train_classifier(
    df: DataFrame,
    features: Sequence[str],
    code: str,
    kind: str = "rf",
    balanced: bool = True,
    trees: int = 100,
    depth: int | None = None,
    seed: int = SEED,
) -> CodedModel:
    """A classifier over all classes: a forest (``rf``) or boosted trees with one loss for all classes (``xgb``)."""
    if kind == "rf":
        return _fit(forest(trees, depth or 10, seed), df, code, features, balanced)
    if kind == "xgb":
        return _fit_softmax(df, code, features, trees, depth or 6, 0.1, balanced)
    raise ValueError(f"unknown classifier {kind!r}: use 'rf' or 'xgb'")


def feature_importance(
    df: DataFrame,
    target: str,
    position: str,
    trees: int = 100,
    depth: int = 10,
    limit: int = TOP_FEATURES,
    max_missing: float = MAX_FEATURE_MISSING_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``feature, importance, missing_percent, notable`` of a balanced forest over every usable column.

    Text columns are numbered by first appearance along ``position`` unless they look like ids; missing
    numbers get a constant. Missing percentages are over all rows, before rows without target go.
    """
    require_columns(df, [target, position])
    columns = [name for name in df.columns if name not in (target, position)]
    text, numeric = split_by_type(df, columns)
    dropped = set(id_like_columns(df, text))
    coded = [name for name in text if name not in dropped]
    features = [name for name in columns if name in {*coded, *numeric}]
    missing = missing_counts(df, features, only_missing=False)
    table = df
    for name in coded:
        table = factorize(table, name, position, f"_code_{name}").drop(name).withColumnRenamed(f"_code_{name}", name)
    table = factorize(require_target(impute_constant(table, numeric), target), target, position, "_target")
    model = _fit(forest(trees, depth, seed), table, "_target", features, weighted=True)
    weights = model.model.featureImportances.toArray()
    importances = small_table(
        df.sparkSession,
        {"feature": features, "importance": [float(weight) for weight in weights]},
        {"feature": pa.string(), "importance": pa.float64()},
    )
    return importance_table(importances, missing, limit, max_missing, NOTABLE_IMPORTANCE)

