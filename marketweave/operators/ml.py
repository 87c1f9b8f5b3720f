"""Models on the feature store: training by walk-forward folds, attribution, selection, artifacts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 3
TREES = 20


def filled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles; nulls become 0."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def train_gbt(rows: DataFrame, features: Sequence[str], target: str, trees: int = TREES, depth: int = MAX_DEPTH, seed: int = 7) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=seed)]).fit(filled(rows, features))


def importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())))


def trees_of(model: GBTRegressionModel) -> list[tuple[float, dict]]:
    """(weight, nested tree) of each tree; nodes carry the number of training rows they saw."""

    def node(n) -> dict:
        out = {"n": float(n.impurityStats().count()), "value": float(n.prediction())}
        if n.subtreeDepth():
            split = n.split()
            out |= {"feature": int(split.featureIndex()), "threshold": float(split.threshold()), "left": node(n.leftChild()), "right": node(n.rightChild())}
        return out

    return [(float(w), node(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]


def _used(tree: dict) -> set[int]:
    return set() if "left" not in tree else {tree["feature"]} | _used(tree["left"]) | _used(tree["right"])


def expected(tree: dict, x: np.ndarray, known: frozenset) -> np.ndarray:
    """Mean prediction of each row if only ``known`` features are given: others follow the training rows."""
    if "left" not in tree:
        return np.full(len(x), tree["value"])
    left, right = expected(tree["left"], x, known), expected(tree["right"], x, known)
    if tree["feature"] in known:
        return np.where(x[:, tree["feature"]] <= tree["threshold"], left, right)
    return (tree["left"]["n"] * left + tree["right"]["n"] * right) / tree["n"]


def shap_values(trees: list[tuple[float, dict]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(exact Shapley values [rows, features], mean prediction).

    A tree of depth d uses at most 2**d - 1 features; all subsets of those it uses are summed.
    """
    out, base = np.zeros(x.shape), 0.0
    for weight, tree in trees:
        used = sorted(_used(tree))
        m = len(used)
        value = {frozenset(s): expected(tree, x, frozenset(s)) for k in range(m + 1) for s in combinations(used, k)}
        base += weight * float(value[frozenset()][0]) if len(x) else 0.0
        for s, v in value.items():
            for f in set(used) - s:
                share = factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m)
                out[:, f] += weight * share * (value[s | {f}] - v)
    return out, base


def attributions(rows: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep, shap_<feature>...), computed by Arrow batches."""
    trees, names = trees_of(model.stages[-1]), list(features)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`shap_{c}` double" for c in names)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, _ = shap_values(trees, frame[[f"_x_{c}" for c in names]].to_numpy(float))
            yield pd.concat([frame[list(keep)].reset_index(drop=True), pd.DataFrame(values, columns=[f"shap_{c}" for c in names])], axis=1)

    inputs = filled(rows, names).select(*keep, *[F.col(c).alias(f"_x_{c}") for c in names])
    return inputs.mapInPandas(run, schema)


def shap_summary(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (feature, mean_abs): the global ranking, in one pass."""
    means = values.agg(*[F.avg(F.abs(f"shap_{c}")).alias(c) for c in features])
    return means.unpivot([], list(features), "feature", "mean_abs")


def select_features(summary: DataFrame, k: int) -> list[str]:
    return [r.feature for r in summary.orderBy(F.col("mean_abs").desc(), "feature").limit(k).collect()]


def train_sentiment(labelled: DataFrame, text: str = "headline", label: str = "sentiment", size: int = 1 << 12) -> PipelineModel:
    """Term weights and a linear model; the labels come from a table."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        Tokenizer(inputCol=text, outputCol="words"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=size),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def score_sentiment(items: DataFrame, model: PipelineModel, text: str = "headline") -> DataFrame:
    """items with predicted_sentiment and intensity (the chance of the predicted label)."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    scorer = PipelineModel(model.stages[1:])
    out = scorer.transform(items)
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    best = F.array_max(vector_to_array("probability"))
    return out.select(*[F.col(c) for c in items.columns if c not in ("predicted_sentiment", "predicted_intensity")], named.alias("predicted_sentiment"), best.alias("predicted_intensity"))


def publish(model: PipelineModel, folder: str, version: str, metadata: dict) -> str:
    """Save the model and its metadata under folder/version; a version is never written twice."""
    spark = SparkSession.active()
    path = f"{folder.rstrip('/')}/{version}"
    model.write().save(f"{path}/model")
    body = json.dumps({"version": version, "created_at": datetime.now(UTC).isoformat()} | metadata, sort_keys=True)
    spark.createDataFrame([(body,)], "value STRING").coalesce(1).write.text(f"{path}/metadata")
    return path


def load(folder: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/{version}/model")
