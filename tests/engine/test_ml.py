import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.operators import ml


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(400).withColumns({"a": F.rand(1), "b": F.rand(2), "c": F.rand(3)})
    return r.withColumn("y", F.when(F.col("a") > 0.5, 3.0).otherwise(0.0) + F.col("b")).cache()


def test_exact_attributions_and_selection(spark, rows, tmp_path):
    names = ["a", "b", "c"]
    model = ml.train_gbt(rows, names, "y", trees=4, depth=2)
    assert ml.importances(model, names)["a"] > 0.3
    values = ml.attributions(rows, model, names, ["id"]).toPandas().set_index("id")
    pred = model.transform(ml.filled(rows, names)).select("id", "prediction", *names).toPandas().set_index("id")
    trees = ml.trees_of(model.stages[-1])
    _, base = ml.shap_values(trees, pred[names].to_numpy(float))
    total = values.sum(axis=1) + base
    assert np.allclose(total.loc[pred.index], pred["prediction"])
    summary = ml.shap_summary(ml.attributions(rows, model, names), names)
    assert ml.select_features(summary, 2) == ["a", "b"]
    path = ml.publish(model, str(tmp_path), "v1", {"features": names})
    assert ml.load(str(tmp_path), "v1").transform(ml.filled(rows, names)).count() == 400
    assert '"version": "v1"' in spark.read.text(f"{path}/metadata").first().value
    with pytest.raises(Exception):
        ml.publish(model, str(tmp_path), "v1", {})


def test_shapley_of_one_tree_by_hand():
    tree = {"n": 4.0, "value": 0.0, "feature": 0, "threshold": 0.5, "left": {"n": 1.0, "value": 8.0}, "right": {"n": 3.0, "value": 0.0}}
    values, base = ml.shap_values([(1.0, tree)], np.array([[0.0, 9.0], [1.0, 9.0]]))
    assert base == 2.0 and values.tolist() == [[6.0, 0.0], [-2.0, 0.0]]


def test_sentiment_model(spark):
    data = spark.createDataFrame([("profits rise", "positive"), ("profits soar", "positive"), ("losses mount", "negative"), ("losses widen", "negative"), ("meeting held", "neutral")] * 5, "headline string, sentiment string")
    model = ml.train_sentiment(data, size=256)
    out = ml.score_sentiment(spark.createDataFrame([("profits rise",), ("losses mount",)], "headline string"), model).collect()
    assert [r.predicted_sentiment for r in out] == ["positive", "negative"] and all(0 < r.predicted_intensity <= 1 for r in out)
