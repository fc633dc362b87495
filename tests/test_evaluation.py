"""Exported evaluation reports: one evaluation of the predictions, outputs that agree, defined cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftlake.operators import evaluation

SCHEMA = "id long, target int, probs array<double>"


def test_predictions(spark):
    rows = spark.createDataFrame([(1, 1, [0.2, 0.4, 0.4]), (2, 2, [0.2, 0.4, 0.4]), (3, 0, []), (4, 0, None), (5, None, [1.0])], SCHEMA)
    got = {r["id"]: (r["predicted"], r["confidence"], r["correct"]) for r in evaluation.predictions_table(rows).collect()}
    assert got == {1: (1, 0.4, True), 2: (1, 0.4, False), 3: (None, None, False), 4: (None, None, False), 5: (0, 1.0, False)}


def test_predictions_are_evaluated_once(spark, tmp_path):
    """The predictions are random on each evaluation, so outputs agree only if they come from one."""
    path = str(tmp_path / "report")
    random = spark.range(2000).select("id", (F.rand() * 4).cast("int").alias("target"), F.transform(F.array(*[F.rand() + 0.01 for _ in range(4)]), lambda x: x).alias("raw"))
    rows = evaluation.predictions_table(random.select("id", "target", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda t, y: t + y)).alias("probs")))
    evaluation.export_report(rows, 4, path)
    out = {(r["output"], r["class"], r["name"]): r["value"] for r in evaluation.read_report(spark, path, 4).collect()}
    kept = evaluation.read_predictions(spark, path, rows).collect()
    assert len(kept) == 2000 == out["metrics", -1, "n"]
    for t in range(4):
        for p in range(4):
            assert out["confusion", t, f"p{p}"] == sum(r["target"] == t and r["predicted"] == p for r in kept)
        assert sum(out["confusion_normalised", t, f"p{p}"] for p in range(4)) == pytest.approx(1)
        assert out["classification_report", t, "support"] == sum(r["target"] == t for r in kept)
    assert out["metrics", -1, "accuracy"] == pytest.approx(sum(r["correct"] for r in kept) / 2000)
    assert out["metrics", -1, "mean_all"] == pytest.approx(sum(r["confidence"] for r in kept) / 2000)
    wrong = evaluation.misclassified(spark, path, rows)
    assert sorted(r["id"] for r in wrong.collect()) == sorted(r["id"] for r in kept if not r["correct"])
    assert "PartitionFilters: [isnotnull(correct" in wrong._jdf.queryExecution().toString()
    with pytest.raises(PySparkException):
        evaluation.export_report(rows, 4, path)


def test_classes_out_of_range_raise(spark, tmp_path):
    rows = evaluation.predictions_table(spark.createDataFrame([(1, 7, [0.5, 0.5])], SCHEMA))
    with pytest.raises(PySparkException, match="class out of range"):
        evaluation.export_report(rows, 2, str(tmp_path / "r"))
