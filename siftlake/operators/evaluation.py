"""Evaluation reports: predictions evaluated once, and every other output from what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics

#: Outputs of a report by name; `misclassified` is the part of `predictions` that is wrong.
OUTPUTS = ("predictions", "confusion", "confusion_normalised", "classification_report", "metrics")


def predictions_table(rows: DataFrame) -> DataFrame:
    """(id, target, predicted, confidence, correct, probs) of rows (id, target, probs): the first of the largest probabilities is predicted. Rows without probabilities predict null and are wrong."""
    best = F.array_max("probs")
    predicted = F.when(F.size("probs") > 0, F.array_position("probs", best) - 1).cast("int")
    return rows.select("id", "target", predicted.alias("predicted"), best.alias("confidence"), F.coalesce(F.col("target") == predicted, F.lit(False)).alias("correct"), "probs")


def export_report(predictions: DataFrame, k: int, path: str, *, bins: int = 10) -> None:
    """Writes the outputs below `path`, which must not exist; `predictions` (id, target, predicted, confidence, correct, probs) is evaluated once.

    Predictions go to one folder for right and one for wrong ones, so that the wrong ones are read alone. The confusion matrix is counted
    from the two narrow columns of what was written, and all class measures come from its k x k cells. Classes outside 0..k-1 raise, rows
    without a prediction too.
    """
    spark = predictions.sparkSession
    predictions.write.mode("errorifexists").partitionBy("correct").parquet(f"{path}/predictions")
    rows = read_predictions(spark, path, predictions)
    metrics.confusion(rows, k).coalesce(1).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    each = metrics.class_metrics_of(cells)
    one = metrics.summary_of(each, k).join(metrics.calibration_error(rows, bins)).join(metrics.cross_entropy(rows).select("loss"))  # a row each
    write = lambda df, name, *order: df.repartitionByRange(1, *order).sortWithinPartitions(*order).write.option("header", True).csv(f"{path}/{name}")  # noqa: E731  # k rows
    write(metrics.wide_of(cells, k), "confusion", "target")
    write(metrics.wide_of(metrics.normalised_of(cells).withColumnRenamed("share", "n"), k), "confusion_normalised", "target")
    write(each.select("target", "precision", "recall", "f1", "support"), "classification_report", "target")
    one.coalesce(1).write.json(f"{path}/metrics")


def read_predictions(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{path}/predictions").select(like.columns)


def misclassified(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The wrong predictions of a report; the folder of right ones isn't read."""
    return read_predictions(spark, path, like).filter(~F.col("correct"))


def read_report(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(output, class, name, value): the class-sized outputs of a report as one table."""
    wide = "target int, " + ", ".join(f"p{i} double" for i in range(k))
    csv = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{path}/{name}")
    long = lambda df, output: df.select(F.lit(output).alias("output"), F.col("target").alias("class"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns[1:]))))
    parts = [long(csv(n, wide), n) for n in ("confusion", "confusion_normalised")]
    parts.append(long(csv("classification_report", "target int, precision double, recall double, f1 double, support long"), "classification_report"))
    one = spark.read.json(f"{path}/metrics")
    parts.append(long(one.select(F.lit(-1).alias("target"), "*"), "metrics"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
