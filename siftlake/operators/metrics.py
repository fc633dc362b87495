"""Classification metrics over predictions (id, target, predicted, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def classes(df: DataFrame, k: int) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("c"))


def confusion(rows: DataFrame, k: int) -> DataFrame:
    """(target, predicted, n) for all k x k cells; raises on a class outside 0..k-1."""
    bad = ~F.col("target").between(0, k - 1) | ~F.col("predicted").between(0, k - 1)
    counts = rows.withColumn("target", F.when(bad, F.raise_error(F.lit("class out of range"))).otherwise(F.col("target"))).groupBy("target", "predicted").agg(F.count("*").alias("n"))
    grid = classes(rows, k).select(F.col("c").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("predicted"))
    return grid.join(counts, ["target", "predicted"], "left").select("target", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(rows: DataFrame, k: int) -> DataFrame:
    """A row for each target with a column p0, p1, ... for each predicted class."""
    return wide_of(confusion(rows, k), k)


def wide_of(cells: DataFrame, k: int) -> DataFrame:
    return cells.groupBy("target").pivot("predicted", list(range(k))).agg(F.first("n")).withColumnsRenamed({str(i): f"p{i}" for i in range(k)})


def confusion_normalised(rows: DataFrame, k: int) -> DataFrame:
    """Cells as shares of their row; an empty row is zeros."""
    return normalised_of(confusion(rows, k))


def normalised_of(cells: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("target"))
    return cells.select("target", "predicted", F.coalesce(F.try_divide("n", total), F.lit(0.0)).alias("share"))


def class_metrics(rows: DataFrame, k: int) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 / 0 is 0."""
    return class_metrics_of(confusion(rows, k))


def class_metrics_of(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)
    by_target = cells.groupBy(F.col("target").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_guess = cells.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("guesses"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return by_target.join(by_guess, "c").select(
        F.col("c").alias("target"), ratio(F.col("hits"), F.col("guesses")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("guesses")).alias("f1"), "support", "hits",
    )


def summary_metrics(rows: DataFrame, k: int) -> DataFrame:
    """One row: accuracy, macro averages over all k classes, weighted F1."""
    return summary_of(class_metrics(rows, k), k)


def summary_of(each: DataFrame, k: int) -> DataFrame:
    n = F.sum("support")
    return each.agg(
        (F.sum("hits") / n).alias("accuracy"), *((F.sum(m) / k).alias(f"macro_{m}") for m in ("precision", "recall", "f1")), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), n.alias("n"),
    )


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins (lo, hi] of the confidence, the first with 0 too, edges in FLOAT, empty bins kept."""
    dim = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).cast("float").alias("lo"), ((F.col("id") + 1) / bins).cast("float").alias("hi"))
    c = F.col("confidence").cast("float")
    edges = [(i / bins, (i + 1) / bins) for i in range(bins)]
    at = F.lit(None).cast("int")
    for i, (_, hi) in reversed(list(enumerate(edges))):
        at = F.when(c <= F.lit(hi).cast("float"), i).otherwise(at)
    placed = rows.select(at.alias("bin"), "confidence", (F.col("target") == F.col("predicted")).cast("int").alias("hit"))
    own = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    return dim.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error, and mean confidence of all, right and wrong rows (null if none)."""
    ece = calibration_bins(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))
    hit = F.col("target") == F.col("predicted")
    means = rows.agg(F.avg("confidence").alias("mean_all"), F.avg(F.when(hit, F.col("confidence"))).alias("mean_right"), F.avg(F.when(~hit, F.col("confidence"))).alias("mean_wrong"))
    return ece.join(means)


def cross_entropy(rows: DataFrame) -> DataFrame:
    """One row: mean negative log probability of the target (rows with `probs`) and accuracy."""
    return rows.agg(F.avg(-F.ln(F.get("probs", F.col("target")))).alias("loss"), F.avg((F.col("target") == F.col("predicted")).cast("double")).alias("accuracy"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """(id, rank, c, p): the k most probable classes of each row, ties to the lower class, k held to 1..classes."""
    order = F.array_sort("probs_at", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(a["c"] - b["c"]))
    own = rows.withColumn("probs_at", F.transform("probs", lambda p, i: F.struct(p.alias("p"), i.alias("c"))))
    top = F.slice(order, 1, F.greatest(F.lit(1), F.least(F.lit(k), F.size("probs"))))
    return own.select("id", F.posexplode(top).alias("pos", "at")).select("id", (F.col("pos") + 1).alias("rank"), F.col("at.c").alias("c"), F.col("at.p").alias("p"))
