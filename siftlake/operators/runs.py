"""Training histories and experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as e


def running_best(history: DataFrame, by: str, order: str, metric: str) -> DataFrame:
    """Rows with the best metric before them, whether they improve on it, and the best so far."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if "loss" in metric else F.max)(metric).over(before)
    rows = history.withColumn("best_before", best)
    improved = e.is_improvement(metric, F.col(metric), F.col("best_before"))
    return rows.select(by, order, metric, improved.alias("improved"), (F.least if "loss" in metric else F.greatest)(metric, "best_before").alias("best"))


def early_stop(history: DataFrame, by: str, order: str, metric: str, patience: int) -> DataFrame:
    """(by, stop_at, best): the first step with `patience` steps in a row without improvement before it ends, null if none."""
    w = Window.partitionBy(by).orderBy(order)
    rows = running_best(history, by, order, metric).withColumn("step", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("waited", F.col("step") - last)
    return rows.groupBy(by).agg(F.min(F.when(F.col("waited") >= patience, F.col("step"))).alias("stop_at"), F.max("best").alias("best"))


def global_epochs(history: DataFrame, by: str, stage: str, order: str) -> DataFrame:
    """Rows with their running number over stages, and whether a stage begins."""
    w = Window.partitionBy(by).orderBy(order)
    return history.select(by, order, stage, F.row_number().over(w).alias("global_epoch"), F.coalesce(F.lag(stage).over(w) != F.col(stage), F.lit(False)).alias("boundary"))


def best_runs(history: DataFrame, by: str, order: str, metric: str) -> DataFrame:
    """Best and last step of each run; the first of equal bests."""
    return history.groupBy(by).agg(F.max_by(order, F.struct(F.col(metric), -F.col(order))).alias("best_step"), F.max(metric).alias("best"), F.max_by(metric, order).alias("last"), F.count("*").alias("steps"))


def baseline_delta(runs: DataFrame, by: str, baseline: object) -> DataFrame:
    """Each run's best, rounded half-even to 4 places, less the baseline run's."""
    base = runs.filter(F.col(by) == F.lit(baseline)).select(F.bround("best", 4).alias("base"))
    return runs.join(F.broadcast(base)).select(by, F.bround("best", 4).alias("best"), F.bround(F.bround("best", 4) - F.col("base"), 4).alias("delta"))


def experiment_matrix(models: DataFrame, folds: int, arms: list[str]) -> DataFrame:
    """Every model with every fold and arm, with its id (J07); models is a small table."""
    rows = models.select("model", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).select("*", F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    return rows.withColumn("experiment_id", e.experiment_id(F.col("model"), F.col("fold"), F.col("arm")))


def with_status(matrix: DataFrame, runs: DataFrame) -> DataFrame:
    """Statuses from runs (experiment_id, status, artifacts): COMPLETED counts only with all artifacts, no run is PENDING."""
    status = F.when(F.col("status").isNull(), "PENDING").when((F.col("status") == "COMPLETED") & ~F.coalesce("artifacts", F.lit(False)), "FAILED").otherwise(F.col("status"))
    return matrix.join(runs, "experiment_id", "left").withColumn("status", status).drop("artifacts")


def zero_filled(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Counts of every declared key."""
    return dim.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def synthetic_plan(rows: DataFrame, label: str, *, ratio: float = 0.5, target: int = 0) -> DataFrame:
    """How many rows to add to each label: up to the target (0: the largest label), `ratio` of its own at most."""
    counts = rows.groupBy(label).agg(F.count("*").alias("real"))
    goal = F.lit(target) if target else F.max("real").over(Window.partitionBy())
    return counts.select(label, "real", F.least(F.greatest(goal - F.col("real"), F.lit(0)), F.floor(F.col("real") * ratio)).cast("long").alias("synthetic"))


def augmented(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic rows in one table; synthetic ones have fold -1 and their own group."""
    added = synthetic.select("id", "label", F.lit(-1).alias("fold"), F.lit("gan").alias("source"), F.col("id").cast("string").alias("group"), F.lit(True).alias("synthetic"))
    return real.select("id", "label", "fold", "source", "group", F.lit(False).alias("synthetic")).unionByName(added)


def session_stats(events: DataFrame) -> DataFrame:
    """Count, mean, and events of one kind of each session."""
    return events.groupBy("session").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_if(F.col("kind") == "error").alias("errors"))


def recent(events: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The last n events, newest first (W13): a top-n report."""
    return events.orderBy(F.desc(order), F.desc("id")).limit(n)
