"""Inventory, leakage and shortcut audits of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inventory(rows: DataFrame, by: list[str], *, size: Column, tag: str) -> DataFrame:
    """Counts, total size and a sorted `tag=n` histogram string of each group."""
    tags = rows.groupBy(*by, tag).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    return tags.groupBy(*by).agg(F.sum("n").alias("records"), F.sum("size").alias("total_size"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(tag), F.col("n").cast("string")))), "; ").alias("histogram"))


def token_leakage(rows: DataFrame, by: str, tokens: Column) -> DataFrame:
    """Rows whose name holds a label token, of each group."""
    hit = F.size(tokens) > 0
    return rows.groupBy(by).agg(F.count("*").alias("records"), F.count_if(hit).alias("with_token"), F.round(100.0 * F.count_if(hit) / F.count("*"), 1).alias("percent"))


def target_leakage(rows: DataFrame, by: str, tokens: Column, label: str, path: str, k: int = 3) -> DataFrame:
    """(by, records, with_token, percent, label_in_path, examples): as `token_leakage`, whether every row's path holds its label, and the first k paths with a token, by path."""
    own = rows.select(by, F.col(path).alias("path"), (F.size(tokens) > 0).alias("hit"), F.contains(F.col(path), F.col(label)).alias("told"))
    hit = F.col("hit")
    each = own.groupBy(by).agg(F.count("*").alias("records"), F.count_if(hit).alias("with_token"), F.round(100.0 * F.count_if(hit) / F.count("*"), 1).cast("double").alias("percent"), F.bool_and(F.coalesce("told", F.lit(False))).alias("label_in_path"))
    first = own.filter(hit).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("path"))).filter(F.col("k") <= k)  # k rows a group leave each task
    shown = first.groupBy(F.col(by).alias("of")).agg(F.array_join(F.array_sort(F.collect_list("path")), "; ").alias("examples"))
    return each.join(shown, each[by].eqNullSafe(shown["of"]), "left").drop("of").withColumn("examples", F.coalesce("examples", F.lit("")))


def group_summary(rows: DataFrame, group: str, dataset: str, label: str) -> DataFrame:
    """One row: groups, those of several rows, those that span datasets, the largest, and those of mixed labels."""
    each = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(dataset).alias("datasets"), F.count_distinct(label).alias("labels"))
    return each.agg(
        F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("datasets") > 1).alias("spanning"),
        F.max("n").alias("largest"), F.count_if(F.col("labels") > 1).alias("mixed"), F.count_if((F.col("datasets") == 1) & (F.col("n") > 1)).alias("within_one"),
    )


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """(members, groups): how many groups have how many rows."""
    return rows.groupBy(group).agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))


def shortcut_bound(rows: DataFrame, feature: Column, label: str) -> DataFrame:
    """One row: how often the best guess from a feature alone is right, against the majority label."""
    by = rows.groupBy(feature.alias("feature"), label).agg(F.count("*").alias("n"))
    best = by.groupBy("feature").agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg(F.sum("best").alias("best"), F.sum("n").alias("n"))
    majority = by.groupBy(label).agg(F.sum("n").alias("m")).agg(F.max("m").alias("m"))
    return best.join(majority).select((F.col("best") / F.col("n")).alias("bound"), (F.col("m") / F.col("n")).alias("baseline"), "n")


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of a declared list of column values, zeros filled."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def single_source(rows: DataFrame, label: str, source: str) -> DataFrame:
    """Labels that only one source has."""
    return rows.groupBy(label).agg(F.count_distinct(source).alias("sources"), F.min(source).alias("source"), F.count("*").alias("n")).filter("sources = 1").drop("sources")


def most_common(rows: DataFrame, by: str, value: Column, k: int, order: str) -> DataFrame:
    """The k most frequent values of each group; ties to the one seen first."""
    counts = rows.groupBy(by, value.alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "seen"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select(by, "value", "n", "rank")


def leakage_flags(rows: DataFrame, group: str = "near") -> DataFrame:
    """(id, flags): what ties a row to others of its group, `;`-joined in a fixed order."""
    per_sha = rows.groupBy("sha").agg(F.count("*").alias("same"))
    per_group = rows.groupBy(group).agg(F.count_distinct("sha").alias("contents"), F.count_distinct("source").alias("sources"))
    full = rows.join(per_sha, "sha").join(per_group, group)
    return full.select("id", F.concat_ws(";", F.when(F.col("same") > 1, "exact_duplicate"), F.when(F.col("contents") > 1, "near_duplicate"), F.when(F.col("sources") > 1, "cross_dataset")).alias("flags"))


def record_flags(rows: DataFrame, label_words: list[str], augmented_words: list[str] | tuple[str, ...] = ("aug", "flip", "rot")) -> DataFrame:
    """(id, flags): all that a split must respect about a row (id, sha, near, source, specimen, name), `;`-joined in a fixed order.

    Its content stands twice; its group has other contents; its group spans sources; it names a specimen; its file name holds a label's
    word; its file name tells of augmentation. Words are sought in the lower-cased name with `_` and `-` as spaces. A null name holds none.
    """
    per_sha = rows.groupBy("sha").agg(F.count("*").alias("same"))
    per_group = rows.groupBy("near").agg((F.min("sha") < F.max("sha")).alias("contents"), (F.min("source") < F.max("source")).alias("sources"))
    name = F.translate(F.lower("name"), "_-", "  ")
    holds = lambda words: reduce(Column.__or__, (F.contains(name, F.lit(w)) for w in words))
    flags = {
        "exact_duplicate_group": F.col("same") > 1, "near_duplicate_group": F.col("contents"), "cross_dataset_group": F.col("sources"), "specimen_group": F.coalesce("specimen", F.lit("")) != "",
        "filename_reveals_label": holds(label_words), "pre_augmented_filename": holds(augmented_words),
    }
    full = rows.join(per_sha, "sha", "left").join(per_group, "near", "left")
    return full.select("id", F.concat_ws(";", *(F.when(c, n) for n, c in flags.items())).alias("flags"))
