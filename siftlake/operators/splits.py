"""Group-aware stratified splits and folds."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import ranked_keys


def strata(rows: DataFrame) -> DataFrame:
    """(group, stratum): `label|majority source` of each group, ties to the smaller source."""
    counts = rows.groupBy("group", "source").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    top = counts.groupBy("group").agg(F.max(F.col("n")).alias("n"), F.min("label").alias("label"))
    source = counts.join(top.select("group", "n"), ["group", "n"]).groupBy("group").agg(F.min("source").alias("source"))
    return source.join(top, "group").select("group", F.concat_ws("|", F.coalesce("label", F.lit("")), F.col("source")).alias("stratum"))


def largest_remainder(counts: DataFrame, key: str, ratios: list[float]) -> DataFrame:
    """(key, part, quota): whole quotas that sum to n, spare ones to the largest remainders, ties to the lower part."""
    parts = counts.select(key, "n", F.posexplode(F.array(*map(F.lit, ratios))).alias("part", "ratio"))
    exact = F.col("n") * F.col("ratio")
    parts = parts.withColumn("base", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    spare = F.col("n") - F.sum("base").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rest"), "part"))
    return parts.select(key, "part", (F.col("base") + F.when(rank <= spare, 1).otherwise(0)).cast("long").alias("quota"))


def hash_order(seed: int, key: Column) -> Column:
    """A reproducible order that doesn't depend on partitions."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows that come first in hash order."""
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def hash_split(rows: DataFrame, key: str, by: str, ratios: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:
    """train, val and test of each class by half-even rounded quotas in hash order, the rest to test."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, F.col(key)), key))
    n = F.count("*").over(Window.partitionBy(by))
    train, val = F.bround(n * ratios[0]), F.bround(n * ratios[1])
    return rows.select(key, by, F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test").alias("split"))


def level_counts(quota: list[int], filled: list[int], size: int, n: int) -> list[int]:
    """How many of `n` groups of one size each part gets, when each group goes to the part with the largest share of its quota open, ties to the lower part.

    A part's open share falls by the same step with each group, so the picks are the n largest values of a few arithmetic sequences:
    all but the last ones follow from a common level, the last ones are picked one by one in exact fractions.
    """
    step = [Fraction(size, max(q, 1)) for q in quota]
    top = [Fraction(q - f, max(q, 1)) for q, f in zip(quota, filled, strict=True)]
    above = lambda level: [max(0, math.ceil((t - level) / d)) for t, d in zip(top, step, strict=True)]  # noqa: E731  # picks of more than a level
    low, high = min(top) - n * max(step) - 1, max(top)
    for _ in range(60):
        mid = (low + high) / 2
        mid = Fraction(math.floor(mid * (1 << 40)), 1 << 40)
        low, high = (mid, high) if sum(above(mid)) > n else (low, mid)
    got = above(high)
    while sum(got) < n:
        best = max(range(len(quota)), key=lambda k: (top[k] - got[k] * step[k], -k))
        got[best] += 1
    return got


def assigned_groups(rows: DataFrame, ratios: list[float], seed: int = 42) -> DataFrame:
    """(group, part): whole groups to parts, stratum by stratum, largest groups first, each to the part with the largest share of its quota open.

    Rows (group, source, label). Of the groups of one size in a stratum only how many a part gets matters, so a stratum is worked off
    by sizes, of which it has at most about the square root of twice its rows: a task holds these, never groups. The groups of a size, in
    hash order, are then dealt to the parts in blocks of these numbers, by ranks from a range partitioning. A null group isn't assigned.
    """
    if abs(sum(ratios) - 1) > 1e-9 or min(ratios) < 0:
        raise ValueError("ratios must be non-negative and sum to 1")
    known = rows.filter("`group` is not null")
    sized = known.groupBy("group").agg(F.count("*").alias("n")).join(strata(known), "group").select("stratum", "n", hash_order(seed, F.col("group")).alias("turn"), "group")
    levels = sized.groupBy("stratum", "n").agg(F.count("*").alias("groups"))
    quotas = largest_remainder(levels.groupBy("stratum").agg(F.sum(F.col("n") * F.col("groups")).alias("n")), "stratum", ratios).groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("part", "quota"))).alias("quotas"))

    def work_off(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("n", ascending=False)
        quota = [int(q["quota"]) for q in own["quotas"].iloc[0]]
        filled, ends = [0] * len(quota), []
        for n, groups in zip(own["n"].tolist(), own["groups"].tolist(), strict=True):
            got = level_counts(quota, filled, n, groups)
            filled = [f + n * g for f, g in zip(filled, got, strict=True)]
            ends.append(list(accumulate(got)))
        return pd.DataFrame({"stratum": own["stratum"], "n": own["n"], "ends": ends})

    dealt = levels.join(quotas, "stratum").groupBy("stratum").applyInPandas(work_off, "stratum string, n long, ends array<long>")
    ranked = _ranked(sized)
    first = ranked.groupBy("stratum", "n").agg(F.min("rank").alias("first"))
    part = F.size(F.filter("ends", lambda e: e <= F.col("rank") - F.col("first")))
    return ranked.join(first.join(dealt, ["stratum", "n"]), ["stratum", "n"]).select("group", part.alias("part"))


def _ranked(sized: DataFrame) -> DataFrame:
    """`sized` with the rank of each group over all of them, by stratum, size and turn."""
    out = ranked_keys(sized.select(F.struct("stratum", "n", "turn", F.col("group").alias("id")).alias("key")), "key", "")
    return out.select("key.stratum", "key.n", F.col("key.id").alias("group"), out["group"].cast("long").alias("rank"))


def one_stratum_each(rows: DataFrame) -> DataFrame:
    """(rule, violations): groups that rows (group, stratum) put into two strata; such groups can't be dealt."""
    return straddling(rows, "stratum").agg(F.lit("groups_in_two_strata").alias("rule"), F.count("*").alias("violations"))


def fold_report(folds: DataFrame) -> DataFrame:
    """For each fold of rows (fold, label, group): its size, the rest, and a sorted `label=n; ...` string."""
    counts = folds.groupBy("fold", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("validation").over(Window.partitionBy())
    own = counts.groupBy("fold").agg(F.sum("n").alias("validation"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("n").cast("string")))), "; ").alias("labels"))
    return own.select("fold", "validation", (total - F.col("validation")).alias("train"), "labels")


def straddling(rows: DataFrame, part: str = "part") -> DataFrame:
    """Groups that lie in more than one part: none in a valid split."""
    return rows.groupBy("group").agg(F.count_distinct(part).alias("parts")).filter("parts > 1")


def with_split(rows: DataFrame, assigned: DataFrame, key: str = "id") -> DataFrame:
    """All rows with the split that they were assigned, '' where none was."""
    return rows.join(assigned.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("")))


def split_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(measure, value, split, rows, groups): rows and groups of each split in all and by each column of `by` (A10). Rows (group, split, ...)."""
    sets = [("all", F.lit("")), *((c, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in by)]
    each = rows.select("group", "split", F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in sets))).alias("m"))
    return each.groupBy("m.measure", "m.value", "split").agg(F.count("*").alias("rows"), F.count_distinct("group").alias("groups"))


def split_measures(rows: DataFrame, test: str = "final_test") -> DataFrame:
    """(measure, part, value) of a split (label, group, split, specimen) beside its counts: the test part's share of all and of each label, groups that straddle, the test part's largest group and its groups with a specimen (A10). Rows without a split are left out."""
    own = rows.filter("split is not null and split <> ''").withColumn("held", F.col("split") == test)
    share = lambda n: F.round(F.count_if("held") / F.count("*"), n)
    labels = own.groupBy(F.coalesce("label", F.lit("")).alias("part")).agg(share(3).alias("value")).select(F.lit("share_of_label").alias("measure"), "part", "value")
    whole = own.agg(F.lit("share").alias("measure"), F.lit("").alias("part"), share(4).alias("value"))
    groups = own.filter("`group` is not null").groupBy("group").agg(F.count_if("held").alias("held"), F.count("*").alias("n"), F.max(F.col("held") & (F.coalesce("specimen", F.lit("")) != "")).alias("specimen"))
    one = groups.agg(F.count_if((F.col("held") > 0) & (F.col("held") < F.col("n"))).alias("groups_straddling"), F.coalesce(F.max("held"), F.lit(0)).alias("largest_group_in_test"), F.count_if("specimen").alias("specimen_groups_in_test"))
    told = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.lit("").alias("part"), F.col(c).cast("double").alias("value")) for c in one.columns))))
    return labels.unionAll(whole.filter("value is not null")).unionAll(told)


def manifest_rules(rows: DataFrame, splits: list[str], labels: DataFrame) -> DataFrame:
    """(rule, violations) of a split manifest (id, label, split): not empty, splits known, labels declared, ids unique, every label in every split."""
    whole = rows.agg((F.count("*") == 0).cast("long").alias("empty"), F.count_if(~F.coalesce(F.col("split").isin(splits), F.lit(False))).alias("unknown_split"))
    one = whole.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in ("empty", "unknown_split")))))
    named = labels.select(F.col(labels.columns[0]).alias("label")).distinct()
    unknown = rows.join(named, "label", "left_anti").agg(F.lit("unknown_label").alias("rule"), F.count("*").alias("violations"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.lit("id_twice").alias("rule"), F.count_if(F.col("n") > 1).alias("violations"))
    wanted = named.select("label", F.explode(F.array(*map(F.lit, splits))).alias("split"))
    gaps = wanted.join(rows.select("label", "split").distinct(), ["label", "split"], "left_anti").agg(F.lit("label_missing_in_split").alias("rule"), F.count("*").alias("violations"))
    return one.unionAll(unknown).unionAll(twice).unionAll(gaps)
