"""Isolation of a fold's training rows, its validation rows and the final test: fifteen rules and the numbers checked.

Every key of the three tables goes with bits for the roles that it has into one grouping; what two tables share, and what a row
breaks on its own, is read from the combined bits. One shuffle serves all rules, counts are combined before it, and no table is
joined with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The arms with the names of their training manifests, the validation manifests' name, the held-out manifest, the folder of generated rows.
ARMS = {"without_gan": "fold_{:02d}_train.csv", "with_gan": "fold_{:02d}_train_gan.csv"}
VALIDATION = "fold_{:02d}_validation.csv"
FINAL_TEST = "final_test"
GENERATED = "gan"

TRAIN, VALID, TEST, MADE = 1, 2, 4, 8  # roles of a key; MADE: a synthetic training row has it

#: Rules about a row, by bit, then rules about keys that two tables share: (kind, bits that must not meet, at least one of).
ROW_RULES = ("train_rows_of_the_fold", "validation_rows_of_other_folds", "synthetic_in_arm_without", "synthetic_outside_its_folder", "validation_rows_synthetic", "real_rows_in_generated_folder")
KEY_RULES = {
    "ids_in_train_and_validation": ("id", TRAIN, VALID), "ids_in_train_and_test": ("id", TRAIN, TEST), "ids_in_validation_and_test": ("id", VALID, TEST),
    "synthetic_ids_held_out": ("id", MADE, VALID | TEST), "groups_in_train_and_validation": ("group", TRAIN, VALID),
}
COUNTS = ("train_rows", "train_real", "train_synthetic", "validation_rows", "final_test_ids")


def manifest_rules(fold: int, arm: str, train_path: str, validation_path: str) -> dict[str, bool]:
    """The rules about the manifests' names and places; True where one is broken."""
    train, validation = (p.rstrip("/").split("/")[-1] for p in (train_path, validation_path))
    return {
        "train_manifest_name": train != ARMS[arm].format(fold),
        "final_test_as_manifest": FINAL_TEST in train or FINAL_TEST in validation,
        "validation_manifest_name": validation != VALIDATION.format(fold),
        "train_manifest_outside_fold": arm == "with_gan" and f"fold_{fold:02d}" not in train_path.split("/"),
    }


def _flags(*broken: Column) -> Column:
    return reduce(Column.bitwiseOR, (F.when(b, 1 << k).otherwise(0) for k, b in enumerate(broken)))


def keys(train: DataFrame, validation: DataFrame, test: DataFrame, *, fold: int, arm: str) -> DataFrame:
    """(kind, key, roles, broken, counted): a row for each key of each row; `broken` and `counted` stand with the id's row only."""
    parts = F.split("path", "/")
    within = lambda name: F.coalesce(F.array_contains(parts, name), F.lit(False))
    made, never = F.coalesce("synthetic", F.lit(False)), F.lit(False)
    right_place = within(GENERATED) & within(f"fold_{fold:02d}") & within("train")
    own = _flags(~made & F.col("fold").eqNullSafe(fold), never, made & F.lit(arm == "without_gan"), made & ~right_place, never, ~made & within(GENERATED))
    held = _flags(never, ~F.col("fold").eqNullSafe(fold), never, never, made | within(GENERATED), never)
    row = lambda kind, key, roles, broken, counted: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), roles.alias("roles"), broken.alias("broken"), counted.alias("counted"))
    nothing = F.lit(0)
    trained = F.array(row("id", "id", F.when(made, TRAIN | MADE).otherwise(TRAIN), own, F.when(made, 1 | 4).otherwise(1 | 2)), row("group", "group", F.when(made, 0).otherwise(TRAIN), nothing, nothing))
    validated = F.array(row("id", "id", F.lit(VALID), held, F.lit(8)), row("group", "group", F.lit(VALID), nothing, nothing))
    tested = F.array(row("id", "id", F.lit(TEST), nothing, F.lit(0)))
    return train.select(F.inline(trained)).unionAll(validation.select(F.inline(validated))).unionAll(test.select(F.inline(tested)))


def facts(train: DataFrame, validation: DataFrame, test: DataFrame, *, fold: int, arm: str) -> DataFrame:
    """One row: the number of violations and a specimen of each rule about rows and keys, and the counts. Train and validation have (id, group, fold, path, synthetic), test has (id)."""
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(1)
    each = keys(train, validation, test, fold=fold, arm=arm).groupBy("kind", "key").agg(
        F.bit_or("roles").alias("roles"), *(F.sum(bit("broken", k)).alias(n) for k, n in enumerate(ROW_RULES)), *(F.sum(bit("counted", k)).alias(n) for k, n in enumerate(COUNTS[:-1])),
    )
    shared = {n: (F.col("kind") == kind) & F.col("key").isNotNull() & (F.col("roles").bitwiseAND(one) != 0) & (F.col("roles").bitwiseAND(other) != 0) for n, (kind, one, other) in KEY_RULES.items()}
    tested = (F.col("kind") == "id") & F.col("key").isNotNull() & (F.col("roles").bitwiseAND(TEST) != 0)
    rule = lambda count, found: F.struct(F.coalesce(count, F.lit(0)).cast("long").alias("violations"), F.min(F.when(found, F.col("key"))).alias("specimen"))
    return each.agg(
        *(rule(F.sum(n), F.col(n) > 0).alias(n) for n in ROW_RULES), *(rule(F.count_if(c), c).alias(n) for n, c in shared.items()),
        *(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in COUNTS[:-1]), F.count_if(tested).alias(COUNTS[-1]),
    )


def isolation_suite(train: DataFrame, validation: DataFrame, test: DataFrame, *, fold: int, arm: str, train_path: str, validation_path: str) -> DataFrame:
    """(rule, violations, specimen): fifteen rows, in the order in which the rules are enforced.

    Shared keys are counted once each, broken rows one by one; the specimen is the least key concerned, a null one aside. A null id or
    group is shared with nothing, a null fold is no fold, a null `synthetic` is false. Repeated rows are rows of their own.
    """
    names = manifest_rules(fold, arm, train_path, validation_path)
    told = {n: F.struct(F.lit(int(b)).cast("long").alias("violations"), F.lit(p if b else None).cast("string").alias("specimen")) for (n, b), p in zip(names.items(), (train_path, f"{train_path} {validation_path}", validation_path, train_path), strict=True)}
    order = [*told, *list(KEY_RULES)[:3], *ROW_RULES[:4], "synthetic_ids_held_out", *ROW_RULES[4:], "groups_in_train_and_validation"]
    one = facts(train, validation, test, fold=fold, arm=arm)
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), told.get(n, F.col(n)).alias("found")) for n in order))
    return one.select(F.inline(rows)).select("rule", "found.violations", "found.specimen")


def isolation_counts(train: DataFrame, validation: DataFrame, test: DataFrame, *, fold: int, arm: str) -> DataFrame:
    """(measure, value): the numbers that a passed check reports."""
    one = facts(train, validation, test, fold=fold, arm=arm)
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in COUNTS))))
