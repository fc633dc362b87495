"""The fifteen isolation rules, each broken alone."""

import pytest

from siftlake.operators import guards, isolation

ROWS = "id string, group string, fold int, path string, synthetic boolean"
TRAIN = [("a", "g1", 1, "data/x/a.png", False), ("b", "g2", 3, "data/x/b.png", False), ("s", "g9", -1, "data/gan/fold_02/train/s.png", True), ("b", "g2", 3, "data/x/b.png", None)]
VALID = [("v", "g3", 2, "data/x/v.png", False), ("w", "g3", 2, "data/x/w.png", False)]
TEST = [("t",), ("t",), (None,)]
PATHS = {"train_path": "m/fold_02/fold_02_train_gan.csv", "validation_path": "m/fold_02_validation.csv"}


def suite(spark, train=TRAIN, valid=VALID, test=TEST, fold=2, arm="with_gan", **paths):
    tables = spark.createDataFrame(train, ROWS), spark.createDataFrame(valid, ROWS), spark.createDataFrame(test, "id string")
    return isolation.isolation_suite(*tables, fold=fold, arm=arm, **(PATHS | paths))


def test_clean_folds_pass(spark):
    found = guards.enforce(suite(spark))
    assert len(found) == 15 and not any(found.values())
    tables = spark.createDataFrame(TRAIN, ROWS), spark.createDataFrame(VALID, ROWS), spark.createDataFrame(TEST, "id string")
    counts = {r["measure"]: r["value"] for r in isolation.isolation_counts(*tables, fold=2, arm="with_gan").collect()}
    assert counts == {"train_rows": 4, "train_real": 3, "train_synthetic": 1, "validation_rows": 2, "final_test_ids": 1}


@pytest.mark.parametrize(("change", "want"), [
    ({"train_path": "m/fold_02/fold_03_train_gan.csv"}, {"train_manifest_name": 1}),
    ({"validation_path": "m/final_test.csv"}, {"final_test_as_manifest": 1, "validation_manifest_name": 1}),
    ({"validation_path": "m/fold_01_validation.csv"}, {"validation_manifest_name": 1}),
    ({"train_path": "m/fold_02_train_gan.csv"}, {"train_manifest_outside_fold": 1}),
    ({"valid": [*VALID, ("a", "g7", 2, "p", False)]}, {"ids_in_train_and_validation": 1}),
    ({"test": [*TEST, ("b",)]}, {"ids_in_train_and_test": 1}),
    ({"test": [("v",), ("w",)]}, {"ids_in_validation_and_test": 2}),
    ({"train": [*TRAIN, ("c", "g4", 2, "p", False), ("d", "g4", 2, "p", False)]}, {"train_rows_of_the_fold": 2}),
    ({"valid": [*VALID, ("x", "g5", 4, "p", False), ("y", "g5", None, None, None)]}, {"validation_rows_of_other_folds": 2}),
    ({"arm": "without_gan", "train_path": "fold_02_train.csv"}, {"synthetic_in_arm_without": 1}),
    ({"train": [*TRAIN, ("q", "g8", -1, "data/gan/fold_03/train/q.png", True), ("r", None, -1, None, True)]}, {"synthetic_outside_its_folder": 2}),
    ({"test": [*TEST, ("s",)]}, {"synthetic_ids_held_out": 1, "ids_in_train_and_test": 1}),
    ({"valid": [*VALID, ("x", "g5", 2, "data/gan/x", False), ("y", "g5", 2, "p", True)]}, {"validation_rows_synthetic": 2}),
    ({"train": [*TRAIN, ("c", "g4", 1, "data/gan/c", False)]}, {"real_rows_in_generated_folder": 1}),
    ({"valid": [*VALID, ("x", "g1", 2, "p", False), ("y", "g9", 2, "p", False), ("z", None, 2, "p", False)]}, {"groups_in_train_and_validation": 1}),
])
def test_each_rule_is_found_alone(spark, change, want):
    rows = suite(spark, **change).collect()
    assert {r["rule"]: r["violations"] for r in rows if r["violations"]} == want
    assert all((r["specimen"] is not None) == (r["violations"] > 0) for r in rows)


def test_null_ids_and_empty_tables(spark):
    found = {r["rule"]: r["violations"] for r in suite(spark, train=[(None, None, 2, None, None)], valid=[(None, None, 2, None, None)]).collect()}
    assert {n for n, v in found.items() if v} == {"train_rows_of_the_fold"}
    assert guards.enforce(suite(spark, train=[], valid=[], test=[]))["ids_in_train_and_test"] == 0
    with pytest.raises(guards.Violation, match="ids_in_train_and_test"):
        guards.enforce(suite(spark, test=[("a",)]))
