"""Each rule of the frozen tables' suites, broken alone and beside defined nulls."""

import pytest

from siftlake.operators import guards, suites

NAMES = ["a", "b"]
CLEAN = "id long, sha string, label string, `group` string, included boolean, reason string, representative long"
GOOD = [(1, "x", "a", "g", True, "", None), (2, "x", "a", "g", False, "EXACT", 1), (3, "y", "b", "h", True, None, None), (4, None, None, None, False, "CORRUPT", None)]


def broken(found):
    return {r["rule"]: r["violations"] for r in found.collect() if r["violations"]}


@pytest.mark.parametrize(("rows", "want"), [
    ([], {}),
    ([(5, "z", "a", "k", True, "EXACT", None)], {"included_with_reason": 1}),
    ([(5, "x", "a", "g", False, None, None), (6, "x", "a", "g", None, "", None)], {"excluded_without_reason": 2}),
    ([(5, "x", "a", "g", False, "ODD", None)], {"unknown_reason": 1}),
    ([(5, "z", "", "k", True, "", None), (6, "w", None, "l", True, "", None)], {"included_without_label": 2}),
    ([(1, "z", "a", "g", True, "", None)], {"id_twice": 1}),
    ([(5, "x", "a", "g", True, "", None)], {"included_content_twice": 1}),
    ([(5, "x", "a", "g", False, "EXACT", 5), (6, "x", "a", "g", False, "EXACT", 99)], {"representative_of_itself": 1, "representative_unknown": 1}),
    ([(5, "z", "b", "g", True, "", None), (6, None, "b", None, True, "", None), (7, None, "a", None, True, "", None)], {"groups_of_several_labels": 1}),
])
def test_clean(spark, rows, want):
    assert broken(suites.clean_rules(spark.createDataFrame(GOOD + rows, CLEAN), ["EXACT", "CORRUPT"])) == want


SPLIT = "id long, class string, label int, `group` string, split string"
PARTED = [(1, "a", 0, "g", "development"), (2, "a", 0, "h", "final_test"), (3, "b", 1, "k", "development"), (4, "b", 1, "l", "final_test")]


@pytest.mark.parametrize(("split", "clean", "want"), [
    (PARTED, [(9, False)], {}),
    ([*PARTED, (1, "a", 0, "g", "development")], [], {"id_twice": 1}),
    ([*PARTED, (5, "a", 0, "m", "train"), (6, "a", 0, "n", None)], [(5, True), (6, True)], {"unknown_part": 2}),
    ([*PARTED[:3], (4, "b", 0, "l", "final_test")], [], {"label_isnt_class": 1}),
    (PARTED[:1] + PARTED[2:3], [(2, False), (4, False)], {"empty_parts": 1, "classes_of_one_part": 2}),
    ([*PARTED, (5, "a", 0, "g", "final_test")], [(5, True)], {"groups_in_both_parts": 1}),
    (PARTED, [(7, True)], {"included_rows_left_out": 1}),
    ([*PARTED, (5, "a", 0, "m", "final_test"), (6, "a", 0, "n", "final_test")], [(5, False)], {"rows_not_included": 2, "excluded_rows": 1}),
])
def test_split(spark, split, clean, want):
    known = [(i, True) for i in range(1, 5) if i not in {c[0] for c in clean}]
    assert broken(suites.split_rules(spark.createDataFrame(split, SPLIT), spark.createDataFrame(known + clean, "id long, included boolean"), NAMES)) == want


FOLDS = "id long, class string, label int, `group` string, fold int"
FOLDED = [(1, "a", 0, "g", 1), (2, "b", 1, "h", 2), (3, "a", 0, "g", 1), (4, "b", 1, None, 10), (5, "b", 1, None, 2)]


@pytest.mark.parametrize(("rows", "folds", "want"), [
    (FOLDED, 10, {"empty_folds": 7}),
    ([*FOLDED, (1, "a", 0, "g", 1), (6, "a", 1, "k", 0), (7, "a", 0, "k", None)], 10, {"id_twice": 1, "label_isnt_class": 1, "fold_out_of_range": 2, "empty_folds": 7}),
    ([*FOLDED, (6, "a", 0, "g", 10)], 10, {"groups_in_several_folds": 1, "empty_folds": 7}),
])
def test_folds(spark, rows, folds, want):
    assert broken(suites.fold_rules(spark.createDataFrame(rows, FOLDS), folds, NAMES)) == want


MATRIX = "experiment_id string, model string, fold int, arm string, train_manifest string, validation_manifest string, status string"


def matrix():
    return [(f"{m}{f}{a}", m, f, a, f"d/fold_{f:02d}_train{'_gan' if a == 'with_gan' else ''}.csv", f"d/fold_{f:02d}_validation.csv", "PENDING") for m in "mn" for f in (1, 2) for a in ("without_gan", "with_gan")]


@pytest.mark.parametrize(("change", "want"), [
    (lambda r: r, {}),
    (lambda r: r[1:], {"combination_missing": 1, "uneven_axis_values": 3}),
    (lambda r: [*r, ("new", *r[0][1:])], {"combination_twice": 1, "uneven_axis_values": 3}),
    (lambda r: [*r[:-1], (r[0][0], *r[-1][1:])], {"id_twice": 1}),
    (lambda r: [*r, ("o", "other", 1, "with_gan", "fold_01_train_gan.csv", "fold_01_validation.csv", "PENDING")], {"off_the_axes": 1}),
    (lambda r: [*r[:-1], (*r[-1][:4], "fold_02_train.csv", "x/final_test.csv", "DONE")], {"train_manifest_name": 1, "validation_manifest_name": 1, "final_test_as_manifest": 1, "unknown_status": 1}),
])
def test_matrix(spark, change, want):
    assert broken(suites.matrix_rules(spark.createDataFrame(change(matrix()), MATRIX), ["m", "n"], 2)) == want


def test_synthetic(spark):
    rows = [("s1", 2, "a", 0, "gan/fold_02/train/a/1.png"), ("s2", 3, "a", 0, "gan/fold_02/train/a/2.png"), ("s3", 2, "c", 2, "gan/fold_02/val/3.png"), ("s4", 2, "b", 0, "gan/train/4.png"), ("s5", None, None, None, None)]
    frame = spark.createDataFrame(rows, "id string, fold int, class string, label int, path string")
    listing = spark.createDataFrame([(r[4],) for r in rows[:3]], "path string")
    assert broken(suites.synthetic_rules(frame, listing, 2, NAMES)) == {"of_another_fold": 2, "unknown_class": 2, "label_isnt_class": 2, "path_not_of_train": 2, "path_outside_fold": 2, "file_missing": 1}
    assert broken(suites.synthetic_rules(frame.filter("id = 's1'"), listing, 2, NAMES)) == {}
    with pytest.raises(guards.Violation):
        guards.enforce(suites.synthetic_rules(frame, listing, 2, NAMES))
