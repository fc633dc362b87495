"""Rule suites of the tables that a corpus is frozen in: clean manifest, split, folds, experiment matrix and synthetic rows.

Each suite gives (rule, violations) in one row a rule, to be read as data or raised by `guards.enforce`. Keys of all kinds that a suite
compares go into one grouping, so that a suite shuffles its rows once. Null keys are compared with nothing; a rule about a row counts
rows, one about keys counts keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as e
from .isolation import ARMS, FINAL_TEST, VALIDATION

# The two parts of a split and the states of a run.
PARTS = ("development", "final_test")
STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "INTERRUPTED")


def _told(one: DataFrame) -> DataFrame:
    """(rule, violations) of a single row of counts."""
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), F.coalesce(c, F.lit(0)).cast("long").alias("violations")) for c in one.columns))))


def _suite(keys: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return _told(keys.agg(*(c.alias(n) for n, c in rules.items())))


def _key(kind: str, key: Column | str, *, role: int = 1, value: Column | None = None, broken: Column | None = None) -> Column:
    """A key of a row: its role bit, a value that is compared within the key, and the bits of the row rules that the row breaks."""
    key = F.col(key) if isinstance(key, str) else key
    value = value.cast("string") if value is not None else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(role).alias("role"), value.alias("value"), (broken if broken is not None else F.lit(0)).alias("broken"))


def _grouped(rows: DataFrame, rules: Sequence[str]) -> DataFrame:
    bit = lambda k: F.shiftright("broken", k).bitwiseAND(1)
    own = F.col("role").bitwiseAND(1) == 1
    return rows.groupBy("kind", "key").agg(
        F.bit_or("role").alias("roles"), F.count_if(own).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), *(F.sum(bit(k)).alias(r) for k, r in enumerate(rules)),
    )


def _broken(rules: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, c in enumerate(rules.values()):
        out = out.bitwiseOR(F.when(c, 1 << k).otherwise(0))
    return out


def _of(kind: str, test: Column) -> Column:
    return F.count_if((F.col("kind") == kind) & F.col("key").isNotNull() & test)


def _twice() -> Column:
    return F.col("n") > 1


def _two_values() -> Column:
    return F.col("least") < F.col("most")


def _has(role: int) -> Column:
    return F.col("roles").bitwiseAND(role) != 0


def _named(label: str, names: Sequence[str]) -> Column:
    """True where a class isn't the one that its index names."""
    return ~F.get(F.array(*map(F.lit, names)), F.col(label)).eqNullSafe(F.col("class"))


def clean_rules(rows: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """A clean manifest (id, sha, label, group, included, reason, representative), V01."""
    inside = F.coalesce("included", F.lit(False))
    reason, label = F.coalesce("reason", F.lit("")), F.coalesce("label", F.lit(""))
    own = {
        "included_with_reason": inside & (reason != ""), "excluded_without_reason": ~inside & (reason == ""), "unknown_reason": ~inside & (reason != "") & ~reason.isin(*reasons),
        "included_without_label": inside & (label == ""), "representative_of_itself": F.coalesce(F.col("representative") == F.col("id"), F.lit(False)),
    }
    only = lambda c: F.when(inside, F.col(c))
    keys = rows.select(F.inline(F.array(_key("id", "id", broken=_broken(own)), _key("id", "representative", role=2), _key("sha", only("sha")), _key("group", only("group"), value=F.col("label")))))
    rules = {n: F.sum(n) for n in own} | {
        "id_twice": _of("id", _twice()), "representative_unknown": _of("id", _has(2) & ~_has(1)), "included_content_twice": _of("sha", _twice()), "groups_of_several_labels": _of("group", _two_values()),
    }
    return _suite(_grouped(keys, list(own)), rules)


def split_rules(split: DataFrame, clean: DataFrame, names: Sequence[str]) -> DataFrame:
    """A split (id, class, label, group, split) of the included rows of a clean manifest (id, included), V02. `names` are the classes by label."""
    own = {"unknown_part": ~F.coalesce(F.col("split").isin(*PARTS), F.lit(False)), "label_isnt_class": _named("label", names)}
    part = F.when(F.col("split").isin(*PARTS), F.col("split"))
    keys = split.select(F.inline(F.array(_key("id", "id", broken=_broken(own)), _key("group", "group", value=F.col("split")), _key("class", F.when(part.isNotNull(), F.col("class")), value=part), _key("part", part))))
    manifest = clean.select(F.inline(F.array(_key("id", F.when(F.col("included"), F.col("id")), role=2), _key("id", F.when(~F.coalesce("included", F.lit(False)), F.col("id")), role=4))))
    rules = {n: F.sum(n) for n in own} | {
        "id_twice": _of("id", _twice()), "empty_parts": len(PARTS) - _of("part", _has(1)), "classes_of_one_part": _of("class", F.col("least") == F.col("most")), "groups_in_both_parts": _of("group", _two_values()),
        "included_rows_left_out": _of("id", _has(2) & ~_has(1)), "rows_not_included": _of("id", _has(1) & ~_has(2)), "excluded_rows": _of("id", _has(1) & _has(4)),
    }
    return _suite(_grouped(keys.unionAll(manifest), list(own)), rules)


def fold_rules(rows: DataFrame, folds: int, names: Sequence[str]) -> DataFrame:
    """Folds (id, class, label, group, fold) numbered from 1, V03."""
    known = F.coalesce(F.col("fold").between(1, folds), F.lit(False))
    own = {"fold_out_of_range": ~known, "label_isnt_class": _named("label", names)}
    keys = rows.select(F.inline(F.array(_key("id", "id", broken=_broken(own)), _key("group", "group", value=F.when(F.col("fold").isNotNull(), F.format_string("%010d", F.col("fold")))), _key("fold", F.when(known, F.col("fold"))))))
    rules = {n: F.sum(n) for n in own} | {"id_twice": _of("id", _twice()), "empty_folds": folds - _of("fold", _has(1)), "groups_in_several_folds": _of("group", _two_values())}
    return _suite(_grouped(keys, list(own)), rules)


def matrix_rules(rows: DataFrame, models: Sequence[str], folds: int) -> DataFrame:
    """An experiment matrix (experiment_id, model, fold, arm, train_manifest, validation_manifest, status) of all models, folds from 1 and both arms, V05."""
    arms, want = list(ARMS), len(models) * folds * len(ARMS)
    last = lambda c: F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1)
    two = F.format_string("%02d", F.col("fold"))
    file = lambda pattern: F.concat(F.lit(pattern.split("{")[0]), two, F.lit(pattern.split("}")[1]))
    train = F.coalesce(*(F.when(F.col("arm") == a, file(ARMS[a])) for a in arms))
    known = F.coalesce(F.col("model").isin(*models) & F.col("fold").between(1, folds) & F.col("arm").isin(*arms), F.lit(False))
    own = {
        "off_the_axes": ~known, "train_manifest_name": ~last("train_manifest").eqNullSafe(train), "validation_manifest_name": ~last("validation_manifest").eqNullSafe(file(VALIDATION)),
        "final_test_as_manifest": F.contains(F.concat_ws(" ", "train_manifest", "validation_manifest"), F.lit(FINAL_TEST)), "unknown_status": ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)),
    }
    cell = F.when(known, F.concat_ws("|", "model", F.col("fold").cast("string"), "arm"))
    keys = rows.select(F.inline(F.array(_key("id", "experiment_id", broken=_broken(own)), _key("cell", cell), *(_key(c, F.when(known, F.col(c))) for c in ("model", "fold", "arm")))))
    axes = {"model": len(models), "fold": folds, "arm": len(arms)}
    uneven = sum((_of(c, F.col("n") != want // n) for c, n in axes.items()), F.lit(0))
    rules = {n: F.sum(n) for n in own} | {"id_twice": _of("id", _twice()), "combination_twice": _of("cell", _twice()), "combination_missing": want - _of("cell", _has(1)), "uneven_axis_values": uneven}
    return _suite(_grouped(keys, list(own)), rules)


def synthetic_rules(rows: DataFrame, listing: DataFrame, fold: int, names: Sequence[str]) -> DataFrame:
    """Synthetic rows (id, fold, class, label, path) made for a fold, against a listing (path) of the files there are, V07."""
    own = {
        "of_another_fold": ~F.col("fold").eqNullSafe(fold), "unknown_class": ~F.coalesce(F.col("class").isin(*names), F.lit(False)), "label_isnt_class": _named("label", names),
        "path_not_of_train": ~F.coalesce(e.train_only(F.col("path")), F.lit(False)), "path_outside_fold": ~F.coalesce(F.array_contains(F.split("path", "/"), f"fold_{fold:02d}"), F.lit(False)),
    }
    keys = rows.select(F.inline(F.array(_key("id", "id", broken=_broken(own)), _key("path", "path")))).unionAll(listing.select(F.inline(F.array(_key("path", "path", role=2)))))
    return _suite(_grouped(keys, list(own)), {n: F.sum(n) for n in own} | {"file_missing": _of("path", _has(1) & ~_has(2))})
