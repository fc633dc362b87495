"""Constraint suites: rules as counted violations, and a thin raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A rule that must hold doesn't."""


def row_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of rules about single rows, in one pass; a rule is a Column that is true where it is broken."""
    one = rows.agg(*(F.count_if(c).alias(name) for name, c in rules.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules))))


def key_rules(rows: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(rule, violations) of uniqueness rules: keys that stand more than once."""
    each = [rows.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.lit(name).alias("rule"), F.count_if(F.col("n") > 1).alias("violations")) for name, cols in keys.items()]
    return reduce(DataFrame.unionAll, each)


def shared_rules(pairs: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(rule, violations) of isolation rules: keys that two tables share, by semi-join."""
    each = [a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.lit(name).alias("rule"), F.count("*").alias("violations")) for name, (a, b, key) in pairs.items()]
    return reduce(DataFrame.unionAll, each)


def enforce(violations: DataFrame) -> dict[str, int]:
    """Raises Violation if any rule has violations; returns the counts of a finite suite of rules."""
    found = {r["rule"]: r["violations"] for r in violations.collect()}
    if broken := {k: n for k, n in found.items() if n}:
        raise Violation(f"broken rules: {broken}")
    return found


def contaminated(docs: DataFrame, passages: DataFrame, words: int = 8, block: int = 10_000) -> DataFrame:
    """(id, item): records that hold a whole held-out passage; both have (id, text).

    The first and the last word of a passage can be cut in the record, so its probe is the `words` words from the second on, or
    all words between the first and the last where these are fewer: records join on their shingles of each probe length, and what joins is
    checked for the whole passage. Passages of one or two words have no probe; their distinct texts are sought in every record, in blocks
    of about `block` texts that are sent to all tasks; where there are none, records aren't read for them.
    A passage without words is held by no record.
    """
    split = lambda c: F.filter(F.split(c, "[ \\t\\n\\r]+"), lambda x: x != "")
    own = passages.select(F.col("id").alias("item"), F.col("text").alias("passage"), split(F.col("text")).alias("w")).filter(F.size("w") > 0)
    long = F.least(F.lit(words), F.size("w") - 2)
    probe = own.filter(F.size("w") > 2).select("item", "passage", F.array_join(F.slice("w", 2, long), " ").alias("probe"), long.alias("long"))
    lengths = sorted(r["long"] for r in probe.select("long").distinct().collect())  # from 1 to `words`
    found = []
    if lengths:
        parts = docs.select("id", split(F.col("text")).alias("w")).filter(F.size("w") >= lengths[0])
        shingle = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        each = F.flatten(F.array(*(F.when(F.size("w") >= n, shingle(n)).otherwise(F.expr("cast(array() as array<string>)")) for n in lengths)))
        grams = parts.select("id", F.explode(F.array_distinct(each)).alias("probe"))
        hits = grams.join(probe.select("item", "probe"), "probe").select("id", "item").distinct()
        found.append(hits.join(docs.select("id", "text"), "id").join(own.select("item", "passage"), "item").filter(F.contains("text", "passage")).select("id", "item"))
    brief = own.filter(F.size("w") <= 2).select("item", "passage")
    each = brief.select("passage").distinct()
    blocks = -(-each.count() // block)
    for k in range(blocks):
        asked = each.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == k)
        held = docs.select("id", "text").join(F.broadcast(asked), F.contains("text", "passage")).select("id", "passage")
        found.append(held.join(brief, "passage").select("id", "item").distinct())
    return reduce(DataFrame.unionAll, found) if found else docs.select("id", F.lit(None).cast(dict(own.dtypes)["item"]).alias("item")).limit(0)


def mapped(rows: DataFrame, mapping: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """Rows with the columns of their mapping row (J01). Raises Violation if a row's keys aren't in the mapping, or stand there twice.

    The mapping is broadcast if it has `most` rows at most, which is checked; a larger one is joined by shuffle.
    """
    missing = rows.select(*keys).distinct().join(mapping.select(*keys), keys, "left_anti")
    enforce(key_rules(mapping, {"mapping_key_twice": keys}).unionAll(missing.agg(F.lit("unmapped_keys").alias("rule"), F.count("*").alias("violations"))))
    small = mapping.limit(most + 1).count() <= most
    return rows.join(F.broadcast(mapping) if small else mapping, keys)


def mapping_rules(mapping: DataFrame, keys: list[str], target: str, classes: DataFrame) -> DataFrame:
    """(rule, violations) of a mapping table (keys, status, target): unique keys, a target exactly where the status is `mapped`, and one of the declared classes."""
    rules = {
        "mapped_without_target": (F.col("status") == "mapped") & F.col(target).isNull(),
        "target_without_mapped": (F.col("status") != "mapped") & F.col(target).isNotNull(),
    }
    unknown = mapping.filter(F.col(target).isNotNull()).join(classes.select(F.col(classes.columns[0]).alias(target)), target, "left_anti")
    own = row_rules(mapping, rules).unionAll(key_rules(mapping, {"key_twice": keys}))
    return own.unionAll(unknown.agg(F.lit("unknown_target").alias("rule"), F.count("*").alias("violations")))


def forbidden_ids(folds: DataFrame, fold: int, held_out: DataFrame) -> DataFrame:
    """(id): what may not be used to make rows for a fold: its validation rows and the held-out ones."""
    return folds.filter(F.col("fold") == fold).select("id").union(held_out.select("id")).distinct()


def absent(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a listing of files (F06, S11's projection on the listing's side)."""
    return rows.join(listing.select(key).distinct(), key, "left_anti")
