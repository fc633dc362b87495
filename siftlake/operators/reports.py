"""Reports on curated records: before and after, findings gathered while the clean table is written, and a content audit.

Curated records carry `id`, `sha`, `near` (their group), `label`, `source` and `reason` ('' where included).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _long(rows: DataFrame, section: str, measures: dict[str, Column]) -> DataFrame:
    """(section, measure, part, value) of whole-table aggregates."""
    one = rows.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in measures.items()))
    return one.select(F.lit(section).alias("section"), F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.lit("").alias("part"), F.col(n).alias("value")) for n in measures))))


def dedup_summary(rows: DataFrame) -> DataFrame:
    """(section, measure, part, value): raw records, duplicate groups, exclusions, the clean table and what awaits a decision.

    A row is corrupt without content and mapped with a label. Row counts come from one small table of (source, label, reason) cells, group
    measures from one grouping by content and one by group; nothing is counted distinct over the whole table.
    """
    cells = rows.groupBy("source", "label", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("sha").isNull()).alias("corrupt"))
    n, included = F.col("n"), F.col("reason") == ""
    of = lambda c, v=n: F.sum(F.when(c, v).otherwise(0))
    raw = _long(cells, "raw", {"total": F.sum("n"), "corrupt": F.sum("corrupt")})
    excluded, clean = _long(cells, "excluded", {"total": of(~included)}), _long(cells, "clean", {"total": of(included)})
    waiting = _long(cells, "unresolved", {"awaiting_label": of(F.col("label").isNull())})

    def by(section: str, measure: str, kept: Column, *parts: str) -> DataFrame:
        part = F.concat_ws("|", *(F.coalesce(F.col(p), F.lit("")) for p in parts))
        return cells.filter(kept).groupBy(part.alias("part")).agg(F.sum("n").alias("value")).select(F.lit(section).alias("section"), F.lit(measure).alias("measure"), "part", "value")

    every, mapped = F.lit(True), F.col("label").isNotNull()
    parts = [
        by("raw", "per_source", every, "source"), by("raw", "per_label", mapped, "label"), by("excluded", "by_reason", ~included, "reason"), by("excluded", "by_source_and_reason", ~included, "source", "reason"),
        by("clean", "per_source", included, "source"), by("clean", "per_label", included, "label"), by("clean", "per_source_and_label", included, "source", "label"),
    ]
    two = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    contents = rows.filter("sha is not null").groupBy("sha").agg(F.count("*").alias("n"), two("source").alias("sources"))
    exact = _long(contents, "duplicates", {"exact_groups": F.count_if(n > 1), "exact_groups_across_sources": F.count_if(F.col("sources"))})
    groups = rows.filter("sha is not null").groupBy("near").agg(F.count("*").alias("n"), two("sha").alias("contents"), two("source").alias("sources"), two("label").alias("labels"), F.count_if(included).alias("kept"))
    near = _long(groups, "duplicates", {
        "near_groups": F.count_if(F.col("contents")), "near_groups_across_sources": F.count_if(F.col("contents") & F.col("sources")), "conflicting_groups": F.count_if(F.col("labels")), "records_in_conflicting_groups": of(F.col("labels")),
    })
    kept = _long(groups, "clean", {"groups": F.count_if(F.col("kept") > 0), "groups_of_several": F.count_if(F.col("kept") > 1), "largest_group": F.max("kept")})
    return reduce(DataFrame.unionAll, [raw, excluded, clean, waiting, *parts, exact, near, kept])


def _best(rows: DataFrame, feature: str) -> DataFrame:
    """(feature, best): the most frequent label of each value among included rows, ties to the smaller label."""
    counts = rows.filter("reason = ''").groupBy(feature, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(feature).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias(f"best_{feature}"))


CHECKS = ("duplicates_within_a_source", "duplicates_across_sources", "same_specimen", "label_in_name", "metadata", "size_shortcut", "source_shortcut")


def written_with_findings(rows: DataFrame, path: str) -> DataFrame:
    """Writes the included rows to `path` and returns the seven findings on them (A06): (check, groups, records, excluded, bound, baseline).

    Rows also carry `specimen`, `reveals` (the name tells the label), `metadata` (the record has some) and `size`. The counters ride on
    the rows as they are written (`observe`, in the writing stage itself, where a task that is run again counts once); what a rule needs
    of a row's group or of its feature is joined to the row before, so that no second scan follows. The shortcut bounds are the share of
    rows whose label is the most frequent one of their size or source, against the share of the most frequent label.
    """
    included = F.col("reason") == ""
    own = rows.filter(included)
    groups = own.groupBy("near").agg(F.count("*").alias("members"), (F.min("source") < F.max("source")).alias("across"), F.max(F.col("specimen").isNotNull()).alias("specimens"), F.min("id").alias("first"))
    top = own.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()
    full = rows.join(groups, "near", "left").join(_best(rows, "size"), "size", "left").join(_best(rows, "source"), "source", "left")
    first, many = F.col("id") == F.col("first"), F.col("members") > 1
    tests = {"within": many & ~F.col("across"), "across": F.col("across"), "specimens": F.col("specimens")}
    counters = {f"{n}_{k}": F.count_if(included & c & (first if k == "groups" else F.lit(True))) for n, c in tests.items() for k in ("groups", "records")}
    counters |= {
        "copies": F.count_if(F.col("reason") == "EXACT_DUPLICATE"), "conflicts": F.count_if(F.col("reason") == "LABEL_CONFLICT_GROUP"), "reveals": F.count_if(included & F.col("reveals")),
        "metadata": F.count_if(included & F.col("metadata")), "included": F.count_if(included), "size": F.count_if(included & (F.col("label") == F.col("best_size"))), "source": F.count_if(included & (F.col("label") == F.col("best_source"))),
    }
    seen = Observation()
    full.observe(seen, *(c.alias(n) for n, c in counters.items())).filter(included).select(*rows.columns).write.mode("errorifexists").parquet(path)
    got = seen.get
    n, base = got["included"], (top["n"] if top else 0)
    share = lambda x: x / n if n else None
    found = [
        (got["within_groups"], got["within_records"], got["copies"], None, None), (got["across_groups"], got["across_records"], got["conflicts"], None, None), (got["specimens_groups"], got["specimens_records"], 0, None, None),
        (0, got["reveals"], 0, None, None), (0, got["metadata"], 0, None, None), (0, n, 0, share(got["size"]), share(base)), (0, n, 0, share(got["source"]), share(base)),
    ]
    return rows.sparkSession.createDataFrame([(c, *f) for c, f in zip(CHECKS, found, strict=True)], "check string, groups long, records long, excluded long, bound double, baseline double")


def content_audit(rows: DataFrame) -> DataFrame:
    """(measure, value, n): records by class, extension, mode and size in one grouping, contents that stand more than once, unreadable records, and whether neither occurs.

    Rows carry `path`, `label`, `extension`, `mode`, `size`, `sha` and `readable`; modes and sizes are counted of readable rows. A duplicate's
    value is its digest and its least path. `ok` is 1 if there are no duplicates and no unreadable rows.
    """
    readable = F.coalesce("readable", F.lit(False))
    values = {"class": F.col("label"), "extension": F.lower("extension"), "mode": F.when(readable, F.col("mode")), "size": F.when(readable, F.col("size")), "unreadable": F.when(~readable, F.col("path"))}
    pairs = F.array(*(F.struct(F.lit(n).alias("measure"), c.cast("string").alias("value")) for n, c in values.items()))
    counts = rows.select(F.inline(pairs)).filter("value is not null").groupBy("measure", "value").agg(F.count("*").alias("n"))
    twice = rows.filter("sha is not null").groupBy("sha").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1").select(F.lit("duplicate").alias("measure"), F.concat_ws(" ", "sha", F.col("path").cast("string")).alias("value"), "n")
    found = counts.unionAll(twice)
    total = rows.agg(F.lit("total").alias("measure"), F.lit("").alias("value"), F.count("*").alias("n"))
    clean = found.agg(F.lit("ok").alias("measure"), F.lit("").alias("value"), (F.count_if(F.col("measure").isin("duplicate", "unreadable")) == 0).cast("long").alias("n"))
    return found.unionAll(total).unionAll(clean)
