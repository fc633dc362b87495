"""Summary, findings, content audit and exported evaluation on small tables with hand-computed results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftlake.operators import dedup, reports

RECORDS = [  # id, sha, near, label, source
    (1, "a", "n1", "x", "s"), (2, "a", "n1", "x", "t"), (3, "b", "n1", "x", "s"), (4, "c", "n2", "x", "s"), (5, "d", "n2", "y", "s"),
    (6, "e", "n3", None, "t"), (7, "f", "n4", "y", "t"), (8, None, None, None, "u"), (9, "g", "n5", "y", "s"), (10, "h", "n5", "y", "s"),
]


@pytest.fixture(scope="module")
def curated(spark):
    rows = spark.createDataFrame([(i, i, *r) for i, *r in RECORDS], "id long, path_rank long, sha string, near string, label string, source string")
    return dedup.curated(rows)


def test_summary(curated):
    got = {(r["section"], r["measure"], r["part"]): r["value"] for r in reports.dedup_summary(curated).collect()}
    one = {k[:2]: v for k, v in got.items() if k[2] == ""}
    assert one["raw", "total"] == 10 and one["raw", "corrupt"] == 1 and one["unresolved", "awaiting_label"] == 2
    assert one["excluded", "total"] == 5 and one["clean", "total"] == 5  # 2 a copy, 4 and 5 in conflict, 6 unresolved, 8 corrupt
    assert {k[2]: v for k, v in got.items() if k[1] == "by_reason"} == {"EXACT_DUPLICATE": 1, "LABEL_CONFLICT_GROUP": 2, "LABEL_UNRESOLVED": 1, "CORRUPT": 1}
    assert got["excluded", "by_source_and_reason", "t|EXACT_DUPLICATE"] == 1 and got["clean", "per_source_and_label", "s|x"] == 2
    assert (one["duplicates", "exact_groups"], one["duplicates", "exact_groups_across_sources"]) == (1, 1)
    assert [one["duplicates", m] for m in ("near_groups", "near_groups_across_sources", "conflicting_groups", "records_in_conflicting_groups")] == [3, 1, 1, 2]
    assert [one["clean", m] for m in ("groups", "groups_of_several", "largest_group")] == [3, 2, 2]


def test_findings_ride_on_the_written_rows(spark, curated, tmp_path):
    extra = {"specimen": F.when(F.col("id") == 9, "fish"), "reveals": F.col("id") == 1, "metadata": F.col("id") > 6, "size": F.col("id") % 2}
    rows = curated.select("id", "sha", "near", "label", "source", "reason").withColumns(extra)
    got = {r["check"]: tuple(r)[1:] for r in reports.written_with_findings(rows, str(tmp_path / "clean")).collect()}
    assert tuple(got) == reports.CHECKS
    assert got["duplicates_within_a_source"] == (2, 4, 1, None, None) and got["duplicates_across_sources"] == (0, 0, 2, None, None)
    assert got["same_specimen"] == (1, 2, 0, None, None) and got["label_in_name"][1] == 1 and got["metadata"][1] == 3
    assert got["size_shortcut"] == (0, 5, 0, 3 / 5, 3 / 5) and got["source_shortcut"] == (0, 5, 0, 3 / 5, 3 / 5)
    back = spark.read.parquet(str(tmp_path / "clean"))
    assert sorted(r["id"] for r in back.collect()) == [1, 3, 7, 9, 10] and back.columns == rows.columns
    none = reports.written_with_findings(rows.filter("false"), str(tmp_path / "none")).collect()
    assert [(r["records"], r["bound"]) for r in none] == [(0, None)] * 7


def test_content_audit(spark):
    rows = spark.createDataFrame([("p1", "a", "PNG", "RGB", "2x2", "h", True), ("p0", "a", "png", "L", "2x2", "h", True), ("p2", "b", "jpg", "RGB", "1x1", "i", False), ("p3", "b", "jpg", None, None, "k", None)], "path string, label string, extension string, mode string, size string, sha string, readable boolean")
    got = {(r["measure"], r["value"]): r["n"] for r in reports.content_audit(rows).collect()}
    assert got == {
        ("class", "a"): 2, ("class", "b"): 2, ("extension", "png"): 2, ("extension", "jpg"): 2, ("mode", "RGB"): 1, ("mode", "L"): 1, ("size", "2x2"): 2,
        ("unreadable", "p2"): 1, ("unreadable", "p3"): 1, ("duplicate", "h p0"): 2, ("total", ""): 4, ("ok", ""): 0,
    }
    assert {(r["measure"], r["n"]) for r in reports.content_audit(rows.filter("path = 'p1'")).collect()} >= {("ok", 1), ("total", 1)}
    assert {(r["measure"], r["n"]) for r in reports.content_audit(rows.filter("false")).collect()} == {("ok", 1), ("total", 0)}
