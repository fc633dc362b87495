"""The filter and source audits against their SQL on whole tables, on odd rows and by hand."""

from __future__ import annotations

import random

import duckdb
import pytest

from siftlake.llm import filter_audit, queries, source_divergence

SF = "/root/testdata/sf0.001"


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in rows)


def same_as_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        if isinstance(rows, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{rows}'")
        else:
            con.register(name, rows.toArrow())
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    assert canonical(map(tuple, got.collect()), got.columns) == canonical(rows, names)
    return rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_whole_tables(spark, name):
    assert same_as_sql(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], documents=f"{SF}/documents.parquet", labels=f"{SF}/labels.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, mask long, n long, term string, part string, good int, copy string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, copies under one id and many, repeated rows, clashing columns, letters beyond ASCII."""
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "straße", "日本", "a1b", "x_y", "#tag", "GAMMA", "İ"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(20_000))
    texts = [None, "", " \n\t", long, long, "one", "ONE TWO", "a b c", "a b c", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 160))) for _ in range(60))]
    rows = [(i if i % 17 else None, t, (None, "", "en", "de")[i % 4], (None, "s", "t")[i % 3], 1, 2, "t", "p", 3, None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[8], (200, "a b c", "fr", "s", None, None, None, None, None, None), (None,) * 10, rows[20], (rows[20][0], *rows[21][1:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2 if i % 5 else None, int(i % 3 == 0)) for i in range(0, 80)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (900, 1, 1)], "doc_id long, quality int, toxic int")


def test_filter_audit_on_odd_rows(odd, marks):
    rows = same_as_sql(filter_audit.audited(odd, marks), filter_audit.SQL, documents=odd, labels=marks)
    assert len(rows) == 600 * 4  # '', en, de, fr


def test_divergence_on_odd_rows(odd):
    rows = same_as_sql(source_divergence.divergence(odd), source_divergence.SQL, documents=odd)
    assert {r[2] for r in rows} == {"pair", "term"} and any(r[0] == "fr" for r in rows) is False  # one source alone has no pair and no kept term


def test_empty_tables(odd, marks):
    none = odd.filter("false")
    assert filter_audit.audited(none, marks).count() == 0 and source_divergence.divergence(none).count() == 0
    assert filter_audit.audited(odd, marks.filter("false")).filter("good_lost <> 0 or toxic_lost <> 0").count() == 0


def test_filter_audit_by_hand(spark):
    """Two short copies: A removes both in the order AE..., E the later one in the order EA...."""
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en"), (3, " ".join(f"w{k}" for k in range(120)), "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(2, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audited(docs, marks).collect()}
    first, then = got["AEBCD", 1], got["AEBCD", 2]
    assert (first["removed"], first["kept"], first["good_lost"], first["toxic_lost"], first["unique_fails"]) == (2, 1, 1, 1, 1)
    assert (then["removed"], then["redundant"]) == (0, 1) and got["EABCD", 1]["removed"] == 1
    assert first["shapley"] == 120 + 60 and then["shapley"] == 60


def test_mixed_subset_sums(spark):
    counted = spark.createDataFrame([("p", m, m + 1, 0, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    got = filter_audit.survivors(counted, 3).first()["n"]
    assert got == [sum(m + 1 for m in range(8) if not m & s) for s in range(8)]


def test_divergence_of_a_group_without_terms(spark):
    docs = spark.createDataFrame([(i, "aa bb", "en", "s") for i in range(12)] + [(90, "zz 12", "en", "t"), (91, None, None, None), (92, "", None, "u")], "doc_id long, text string, lang string, source string")
    got = {(r["lang"], r["source"], r["part"], r["item"]): r["value"] for r in source_divergence.divergence(docs).collect()}
    p = 1 + 10**9 * 14 // 28
    q = 1 + 10**9 * 2 // 4
    assert got["en", "t", "pair", "s"] == got["en", "s", "pair", "t"] == 2 * ((p - q) ** 2 // (p + q)) and got["", "", "pair", "u"] == 0
