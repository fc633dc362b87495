"""Positive-unlabelled toxicity: held-out labels, the risk against plain numpy, and the defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from siftlake.llm import queries, toxicity_pu


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in queries.op13_toxicity(spark, "/root/testdata/sf0.1").collect()}


def test_held_out_labels(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    caught = [rows[r["doc_id"]]["predicted"] for r in labels if r["toxic"] == 1]
    clean = [rows[r["doc_id"]]["predicted"] for r in labels if r["toxic"] == 0]
    assert np.mean(caught) >= 0.8 and np.mean(clean) <= 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())


def risk(theta, sets, positive, prior):
    z = np.array([theta[-1] + sum(theta[k] for k in s) for s in sets])
    as_one, as_none = np.logaddexp(0, -z), np.logaddexp(0, z)
    return prior * as_one[positive].mean(), as_none.mean() - prior * as_none[positive].mean()


@pytest.mark.parametrize("harmless", [True, False])
def test_gradient_is_the_corrected_risks(spark, harmless):
    """The direction equals the numeric gradient of the risk, or the negative gradient of its second term where that is below 0."""
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(5, rng.integers(0, 4), replace=False).tolist()) for _ in range(40)]
    positive, prior = np.array([i for i, s in enumerate(sets) if 0 in s][:3]), 0.2 if harmless else 0.9
    theta = rng.normal(size=6) * 0.3 + (0 if harmless else 1) * np.array([5, 0, 0, 0, 0, -4])
    weights = [(s, 1, int(i in positive)) for i, s in enumerate(sets)]
    total = toxicity_pu.sums(spark.createDataFrame(weights, "ids array<int>, n long, p long").repartition(3), theta)
    means = np.append([np.mean([k in sets[i] for i in positive]) for k in range(5)], 1.0)
    got = toxicity_pu.gradient(total, means, prior, len(sets), len(positive))
    first, second = risk(theta, sets, positive, prior)
    assert np.isclose(total[0, -1] / 40 - prior * total[1, -1] / 3, second)
    measure = (lambda t: sum(risk(t, sets, positive, prior))) if second >= 0 else (lambda t: -risk(t, sets, positive, prior)[1])
    numeric = [(measure(theta + d) - measure(theta - d)) / 2e-6 for d in np.eye(6) * 1e-6]
    assert np.allclose(got, numeric, atol=1e-5)
    assert (second >= 0) == harmless


def test_bases_count_words_and_stems():
    got = toxicity_pu.bases("Trash trash, TRASHcan 12 日本 " + "x" * 50)
    assert got["trash"] == 2 and got["tras*"] == 3 and got["trashc*"] == 1 and got["日本"] == 1 and "x" * 50 not in got and got["xxxx*"] == 1
    assert not toxicity_pu.bases(None) and not toxicity_pu.bases("12 #")


def test_odd_rows(spark):
    docs = [(i, ("you clown and scum today" if i % 4 == 0 else f"fine text number {i}") if i % 7 else None, "en", 0.5, True) for i in range(60)]
    docs += [docs[4], docs[5], (None, "you clown", None, None, None), (4, "", "de", 1.0, False), (99, "word " * 50_000, None, None, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, held_out boolean").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i % 9 else None) for i in range(50)] + [(None, 1), (8, 0)], "doc_id long, toxic int")
    got = toxicity_pu.scored(docs, labels).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] != 4}
    assert by[12] > by[13] and by[12] == by[16] and sorted(r["score"] for r in got if r["doc_id"] == 4)[0] == by[7]
    assert {r["score"] for r in toxicity_pu.scored(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity_pu.scored(docs.filter("false"), labels).count() == 0 and toxicity_pu.scored(docs, labels.filter("false")).filter("score > 0").count() == 0


def test_labels_that_may_not_be_learned_change_nothing(spark):
    docs = spark.createDataFrame([(i, "you clown" if i % 3 == 0 else f"fine text {i}") for i in range(90)], "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    other = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, t in labels]
    one, two = (sorted(map(tuple, toxicity_pu.scored(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, other))
    assert one == two


def test_candidates_are_looked_up_as_they_are_counted(spark):
    texts = ["Trash trash TRASHcan trashy", "loser, losers! lose los", None, "", "nothing here", "日本語文字列 日本語文字 İdiot", "trash\u00a0can x" * 3, "a" * 60 + " " + "loser " * 5]
    wanted = {i: toxicity_pu.bases(t) for i, t in enumerate(texts)}
    every = sorted({(base, level) for b in wanted.values() for base, n in b.items() for level in toxicity_pu.LEVELS if n >= level})
    got = {r["doc_id"]: r["ids"] for r in toxicity_pu.looked_up(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), every).collect()}
    assert got == {i: [k for k, (base, level) in enumerate(every) if b[base] >= level] for i, b in wanted.items()}
    assert {tuple(r["ids"]) for r in toxicity_pu.looked_up(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []).collect()} == {()}
