"""Operators of the library on small fixtures with hand-computed results."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftlake.functions import exprs as e
from siftlake.operators import audit, dedup, guards, images, metrics, runs, splits
from siftlake.operators.checkpoints import checkpointed
from siftlake.operators.components import connected_components
from siftlake.sources import readers
from siftlake.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_risk_edges(spark):
    for value, want in ((0.0, "LOW"), (0.4999, "LOW"), (0.5, "MODERATE"), (0.8, "MODERATE"), (0.81, "HIGH"), (1.0, "HIGH")):
        assert one(spark, e.risk_level(F.lit(value))) == want
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(PySparkException):
            one(spark, e.risk_level(F.lit(bad)))


def test_hashes_and_names(spark):
    assert one(spark, e.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000001"))) == 63
    with pytest.raises(PySparkException):
        one(spark, e.hamming_hex(F.lit("ff"), F.lit("0")))
    assert one(spark, e.name_tokens(F.lit("Red_Spot-01.JPG"), ["red spot", "blue"], F.lit("Spot"))) == ["red spot", "<Spot>"]
    assert one(spark, e.train_only(F.lit("data/train/fold1/x"))) and not one(spark, e.train_only(F.lit("data/train/test/x")))
    assert one(spark, e.is_improvement("val_loss", F.lit(1.0), F.lit(1.0))) is False and one(spark, e.is_improvement("f1", F.lit(1.0), F.lit(None).cast("double")))
    assert one(spark, e.experiment_id(F.lit("m"), F.lit(3), F.lit("real"))) == "m_fold03_real"


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (2, 0, 1, 0.6), (3, 1, 1, 0.6), (4, 2, 1, 0.0)], "id long, target int, predicted int, confidence double")
    got = {r["target"]: r for r in metrics.class_metrics(rows, 4).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["support"]) == (pytest.approx(1 / 3), 1.0, 1)
    assert (got[3]["f1"], got[3]["support"], got[2]["recall"]) == (0.0, 0, 0.0)
    assert metrics.summary_metrics(rows, 4).first()["macro_f1"] == pytest.approx((2 / 3 + 0.5) / 4)
    bins = {r["bin"]: r["n"] for r in metrics.calibration_bins(rows).collect()}
    assert bins == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2, 6: 0, 7: 0, 8: 1, 9: 0}
    with pytest.raises(PySparkException):
        metrics.confusion(rows, 2).collect()


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", checkpointed).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and got[101] == 100 and got[200] == 200


def test_hamming_bands_find_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 20)
    hashes = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 12), replace=False)) for b in base for _ in range(6)]
    want = [0] * 9
    for i, a in enumerate(hashes):
        for b in hashes[:i]:
            if (d := (a ^ b).bit_count()) <= 8:
                want[d] += 1
    got = dedup.hamming_histogram(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")).orderBy("distance").collect()
    assert [r["pairs"] for r in got] == want


def test_hamming_classes_meet_few_others(spark):
    rng = np.random.default_rng(4)
    hashes = [(int(h) << 7) % 2**63 | 5 for h in rng.integers(0, 2**56, 3000)]  # seven bits in common
    met = dedup.named_values(spark.createDataFrame([(h, 1) for h in hashes], "hash long, n long")).groupBy("named").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    assert met < 3000 * 3000 / 9
    got = dedup.hamming_histogram(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")).collect()
    want = [0] * 9
    for i, a in enumerate(hashes):
        for b in hashes[:i]:
            if (d := (a ^ b).bit_count()) <= 8:
                want[d] += 1
    assert [r["pairs"] for r in sorted(got)] == want


def test_quota_and_groups(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 1), ("c", 0)], "k string, n long")
    got = {}
    for r in splits.largest_remainder(counts, "k", [0.7, 0.15, 0.15]).collect():
        got.setdefault(r["k"], {})[r["part"]] = r["quota"]
    assert got == {"a": {0: 7, 1: 2, 2: 1}, "b": {0: 1, 1: 0, 2: 0}, "c": {0: 0, 1: 0, 2: 0}}
    rows = spark.createDataFrame([(f"g{k % 30}", "s", "l") for k in range(200)], "group string, source string, label string")
    parts = rows.join(splits.assigned_groups(rows, [0.8, 0.2]), "group")
    assert splits.straddling(parts).count() == 0 and parts.count() == 200
    assert abs(parts.filter("part = 1").count() - 40) <= 7
    assert sorted(splits.assigned_groups(rows, [0.8, 0.2]).collect()) == sorted(splits.assigned_groups(rows.repartition(7), [0.8, 0.2]).collect())


def test_guards(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id long, label string")
    found = guards.row_rules(rows, {"no_label": F.col("label").isNull()}).unionAll(guards.key_rules(rows, {"unique": ["id"]}))
    with pytest.raises(guards.Violation, match="no_label"):
        guards.enforce(found)
    assert guards.enforce(guards.row_rules(rows, {"fine": F.col("id") < 0})) == {"fine": 0}


def test_passages_of_any_length_are_found(spark):
    whole = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    items = {n: " ".join(whole.split()[:n]) for n in range(1, 14)} | {20: "", 21: None, 22: "zz  yy xx", 23: "w0 w1"}
    texts = {1: f"before x{whole}y after", 2: "w0 w1 w2", 3: "nothing", 4: None, 5: "", 6: "a w1 w2 w3 w4 w5 w6 w7 b", 7: "zz yy xx", 8: "zz  yy xx"}
    docs, passages = (spark.createDataFrame(list(x.items()), "id long, text string") for x in (texts, items))
    want = sorted((d, i) for d, t in texts.items() for i, p in items.items() if t and p and p in t)
    assert sorted(map(tuple, guards.contaminated(docs, passages).collect())) == want and (2, 3) in want and (1, 9) in want
    assert sorted(map(tuple, guards.contaminated(docs, passages, 3).collect())) == want
    assert sorted(map(tuple, guards.contaminated(docs, passages, block=1).collect())) == want
    long = guards.contaminated(docs, passages.filter("id between 3 and 13"))
    assert "NestedLoop" not in long._jdf.queryExecution().toString() and sorted(map(tuple, long.collect())) == [w for w in want if 3 <= w[1] <= 13]
    assert guards.contaminated(docs, passages.filter("id in (20, 21)")).collect() == []


def test_early_stop(spark):
    values = [1.0, 2.0, 2.0, 1.5, 3.0, 1.0, 1.0, 1.0]
    history = spark.createDataFrame([("r", k, v) for k, v in enumerate(values)], "run string, step int, f1 double")
    assert tuple(runs.early_stop(history, "run", "step", "f1", 3).first()) == ("r", 8, 3.0)
    assert runs.early_stop(history, "run", "step", "f1", 4).first()["stop_at"] is None
    assert runs.best_runs(history, "run", "step", "f1").first()["best_step"] == 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, path_rank long, sha string, near string, label string, source string")
    assert dedup.curated(empty).count() == 0 and dedup.duplicate_pairs(empty).count() == 0 and audit.leakage_flags(empty).count() == 0
    assert dedup.ranked_keys(empty, "sha", "x").count() == 0


def test_images(spark):
    grey = [np.full((16, 18), 200, np.uint8), np.tile(np.arange(18, dtype=np.uint8)[::-1] * 10, (16, 1))]
    rows = spark.createDataFrame([(k, g.shape[1], g.shape[0], bytearray(g.tobytes())) for k, g in enumerate(grey)], "id long, width int, height int, pixels binary")
    assert {r["id"]: r["dhash"] for r in images.difference_hashes(rows).collect()} == {0: "0" * 16, 1: "f" * 16}
    flags = {r["id"]: (r["dark"], r["blurry"]) for r in images.quality(rows).collect()}
    assert flags[0] == (False, True)


def test_sources(spark, tmp_path):
    for name in ("train/a/1.JPG", "valid/b/2.png", "train/a/readme.txt", "stray.zip"):
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(b"x")
    rows = readers.discovered(spark, {"k": (str(tmp_path / "set"), "split_class_folders")}).collect()
    assert {(r["original_class"], r["original_split"], r["relative"]) for r in rows} == {("a", "train", "train/a/1.JPG"), ("b", "valid", "valid/b/2.png")}
    assert {one(spark, readers.file_kind(F.lit(n))) for n in ("a.zip", "README.md", "x.bin", ".DS_Store")} == {"archive", "documentation", "unexpected", "ignored"}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    table = spark.createDataFrame([(1, "a"), (2, "")], schema)
    readers.write_table(table.coalesce(1), str(tmp_path / "m"))
    assert sorted(map(tuple, readers.manifest(spark, str(tmp_path / "m"), schema).collect())) == [(1, "a"), (2, "")]
    with pytest.raises(PySparkException):
        readers.write_table(table, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="header"):
        readers.manifest(spark, str(tmp_path / "m"), T.StructType(schema.fields[::-1]))
    assert readers.content_digest(table, "k").first() == readers.content_digest(table.repartition(3), "k").first()


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "view", 2.0), (1, "error", 4.0), (2, "view", 1.0)], "session long, kind string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = sessions.event_stream(spark, str(tmp_path / "in"), "session long, kind string, value double")
    q = sessions.running_stats(stream).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("stats").collect()) == sorted(runs.session_stats(events).collect())
    sessions.to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    sessions.to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_ranks_of_many_keys_are_dense(spark):
    n = 300_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = dedup.ranked_keys(rows, "k", "").select("k", F.col("group").cast("long").alias("rank"))
        want = rows.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("want"))
        assert got.join(want, "k").filter("rank = want").count() == n == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mapping_raises_on_rows_without_one(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, class string")
    mapping = spark.createDataFrame([("a", "x")], "class string, label string")
    with pytest.raises(guards.Violation):
        guards.mapped(rows, mapping, ["class"])
    assert guards.mapped(rows.filter("id = 1"), mapping, ["class"]).collect()[0]["label"] == "x"
    with pytest.raises(guards.Violation):
        guards.mapped(rows.filter("id = 1"), mapping.unionAll(mapping), ["class"])


def brute_fingerprint(text):
    words = {w for w in re.findall(r"[^\W_]+", (text or "").lower())}
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
    return sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else None


def test_fingerprints_cover_whole_texts(spark):
    """Texts under one licence line differ, a changed late word matters, scripts beyond Latin have words, texts without words have none."""
    licence = "permission is hereby granted free of charge to any person"
    texts = [f"{licence} " + " ".join(f"{x}{k}" for k in range(40)) for x in "ab"] + ["日本 語", "日本 文", "Ünï Côdé 12", "ünï, CÔDÉ; 12 12", "# !", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["fingerprint"] for r in dedup.fingerprints(rows, "id").collect()}
    assert got == {i: f for i, t in enumerate(texts) if (f := brute_fingerprint(t)) is not None} and len(got) == 6
    assert (got[0] ^ got[1]).bit_count() > 2 and got[2] != got[3] and got[4] == got[5]


def test_near_classes_are_the_components_at_two_bits(spark):
    rng = np.random.default_rng(8)
    prints = {int(b) for b in rng.integers(0, 2**60, 30)}
    for base in list(prints):  # chains of one or two bits, and neighbours at three
        for _ in range(4):
            base ^= sum(1 << int(k) for k in rng.choice(60, rng.integers(1, 4), replace=False))
            prints.add(base)
    group = {p: p for p in prints}
    for _ in prints:
        group = {p: min(group[q] for q in prints if (p ^ q).bit_count() <= 2) for p in prints}
    got = {r["fingerprint"]: r["near"] for r in dedup.near_classes(spark.createDataFrame([(p,) for p in prints] * 3, "fingerprint long").repartition(3)).collect()}
    assert {p: got.get(p, p) for p in prints} == group and 1 < len(set(group.values())) < len(prints)
    assert dedup.near_classes(spark.createDataFrame([], "fingerprint long")).count() == 0


def greedy_counts(quota, filled, size, n):
    filled, got = list(filled), [0] * len(quota)
    for _ in range(n):
        best = max(range(len(quota)), key=lambda k: (Fraction(quota[k] - filled[k], max(quota[k], 1)), -k))
        filled[best] += size
        got[best] += 1
    return got


def test_level_counts_are_the_greedy_ones():
    rng = random.Random(4)
    for _ in range(300):
        quota = [rng.choice([0, 1, 3, rng.randrange(60), 100]) for _ in range(rng.randrange(1, 6))]
        filled = [rng.randrange(0, 70) for _ in quota]
        size, n = rng.randrange(1, 9), rng.randrange(0, 90)
        assert splits.level_counts(quota, filled, size, n) == greedy_counts(quota, filled, size, n), (quota, filled, size, n)
    assert sum(splits.level_counts([8 * 10**11, 2 * 10**11], [0, 0], 1, 10**12)) == 10**12


def test_groups_are_dealt_as_one_by_one(spark):
    """Sizes of each part in each stratum equal those of the rule applied group by group."""
    rng = random.Random(9)
    rows = [(f"g{g}", rng.choice("st"), "ab"[g % 2]) for g in range(120) for _ in range(rng.choice([1, 1, 1, 2, 3, 9]))]
    rows += [(None, "s", "a"), ("lone", "s", None)]
    frame = spark.createDataFrame(rows, "group string, source string, label string")
    parts = dict(map(tuple, splits.assigned_groups(frame, [0.6, 0.3, 0.1]).collect()))
    stratum = dict(map(tuple, splits.strata(frame.filter("`group` is not null")).collect()))
    size = Counter(g for g, _, _ in rows if g)
    assert set(parts) == set(size)
    for s in set(stratum.values()):
        own = sorted((size[g] for g in size if stratum[g] == s), reverse=True)
        counts = spark.createDataFrame([("k", sum(own))], "k string, n long")
        quota = [r["quota"] for r in splits.largest_remainder(counts, "k", [0.6, 0.3, 0.1]).orderBy("part").collect()]
        filled, want = [0, 0, 0], Counter()
        for n in own:
            got = greedy_counts(quota, filled, n, 1).index(1)
            filled[got] += n
            want[got, n] += 1
        assert Counter((parts[g], size[g]) for g in size if stratum[g] == s) == want
    with pytest.raises(ValueError, match="ratios"):
        splits.assigned_groups(frame, [0.6, 0.3])
    two = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "x")], "group string, stratum string")
    with pytest.raises(guards.Violation, match="groups_in_two_strata"):
        guards.enforce(splits.one_stratum_each(two))


def test_specimen_layout_metadata_and_ids(spark, tmp_path, monkeypatch):
    for name in ("sick/carp/f1/1.png", "fine/carp/f2/2.png", "fine/stray.png"):
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(b"x")
    source = {"k": (str(tmp_path / "set"), "specimen_folders")}
    rows = readers.discovered(spark, source).collect()
    assert {(r["original_class"], r["species"], r["specimen"]) for r in rows} == {("sick", "carp", "f1"), ("fine", "carp", "f2")}
    stated = "relative string, original_class string, species string, specimen string"
    good = spark.createDataFrame([("sick/carp/f1/1.png", "sick", "carp", "f1"), ("other", "x", "y", "z")], stated)
    assert readers.discovered(spark, source, {"k": good}).count() == 2
    for wrong in (("sick/carp/f1/1.png", "sick", "carp", "f9"), ("sick/carp/f1/1.png", "sick", None, "f1")):
        with pytest.raises(guards.Violation, match="metadata_differs"):
            readers.discovered(spark, source, {"k": spark.createDataFrame([wrong], stated)})
    monkeypatch.setattr(readers.e, "record_id", lambda *_: F.lit("same"))
    with pytest.raises(guards.Violation, match="record_id_twice"):
        readers.discovered(spark, source)


def test_undeclared_classes_raise(spark):
    assert one(spark, e.class_index(F.lit("b"), ["a", "b"])) == 1
    for bad in (F.lit("c"), F.lit(None).cast("string")):
        with pytest.raises(PySparkException, match="undeclared class"):
            one(spark, e.class_index(bad, ["a", "b"]))


def test_record_flags(spark):
    rows = [(1, "a", "n", "s", None, "Red_Spot.png"), (2, "a", "n", "s", "", None), (3, "b", "n", "t", "f", "x-FLIP.png"), (4, "c", "m", "s", None, "plain")]
    frame = spark.createDataFrame(rows, "id long, sha string, near string, source string, specimen string, name string")
    got = dict(map(tuple, audit.record_flags(frame, ["red spot"]).collect()))
    group = "near_duplicate_group;cross_dataset_group"
    assert got == {1: f"exact_duplicate_group;{group};filename_reveals_label", 2: f"exact_duplicate_group;{group}", 3: f"{group};specimen_group;pre_augmented_filename", 4: ""}


def test_split_measures_and_target_leakage(spark):
    rows = [("a", "g", "final_test", "f"), ("a", "g", "development", None), ("b", "h", "final_test", ""), ("b", "h", "final_test", None), ("b", None, "development", None), ("a", "k", "", "f")]
    got = {(r["measure"], r["part"]): r["value"] for r in splits.split_measures(spark.createDataFrame(rows, "label string, group string, split string, specimen string")).collect()}
    assert got == {("share", ""): 0.6, ("share_of_label", "a"): 0.5, ("share_of_label", "b"): 0.667, ("groups_straddling", ""): 1, ("largest_group_in_test", ""): 2, ("specimen_groups_in_test", ""): 1}
    paths = [("s", "a", f"a/gill_{k}.png") for k in (3, 1, 2, 0)] + [("s", "b", "a/x.png"), ("t", "t", "t/y.png"), (None, "u", None)]
    frame = spark.createDataFrame(paths, "source string, label string, path string")
    found = {r["source"]: tuple(r)[1:] for r in audit.target_leakage(frame, "source", e.name_tokens(F.coalesce("path", F.lit("")), ["gill"]), "label", "path").collect()}
    assert found == {"s": (5, 4, 80.0, False, "a/gill_0.png; a/gill_1.png; a/gill_2.png"), "t": (1, 0, 0.0, True, ""), None: (1, 0, 0.0, False, "")}


def test_only_fingerprints_that_may_be_near_another_name_their_neighbours(spark):
    rng = random.Random(5)
    lone = [rng.getrandbits(60) for _ in range(300)]
    near = [x ^ (1 << a) ^ (1 << b) for x in lone[:40] for a, b in [rng.sample(range(60), 2)]]
    prints = spark.createDataFrame([(x,) for x in [*lone, *near, *lone[:5]]], "fingerprint long")
    held = {r[0] for r in dedup.paired(prints.distinct()).collect()}
    assert held >= {*lone[:40], *near} and len(held) < 100  # 80 and few that hold half of their bits in common by chance
    got = {r["fingerprint"]: r["near"] for r in dedup.near_classes(prints).collect()}
    assert got == {x: min(pair) for pair in zip(lone[:40], near, strict=True) for x in pair}
