"""Published tables: order, digests, freezing; and probes that read only what changed."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import guards
from siftlake.operators.images import box_resize
from siftlake.sources import outputs, probes

ROWS = "id long, label string"


@pytest.fixture
def rows(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.randrange(400), rng.choice(["b", "a", "é", 'quo"te', "line\nend", None])) for _ in range(3000)], ROWS).repartition(6)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_files_follow_each_other(spark, tmp_path, rows, kind):
    path = str(tmp_path / "out")
    outputs.publish(rows.na.fill("-"), path, ["label", F.desc("id")], kind=kind, rows_per_file=500)
    placed = outputs.placed(spark, path, ROWS, kind=kind)
    plain = rows.na.fill("-").toArrow()
    want = duckdb.sql("SELECT id, label FROM plain ORDER BY label, id DESC").fetchall() if len(plain) else []
    got = outputs.numbered(placed).orderBy("row").collect()
    assert [(r["id"], r["label"]) for r in got] == want and [r["row"] for r in got] == list(range(1, 3001))
    assert placed.select("file").distinct().count() >= 6 and not any(guards.enforce(outputs.order_rules(placed, [F.col("label"), -F.col("id")])).values())
    broken = {r["rule"]: r["violations"] for r in outputs.order_rules(placed, [F.col("id")]).collect()}
    assert all(broken.values())
    assert sorted(map(tuple, outputs.verified(spark, path, ROWS, kind=kind).collect())) == sorted(want)


def test_published_tables_are_frozen_and_told_from_changed_ones(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    assert outputs.publish(rows, path, ["id"], dry_run=True) == "" and not os.path.exists(path)
    lines = outputs.publish(rows, path, ["id", "label"], rows_per_file=1000)
    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    assert lines == (tmp_path / "m" / outputs.DIGESTS).read_text() == "".join(f"{hashlib.sha256((tmp_path / 'm' / n).read_bytes()).hexdigest()}  {n}\n" for n in parts)
    with pytest.raises(FileExistsError):
        outputs.publish(rows, path, ["id"])
    with pytest.raises(FileExistsError):
        outputs.publish(rows, path, ["id"], dry_run=True)
    rules = lambda: {r["rule"]: r["violations"] for r in outputs.digest_rules(spark, path).collect()}
    assert rules() == {"file_changed": 0, "file_missing": 0, "file_added": 0}
    first = tmp_path / "m" / parts[0]
    kept = first.read_bytes()
    first.write_bytes(kept.replace(b",a\n", b",b\n", 1))
    (tmp_path / "m" / "part-99999.csv").write_text("id,label\n")
    (tmp_path / "m" / parts[1]).rename(tmp_path / "m" / "_gone")
    for name in os.listdir(path):
        if name.endswith(".crc"):
            os.remove(f"{path}/{name}")
    assert rules() == {"file_changed": 1, "file_missing": 1, "file_added": 1}
    with pytest.raises(guards.Violation, match="file_changed"):
        outputs.verified(spark, path, ROWS)
    (tmp_path / "m" / outputs.DIGESTS).unlink()
    with pytest.raises(guards.Violation, match="no_digest_file"):
        outputs.verified(spark, path, ROWS)


def test_a_run_that_dies_leaves_nothing(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "m")
    with pytest.raises(Exception, match="dies"):
        outputs.publish(rows.withColumn("id", F.when(F.col("id") < 399, F.col("id")).otherwise(F.raise_error(F.lit("dies")))), path, ["id"])
    monkeypatch.setattr(outputs, "file_digests", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        outputs.publish(rows, path, ["id"])
    assert not [n for n in os.listdir(tmp_path) if not n.startswith(".")]
    monkeypatch.undo()
    outputs.publish(rows.filter("id < 0"), path, ["id"])
    assert outputs.verified(spark, path, ROWS).count() == 0


def png(pixels: np.ndarray) -> bytes:
    """A PNG of grey (h, w) or RGB (h, w, 3) pixels."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + line.tobytes() for line in pixels)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_a_second_probe_reads_only_what_changed(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    root = tmp_path / "set"
    (root / "a").mkdir(parents=True)
    grey, colour = rng.integers(0, 256, (24, 32), np.uint8), rng.integers(0, 256, (16, 18, 3), np.uint8)
    whole = png(colour)
    data = {"a/grey.png": png(grey), "a/rgb.png": whole, "a/cut.png": whole[: len(whole) // 2], "a/text.png": b"no image"}
    for name, content in data.items():
        (root / name).write_bytes(content)
    reads = []
    contents = probes.contents
    monkeypatch.setattr(probes, "contents", lambda spark, paths: reads.extend(paths) or contents(spark, paths))
    first = {r["filepath"]: r for r in probes.probed(spark, str(root), block=2).collect()}
    assert len(reads) == 4 and set(first) == set(data)
    assert all(r["sha256"] == hashlib.sha256(data[n]).hexdigest() and r["file_size"] == len(data[n]) for n, r in first.items())
    assert {n for n, r in first.items() if r["status"] == "corrupt"} == {"a/cut.png", "a/text.png"}
    assert all((r["width"], r["mode"], r["dhash"]) == (0, "", "") for r in first.values() if r["status"] == "corrupt")
    luma = lambda a: (a[..., 0] * 19595 + a[..., 1] * 38470 + a[..., 2] * 7471 + 0x8000) >> 16
    for name, image, mode in (("a/grey.png", grey, "L"), ("a/rgb.png", luma(colour.astype(int)), "RGB")):
        small = np.rint(box_resize(image.astype(float), 8, 9))
        assert first[name]["dhash"] == np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex() and first[name]["mode"] == mode
        assert (first[name]["height"], first[name]["width"]) == image.shape
    manifest = spark.createDataFrame([tuple(first[n][c] for c in probes.COLUMNS) for n in data] + [("a/old.png", 3, "x", 1, 1, "L", "0", "ok")], "filepath string, file_size long, sha256 string, width int, height int, mode string, dhash string, status string")
    (root / "a/text.png").write_bytes(png(grey) + b"tail")
    (root / "new.png").write_bytes(data["a/grey.png"])
    manifest = manifest.withColumn("status", F.when(F.col("filepath") == "a/rgb.png", "pending").otherwise(F.col("status")))
    reads.clear()
    second = {r["filepath"]: r for r in probes.probed(spark, str(root), manifest).collect()}
    assert sorted(p.split("/")[-1] for p in reads) == ["new.png", "rgb.png", "text.png"]
    assert set(second) == {*data, "new.png"} and second["a/text.png"]["status"] == "ok" and second["new.png"]["dhash"] == first["a/grey.png"]["dhash"]
    assert all(tuple(second[n]) == tuple(first[n]) for n in ("a/grey.png", "a/cut.png", "a/rgb.png"))
    reads.clear()
    assert probes.probed(spark, str(root), spark.createDataFrame(list(second.values()), manifest.schema)).count() == 5 and not reads
