"""Content probes of image files with reuse: only new and changed files are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import box_resize
from .readers import files

COLUMNS = ("filepath", "file_size", "sha256", "width", "height", "mode", "dhash", "status")
PENDING, OK, CORRUPT = "pending", "ok", "corrupt"
REUSE, READ, GONE = "reuse", "read", "gone"


def planned(listed: DataFrame, previous: DataFrame) -> DataFrame:
    """(filepath, file_size, plan): one full join of a listing with the last manifest by path and size.

    `reuse`: the manifest has the file with this size, probed; `read`: it hasn't; `gone`: only the manifest has the path.
    Of a path that a manifest repeats the rows are taken together: one probed row of the size is enough.
    """
    old = previous.select("filepath", F.col("file_size").alias("size"), "status").groupBy("filepath").agg(F.collect_set(F.when(F.col("status") != PENDING, F.col("size"))).alias("probed"))
    joined = listed.select("filepath", "file_size", F.lit(True).alias("listed")).join(old, "filepath", "full")
    plan = F.when(F.col("listed").isNull(), GONE).when(F.array_contains("probed", F.col("file_size")), REUSE).otherwise(READ)
    return joined.select("filepath", "file_size", plan.alias("plan"))


def _grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Grey values of blue, green, red (and alpha) bytes, by the usual weights in 16-bit fixed point."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    return a[..., 0] if channels == 1 else (a[..., 2] * 19595 + a[..., 1] * 38470 + a[..., 0] * 7471 + 0x8000) >> 16


def decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, width, height, mode, dhash) of the images that can be decoded; others have no row. The JVM decodes, so all formats that it knows are read."""
    rows = spark.read.format("image").option("dropInvalid", True).option("ignoreCorruptFiles", True).load(paths).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            small = [np.rint(box_resize(_grey(r.height, r.width, r.nChannels, r.data).astype(float), 8, 9)) for r in b.itertuples()]
            b["dhash"] = [np.packbits(s[:, :-1] > s[:, 1:]).tobytes().hex() for s in small]
            yield b[["origin", "width", "height", "nChannels", "dhash"]]

    mode = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB").otherwise("RGBA")
    hashed = rows.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, width int, height int, nChannels int, dhash string")
    return hashed.select(F.col("origin").alias("path"), "width", "height", mode.alias("mode"), "dhash")


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_size, sha256, width, height, mode, dhash, status): a file that cannot be decoded keeps its digest and is `corrupt`."""
    read = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"))
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")  # the two readers spell local paths in two ways
    full = read.withColumn("at", local("path")).join(decoded(spark, paths).withColumn("at", local("path")).drop("path"), "at", "left").drop("at")
    empty = {"width": 0, "height": 0, "mode": "", "dhash": ""}
    return full.withColumn("status", F.when(F.col("dhash").isNull(), CORRUPT).otherwise(OK)).na.fill(empty)


def probed(spark: SparkSession, root: str, previous: DataFrame | None = None, *, block: int = 10_000) -> DataFrame:
    """The manifest (COLUMNS) of all files below a root. Files that `previous` has with the same size aren't opened; files that are gone leave the manifest. Spark's readers don't list files without bytes.

    The paths to be read go to Spark's readers in blocks of `block`; the readers' own listing holds them on the driver in any case.
    """
    listed = files(spark, root).select("path", F.col("relative").alias("filepath"), F.col("length").alias("file_size"))
    old = previous if previous is not None else spark.createDataFrame([], "filepath string, file_size long, sha256 string, width int, height int, mode string, dhash string, status string")
    plan = planned(listed, old).filter(F.col("plan") != GONE)
    kept = old.filter(F.col("status") != PENDING).join(plan.filter(F.col("plan") == REUSE).select("filepath", "file_size"), ["filepath", "file_size"], "left_semi").dropDuplicates(["filepath"]).select(*COLUMNS)
    todo = listed.join(plan.filter(F.col("plan") == READ).select("filepath"), "filepath", "left_semi")
    out, paths = kept, []

    def with_block(out: DataFrame, paths: list[str]) -> DataFrame:
        names = listed.select("path", "filepath")
        return out.unionByName(contents(spark, paths).join(names, "path").select(*COLUMNS))

    for r in todo.select("path").toLocalIterator():
        paths.append(r["path"])
        if len(paths) == block:
            out, paths = with_block(out, paths), []
    return with_block(out, paths) if paths else out
