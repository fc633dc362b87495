"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the checkpoint folder set by the caller, or one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftlake-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings; the caller's come back at the end."""
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in old.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


#: Shuffle files of a job that has ended go: what outlives a job here is a whole written table, read by later jobs.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut in the shared folder, for rows that are small beside the input."""
    shared_dir(df.sparkSession)
    with configured(df.sparkSession, CLEAN):
        return df.checkpoint(eager=True)


_written: list[Staged] = []


class Staged:
    """Parquet tables in the shared folder that one run of an operator writes, reads again and may drop. `release` removes what is left of all runs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/siftlake-{name}-{uuid.uuid4().hex}"
        _written.append(self)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """`df` as read again; with `by`, the last column, in a folder for each of its values, which can be dropped alone."""
        path = f"{self.root}/{name}"
        with configured(self.spark, CLEAN):
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Removes the written tables of all runs so far: call it when their results have been read or saved."""
    while _written:
        _written.pop().drop()


def same_each_read(df: DataFrame, staged: Staged) -> DataFrame:
    """`df` if it is a plain scan of files, whose partitions hold the same rows in the same order each time; else a written copy of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.sub(r"^[\s:+\-]*", "", line).split(" ")[0] for line in plan.splitlines() if line.strip()]
    plain = bool(df.inputFiles()) and all(re.fullmatch(r"Project|Filter|Relation.*", n) for n in nodes) and not re.search(r"rand\(|uuid\(|monotonically", plan)
    return df if plain else staged.write(df, "input")


def cut(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of about `size` bytes."""
    for whole in batches:
        step = max(1, int(whole.num_rows * size / max(whole.nbytes, 1)))
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def by_batch(df: DataFrame, schema: str, f: Callable[[dict[str, list]], dict[str, list] | None], binary: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow with plain Python lists: `f` gets the columns of a batch and returns those of `schema`. Columns in `binary` come as UTF-8 bytes.

    Batches are cut to about 4 MB, so that very long texts don't meet in memory.
    """
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * (4 << 20) / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                got = f({n: (c.cast(pa.large_binary()) if n in binary else c).to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def n_words(text: str = "text"):
    """Words of a text as a Column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h
