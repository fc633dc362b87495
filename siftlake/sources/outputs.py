"""Sorted, digested and frozen outputs: what is published is complete, in order, and can be told from a changed copy.

Hadoop's file system does what Spark's writers leave open (one rename, one small digest file); rows and file contents stay on executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.guards import enforce

#: The digest file of a published folder: a line `<sha256>  <name>` for each part; the leading `_` hides it from Spark's readers.
DIGESTS = "_SHA256SUMS"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def write_sorted(rows: DataFrame, path: str, order: Sequence[Column | str], *, kind: str = "csv", rows_per_file: int = 5_000_000) -> None:
    """Writes rows in one global order (O01): the part files, by name, follow each other, and each is sorted. Keys are dealt by range, so no task sorts them all; equal keys stay in one range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ranged.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)


def placed(spark: SparkSession, path: str, schema: StructType | str, *, kind: str = "csv") -> DataFrame:
    """The rows of a written folder with `file` and `place`, the order of a row in its file. CSV files are read whole, so that their rows keep their order."""
    reader = spark.read.schema(schema)
    rows = reader.option("header", True).option("multiLine", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)
    place = F.monotonically_increasing_id() if kind == "csv" else F.col("_metadata.row_index")
    return rows.select("*", F.col("_metadata.file_name").alias("file"), place.alias("place"))


def numbered(rows: DataFrame) -> DataFrame:
    """`placed` rows with their 1-based `row` over all files by name, from counts of files; a window holds a file's rows."""
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    return rows.join(before, "file").withColumn("row", F.col("before") + within).drop("before", "place")


def order_rules(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(rule, violations) of `placed` rows: a row before a smaller one in its file, and a file whose least row is before the greatest of the file before it."""
    keyed = rows.select("file", "place", F.struct(*order).alias("key"))
    inner = keyed.withColumn("last", F.lag("key").over(Window.partitionBy("file").orderBy("place"))).agg(F.lit("rows_out_of_order").alias("rule"), F.count_if(F.col("last") > F.col("key")).alias("violations"))
    files = keyed.groupBy("file").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    outer = files.withColumn("last", F.lag("most").over(Window.orderBy("file"))).agg(F.lit("files_out_of_order").alias("rule"), F.count_if(F.col("last") > F.col("least")).alias("violations"))
    return inner.unionAll(outer)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest) of the part files of a folder, hashed on the executors."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))


def publish(rows: DataFrame, path: str, order: Sequence[Column | str], *, kind: str = "csv", dry_run: bool = False, rows_per_file: int = 5_000_000) -> str:
    """Writes a frozen table and returns its digest lines.

    Rows and digests go to a hidden folder beside the target, which one rename then puts in place: a run that dies before leaves nothing
    under the target's name. A target that exists raises FileExistsError, also when another run was faster. `dry_run` writes nothing and
    returns ''. On stores where a rename copies, a reader may see a part of a folder; its digest file, copied or not, tells.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"{path} is frozen")
    if dry_run:
        return ""
    parent, _, name = path.rstrip("/").rpartition("/")
    staging = f"{parent}/_staging-{name}-{uuid.uuid4().hex}"
    try:
        write_sorted(rows, staging, order, kind=kind, rows_per_file=rows_per_file)
        lines = "".join(f"{r['digest']}  {r['name']}\n" for r in file_digests(spark, staging).orderBy("name").toLocalIterator())  # a line a file
        fs, source = _file_system(spark, staging)
        out = fs.create(_file_system(spark, f"{staging}/{DIGESTS}")[1], False)
        out.write(bytearray(lines.encode()))
        out.close()
        if exists(spark, path) or not fs.rename(source, _file_system(spark, path)[1]):
            raise FileExistsError(f"{path} could not be put in place")
    except BaseException:
        fs, source = _file_system(spark, staging)
        fs.delete(source, True)
        raise
    return lines


def digest_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, violations) of a published folder against its digest file: files changed, missing and added, and no digest at all."""
    if not exists(spark, f"{path}/{DIGESTS}"):
        return spark.createDataFrame([("no_digest_file", 1)], "rule string, violations long")
    fs, target = _file_system(spark, f"{path}/{DIGESTS}")  # Spark's readers don't see it
    source = fs.open(target)
    lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").splitlines()
    source.close()
    told = spark.createDataFrame([tuple(line.split("  ", 1)) for line in lines], "told string, name string")
    found = file_digests(spark, path).join(told, "name", "full")
    broken = {"file_changed": F.col("told") != F.col("digest"), "file_missing": F.col("digest").isNull(), "file_added": F.col("told").isNull()}
    one = found.agg(*(F.count_if(c).alias(n) for n, c in broken.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in broken))))


def verified(spark: SparkSession, path: str, schema: StructType | str, *, kind: str = "csv") -> DataFrame:
    """The rows of a published folder, after its files are compared with their digests; raises Violation if they differ. The comparison reads every byte once."""
    enforce(digest_rules(spark, path))
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("enforceSchema", False).option("multiLine", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)
