"""Readers and writers of records, manifests and reports. Nothing here opens files on the driver: Spark reads and writes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as e
from ..operators import guards

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
IGNORED = (".DS_Store", "Thumbs.db", "desktop.ini")


def files(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """(path, relative, parts, length[, content]) of every file below a root (S05); content isn't read unless asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = F.regexp_replace("path", "^[a-z]+:/+", "/")
    relative = F.regexp_replace(clean, "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    rows = rows.withColumn("relative", relative).withColumn("parts", F.split("relative", "/"))
    return rows.select("path", "relative", "parts", "length", *(["content"] if content else []))


def file_kind(name: Column, documentation: tuple[str, ...] = ("readme", "license")) -> Column:
    """image, ignored, documentation, archive or unexpected; the first that fits."""
    extension = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    stem = F.lower(F.regexp_replace(name, "\\.[^.]*$", ""))
    return F.coalesce(
        F.when(name.isin(*IGNORED), "ignored").when(extension.isin(*IMAGE_EXTENSIONS), "image")
        .when(stem.isin(*documentation) | extension.isin("md", "txt", "pdf", "csv"), "documentation").when(extension.isin("zip", "tar", "gz", "rar", "7z"), "archive"),
        F.lit("unexpected"),
    )


def class_folders(rows: DataFrame) -> DataFrame:
    """`<class>/<file>`, exactly two parts."""
    return rows.filter(F.size("parts") == 2).withColumn("original_class", F.get("parts", F.lit(0))).withColumn("original_split", F.lit(""))


def split_class_folders(rows: DataFrame) -> DataFrame:
    """`<train|valid|test>/<class>/<file>`, exactly three parts."""
    return rows.filter((F.size("parts") == 3) & F.get("parts", F.lit(0)).isin("train", "valid", "test")).withColumn("original_class", F.get("parts", F.lit(1))).withColumn("original_split", F.get("parts", F.lit(0)))


def flat_test(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`<split>/<class>/<file>`, and flat `test_split/<file>` labelled by a table (file, label), else by the name before its first `_`."""
    flat = rows.filter(F.size("parts") == 2).withColumn("file", F.get("parts", F.lit(1))).join(labels, "file", "left")
    named = F.coalesce(F.nullif("label", F.lit("")), F.substring_index("file", "_", 1))
    flat = flat.withColumn("original_class", named).withColumn("original_split", F.lit("test")).drop("file", "label")
    return split_class_folders(rows.withColumn("parts", F.transform("parts", lambda p: F.regexp_replace(p, "_split$", "")))).unionByName(flat)


def specimen_folders(rows: DataFrame) -> DataFrame:
    """`<condition>/<species>/<specimen>/<file>`, exactly four parts."""
    part = lambda k: F.get("parts", F.lit(k))
    return rows.filter(F.size("parts") == 4).withColumns({"original_class": part(0), "original_split": F.lit(""), "species": part(1), "specimen": part(2)})


#: Layouts by name (U01): each takes the listing and gives records with original_class and original_split.
LAYOUTS: dict[str, Callable[..., DataFrame]] = {"class_folders": class_folders, "split_class_folders": split_class_folders, "flat_test": flat_test, "specimen_folders": specimen_folders}


def metadata_conflicts(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records whose class, species or specimen by path differs from their metadata row's, of the columns that the metadata (relative, ...) states (S04); records without a row are fine, a stated null differs from anything."""
    stated = [c for c in ("original_class", "species", "specimen") if c in metadata.columns and c in rows.columns]
    told = metadata.select("relative", *(F.col(c).alias(f"stated_{c}") for c in stated))
    return rows.join(told, "relative").filter(reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"stated_{c}")) for c in stated)))


def agreeing(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """The records, if none of them differs from its metadata row; raises Violation otherwise."""
    guards.enforce(metadata_conflicts(rows, metadata).agg(F.lit("metadata_differs_from_path").alias("rule"), F.count("*").alias("violations")))
    return rows


def discovered(spark: SparkSession, sources: dict[str, tuple[str, str]], metadata: dict[str, DataFrame] | None = None) -> DataFrame:
    """Records of all sources {key: (root, layout)} with ids (S07, P02). Raises Violation if two records get one id, or if one differs from its source's metadata."""
    out = None
    for key, (root, layout) in sorted(sources.items()):
        rows = LAYOUTS[layout](files(spark, root).filter(file_kind(F.element_at("parts", -1)) == "image"))
        if metadata and key in metadata:
            rows = agreeing(rows, metadata[key])
        more = [(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in ("species", "specimen")]
        rows = rows.select(F.lit(key).alias("source"), "relative", "original_class", "original_split", "length", *more)
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("id", e.record_id(F.col("source"), F.col("relative")))
    guards.enforce(guards.key_rules(out, {"record_id_twice": ["id"]}))
    return out


def manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with exactly the declared header, in order; other headers raise (S10). Missing text stays ''."""
    header = spark.read.text(path).limit(1).first()
    if header is None or header[0].split(",") != schema.fieldNames():
        raise ValueError(f"header differs from {schema.fieldNames()}")
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return rows.na.fill("", [f.name for f in schema if f.dataType.typeName() == "string"])


def settings(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON of a declared schema (S12); rows without a required field raise when they are read."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name)))
    return rows


def write_table(rows: DataFrame, path: str, *, kind: str = "csv", frozen: bool = True) -> None:
    """Writes a table; a frozen one must not exist yet."""
    writer = rows.write.mode("errorifexists" if frozen else "overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def content_digest(rows: DataFrame, key: str) -> DataFrame:
    """One row: a digest of a table's rows whatever their order or files (K01, V08): count and sums of two halves of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda k: F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(half(1)).alias("a"), F.sum(half(13)).alias("b")).select(F.sha2(F.concat_ws(":", F.lit(key), "n", "a", "b"), 256).alias("digest"))
