"""Line-oriented requirement files that include each other (P17): parsed as rows, closed by a recursive query."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.guards import Violation

# The options that include a file, and the characters that end a requirement's name.
INCLUDE = r"^(-r|--requirement)\s+"
NAME_ENDS = r"[\s<>=!~;\[(@,]"


def requirement_name(line: Column) -> Column:
    """The distribution name of a requirement line: what stands before a version, extra, marker or address."""
    return F.regexp_extract(F.trim(line), f"^(.*?)(?:{NAME_ENDS}|$)", 1)


def folder_path(file: Column, name: Column) -> Column:
    """`name` beside `file`, with `.` and `..` resolved; a name from the root stands for itself."""
    parts = F.concat(F.slice(F.split(file, "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0))), F.split(name, "/"))
    parts = F.when(F.startswith(name, F.lit("/")), F.split(name, "/")).otherwise(parts)
    drop = lambda t: F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda t, p: F.when(p == "..", drop(t)).when(p == ".", t).otherwise(F.concat(t, F.array(p))))
    return F.array_join(walked, "/")


def parsed(files: DataFrame) -> DataFrame:
    """(file, line_no, line, include, name) of files (file, text): comments and empty lines are left out; exactly one of include and name is set, neither for an option that isn't known."""
    lines = files.select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("line", r"[ \t]#.*$", ""), r"^\s+|\s+$", ""))).filter("line <> '' and line not like '#%'")
    included = F.col("line").rlike(INCLUDE)
    name = F.when(~F.startswith("line", F.lit("-")), F.nullif(requirement_name(F.col("line")), F.lit("")))
    return lines.select("file", (F.col("line_no") + 1).alias("line_no"), "line", F.when(included, folder_path(F.col("file"), F.trim(F.regexp_replace("line", INCLUDE, "")))).alias("include"), name.alias("name"))


def closure(edges: DataFrame, roots: DataFrame, *, deepest: int = 100) -> DataFrame:
    """(root, file, depth, cycle): every file that a root reaches over edges (file, include), the root itself at depth 0, each with its least depth.

    A recursive relation of (root, file): a round joins the files that the last one found with the edges. A path carries the files on
    it; a step back to one of them is kept as a row with `cycle` and not followed. A chain of more than `deepest` steps raises.
    """
    spark, tag = edges.sparkSession, uuid.uuid4().hex
    names = {"e": f"include_edges_{tag}", "r": f"include_roots_{tag}"}
    edges.select("file", "include").filter("file is not null and include is not null").distinct().createOrReplaceTempView(names["e"])
    roots.select(F.col(roots.columns[0]).alias("root")).filter("root is not null").distinct().createOrReplaceTempView(names["r"])
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # no limit on rows, for the session: it is read when the query runs
    return spark.sql(
        f"WITH RECURSIVE reached(root, file, depth, path, cycle) MAX RECURSION LEVEL {deepest} AS ("
        f"SELECT root, root, 0, array(root), false FROM {names['r']} UNION ALL "
        f"SELECT c.root, e.include, c.depth + 1, array_append(c.path, e.include), array_contains(c.path, e.include) FROM reached c JOIN {names['e']} e ON c.file = e.file WHERE NOT c.cycle"
        f") SELECT root, file, min(depth) AS depth, bool_or(cycle) AS cycle FROM reached GROUP BY root, file"
    )


def requirements(files: DataFrame, root: str) -> DataFrame:
    """(name, line, file) that a root file declares with all it includes. Raises Violation on a cycle, on a file that is missing, on an option that isn't known and on a line without a name."""
    rows = parsed(files)
    reached = closure(rows, files.filter(F.col("file") == root).select("file"))
    own = rows.join(reached.select("file").distinct(), "file", "left_semi")
    known = files.select("file").distinct()
    broken = {
        "cycle": reached.filter("cycle").select("file"), "missing": reached.select("file").join(known, "file", "left_anti"),
        "unknown_line": own.filter("include is null and name is null").select(F.concat_ws(": ", "file", "line").alias("file")),
        "no_root": files.sparkSession.createDataFrame([(root,)], "file string").join(known, "file", "left_anti"),
    }
    for rule, found in broken.items():
        if (first := found.agg(F.min("file")).first()[0]) is not None:
            raise Violation(f"{rule}: {first}")
    return own.filter("name is not null").select("name", "line", "file")
