"""Requirement files: lines, names, the closure of includes, cycles."""

import pytest
from pyspark.sql import functions as F

from siftlake.operators import guards
from siftlake.sources import includes

FILES = {
    "a/req.txt": "# comment\nnumpy>=1.2 # note\n-r base.txt\n\n-r ../b/more.txt\npandas[all] ; x\n",
    "a/base.txt": "torch\n--requirement ../b/more.txt", "b/more.txt": "scipy==1.0\n", "b/alone.txt": "x\n-r ./alone.txt\n", "b/one.txt": "-r two.txt", "b/two.txt": "-r one.txt\ny", "b/gone.txt": "-r none.txt", "b/odd.txt": "-e git",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "file string, text string")


def test_names(spark):
    lines = {"numpy": "numpy", "a-b_c>=1": "a-b_c", "x[y]": "x", "z ; w": "z", "k~=2,<3": "k", "p @ u": "p", "==1": ""}
    rows = spark.createDataFrame(list(lines.items()), "line string, want string")
    assert rows.filter(includes.requirement_name(F.col("line")) != F.col("want")).count() == 0


def test_closure(spark, files):
    got = {tuple(r) for r in includes.closure(includes.parsed(files), files.select("file")).collect()}
    assert ("a/req.txt", "b/more.txt", 1, False) in got and ("a/base.txt", "b/more.txt", 1, False) in got and ("a/req.txt", "a/base.txt", 1, False) in got
    assert ("b/one.txt", "b/one.txt", 0, True) in got and ("b/one.txt", "b/two.txt", 1, False) in got and ("b/alone.txt", "b/alone.txt", 0, True) in got
    assert len([r for r in got if r[0] == "a/req.txt"]) == 3


def test_requirements(files):
    got = {(r["name"], r["file"]) for r in includes.requirements(files, "a/req.txt").collect()}
    assert got == {("numpy", "a/req.txt"), ("pandas", "a/req.txt"), ("torch", "a/base.txt"), ("scipy", "b/more.txt")}
    for root, rule in (("b/one.txt", "cycle"), ("b/gone.txt", "missing: b/none.txt"), ("b/odd.txt", "unknown_line"), ("c", "no_root")):
        with pytest.raises(guards.Violation, match=rule):
            includes.requirements(files, root)


def test_long_chains(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(60)], "file string, include string")
    root = spark.createDataFrame([("0",)], "file string")
    assert includes.closure(edges, root).agg(F.max("depth")).first()[0] == 60
    with pytest.raises(Exception, match="(?i)recursion"):
        includes.closure(edges, root, deepest=20).collect()
