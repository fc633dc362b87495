"""Source divergence audit: how far the word counts of each source of a language lie from every other source's, exactly.

A group is a (lang, source), a kept term a word of at least `least` documents of its language. A group's weight of a term
depends on its count alone, so the distance of two groups over all kept terms is put together by inclusion and exclusion over
the terms that they have: what one side's terms cost against a zero is priced from that group's histogram of counts, sparse
joins of the terms that both have correct it, and a constant covers terms that neither has. No row stands for a zero.

Cases: null text, lang and source are ''; rows without words still make their group. Rows that repeat an id are documents of
their own. Extra columns are ignored, an empty table has no groups and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staged, cut

#: For the bytes of UTF-8: A-Z become a-z, what is neither a letter A-Z, a-z nor beyond ASCII becomes a space.
TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))

#: Rows of one language are dealt to so many tasks where its groups meet.
DEALT = 16


def term_counts(lang: list[str], source: list[str], texts: list[str]) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of the texts of a batch, whose terms are counted as numbers."""
    apart = pc.split_pattern(pa.array([t.encode().translate(TERM_BYTES).decode() for t in texts], pa.large_string()), " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(apart).to_numpy(zero_copy_only=False))
    coded = apart.flatten().dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    groups = {g: k for k, g in enumerate(dict.fromkeys(zip(lang, source, strict=True)))}
    group = np.array([groups[g] for g in zip(lang, source, strict=True)], np.int64)
    each, times = np.unique(row * size + code, return_counts=True)  # terms of documents
    pair, at = np.unique(group[each // size] * size + each % size, return_inverse=True)
    n, docs = np.bincount(at, times, len(pair)).astype(np.int64), np.bincount(at, minlength=len(pair))
    names = list(groups)
    own, term = pair // size, coded.dictionary.take(pa.array(pair % size)).cast(pa.string())
    out = pa.RecordBatch.from_arrays([pa.array([names[g][0] for g in own], pa.string()), pa.array([names[g][1] for g in own], pa.string()), term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])
    return out.filter(pc.not_equal(term, ""))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, counted by batch, then over all."""
    own = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            yield term_counts(*(b.column(c).to_pylist() for c in ("lang", "source", "text")))

    return own.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weight(n: Column, scale: Column) -> Column:
    """1 + floor(10^9 (n + 2) / scale) in whole numbers; scale is the group's count of kept terms plus twice their number."""
    return 1 + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), scale.cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); below 2^63 as weights are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, *, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the `top` terms that a group has more of than its language."""
    staged = Staged(docs.sparkSession, "divergence")
    each = staged.write(counts(docs), "counts")
    kept = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "total")
    postings = staged.write(each.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")
    listed = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("*").alias("held"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_all"))
    groups = listed.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_all", "held", "terms", "lang_all"])
    scale = F.col("n_all") + 2 * F.col("terms")
    groups = groups.withColumn("scale", scale).withColumn("lang_scale", F.col("lang_all") + 2 * F.col("terms")).withColumn("zero", F.when(F.col("terms") > 0, weight(F.lit(0), F.col("scale"))))
    groups = staged.write(groups, "groups")
    spread = groups.select("lang", "source", "held", "zero", "terms", F.pmod(F.xxhash64("source"), F.lit(DEALT)).alias("deal"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("zero").alias("item_zero"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("deal"))
    pairs = staged.write(spread.join(others, ["lang", "deal"]).filter("source <> item"), "pairs")
    zeros = F.coalesce(distance(F.col("zero"), F.col("item_zero")), F.lit(0).cast("long"))
    neither = pairs.select("lang", "source", "item", (zeros * (F.col("terms") - F.col("held") - F.col("item_held"))).alias("value"))
    priced = postings.join(groups.select("lang", "source", "scale", "lang_scale", "zero"), ["lang", "source"]).withColumn("p", weight(F.col("n"), F.col("scale")))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("many"))
    one = histogram.join(pairs.select("lang", "source", "item", "item_zero"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("many") * distance(F.col("p"), F.col("item_zero"))).alias("value"))
    a, b = (priced.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("p").alias(f"p_{x}"), F.col("zero").alias(f"zero_{x}")) for x in "ab")
    both = a.join(b, ["lang", "term"]).filter("source_a < source_b")
    pa, pb, za, zb = (F.col(c) for c in ("p_a", "p_b", "zero_a", "zero_b"))
    overlap = both.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum(distance(pa, pb) - distance(pa, zb) - distance(za, pb) + distance(za, zb)).alias("value"))
    halves = one.unionAll(overlap)  # each counts for the pair in both orders: the distance is symmetric
    total = neither.unionAll(halves).unionAll(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    base = weight(F.col("total"), F.col("lang_scale"))
    marked = priced.withColumn("q", base).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return total.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(order).unionAll(marked.withColumn("rank", rank).filter(F.col("rank") <= top).select(order))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 2) // (v.n + 2 * v.v) AS q
 FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
