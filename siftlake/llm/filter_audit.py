"""Filter interaction audit: what each filter removes in every order of filters, from one pass over the documents.

Each document gets a mask of the filters that it fails. Counts of masks by part are turned into survivors of every subset of
filters by the subset-zeta transform; a step of an order is then the difference of two neighbouring subsets. Everything is
DataFrame functions: no document meets another but for the grouped minimum that finds copies.

Cases: a null text is empty, and empty texts are copies of each other; a null part is ''. Rows that repeat an id are each
counted; of copies the rows with the smallest id pass the copy filter, all others with an id fail it, and rows without an id
neither fail it nor make others fail. A document is good or toxic if any label row of its id says so; rows without an id
have no labels. Extra columns are ignored. An empty table has no parts and no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Values of the extra join key that spreads rows without an id.
SPREAD = 1024

NAMES = "ABCDE"


def failures(text: Column) -> list[Column]:
    """The text filters A to D as Columns that are true where a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, bit k for filter k.

    Copies share the text filters, so they are counted by (text, part, label) before the copy filter is decided: of each
    text only the rows of its smallest id pass. Texts meet as SHA-256 values; map-side counts make large groups of copies,
    and the spread join key rows without an id, no hotter than others.
    """
    text, known = F.coalesce("text", F.lit("")), F.col("doc_id").isNotNull()
    mask = reduce(add, (F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("text")))))
    own = docs.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), mask.alias("mask"))
    own = own.withColumn("spread", F.when(known, 0).otherwise(1 + F.pmod(F.xxhash64("copy", "part"), F.lit(SPREAD))))
    marks = labels.filter(known).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = own.join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").na.fill(0, ["good", "toxic"])
    ids = rows.groupBy("doc_id", "spread", "copy", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    first = F.min(F.when(known, F.struct("doc_id", "n")))
    classes = ids.groupBy("copy", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unknown"), first.alias("first"))
    least = classes.groupBy("copy").agg(F.min("first.doc_id").alias("least"))
    classes = classes.join(least, "copy")
    passing = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))
    each = classes.select("part", "good", "toxic", F.inline(split))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def zeta(counts: Column, filters: int) -> Column:
    """Sums over all subsets of each mask, for an array of 2 ** filters counts: entry m becomes the sum of the entries whose bits lie in m."""

    def summed(old: Column, bit: Column) -> Column:
        return F.transform(old, lambda x, m: F.when(m.bitwiseAND(bit) != 0, x + F.get(old, m - bit)).otherwise(x))

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(filters))), counts, summed)


def survivors(counted: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """(part, n, good, toxic): arrays by subset of filters, bit k for filter k: documents that every filter of the subset keeps.

    A part's masks are 2 ** filters rows at most, so an array of a part is bounded.
    """
    full, measures = (1 << filters) - 1, ("n", "good", "toxic")
    every = F.sequence(F.lit(0), F.lit(full))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures))))
    out = counted.groupBy("part").agg(by_mask.alias("by_mask"))

    def dense(c: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("by_mask", m)[c], F.lit(0).cast("long")))

    def kept(c: str) -> Column:
        return F.transform(every, lambda s: F.get(F.col(c), F.lit(full) - s))  # what no filter of s fails: masks within the others

    out = out.select("part", *(dense(c).alias(c) for c in measures))
    out = out.select("part", *(zeta(F.col(c), filters).alias(c) for c in measures))
    return out.select("part", *(kept(c).alias(c) for c in measures))


def audited(docs: DataFrame, labels: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step keeps, removes and finds gone; counts of documents."""
    n, full = len(names), (1 << len(names)) - 1
    orders = F.split(F.lit(",".join(map("".join, permutations(names)))), ",")
    rows = survivors(masks(docs, labels), n).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter_bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substring("filter_order", i, F.lit(1))) - 1)
    rows = rows.withColumn("bit", letter_bit(F.col("step"))).withColumn("before", F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda t, i: t.bitwiseOR(F.when(i > 0, letter_bit(i)).otherwise(0))))
    gone = lambda c, s: F.get(F.col(c), s) - F.get(F.col(c), s.bitwiseOR(F.col("bit")))
    # a filter comes right after the subset s in |s|! * (n - 1 - |s|)! orders
    share = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
    value = reduce(add, (F.when(F.lit(s).bitwiseAND(F.col("bit")) == 0, gone("n", F.lit(s)) * share(s)).otherwise(0) for s in range(full)))
    return rows.select(
        "part", "filter_order", "step", F.get("n", F.col("before").bitwiseOR(F.col("bit"))).alias("kept"), gone("n", F.col("before")).alias("removed"),
        (gone("n", F.lit(0)) - gone("n", F.col("before"))).alias("redundant"), gone("n", full - F.col("bit")).alias("unique_fails"),
        gone("good", F.col("before")).alias("good_lost"), gone("toxic", F.col("before")).alias("toxic_lost"), value.alias("shapley"),
    )


SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e
 FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
z AS (SELECT part, s::INT AS s, coalesce(sum(n) FILTER ((mask & s) = 0), 0) AS n, coalesce(sum(good) FILTER ((mask & s) = 0), 0) AS good, coalesce(sum(toxic) FILTER ((mask & s) = 0), 0) AS toxic FROM m, range(32) r(s) GROUP BY part, s),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
 coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS earlier FROM o, range(1, 6) r(step)),
y AS (SELECT u.part AS part, filter_order, step, bit, v.n AS kept, u.n - v.n AS removed, u.good - v.good AS good_lost, u.toxic - v.toxic AS toxic_lost
 FROM k JOIN z u ON u.s = earlier JOIN z v ON v.part = u.part AND v.s = earlier | bit),
h AS (SELECT part, bit, sum(removed) AS shapley FROM y GROUP BY part, bit),
g AS (SELECT u.part, u.s AS bit, w.n - u.n AS fails, v.n - q.n AS unique_fails FROM z u JOIN z w ON w.part = u.part AND w.s = 0 JOIN z v ON v.part = u.part AND v.s = 31 - u.s JOIN z q ON q.part = u.part AND q.s = 31 WHERE u.s IN (1, 2, 4, 8, 16))
SELECT y.part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley FROM y JOIN h USING (part, bit) JOIN g USING (part, bit)"""
