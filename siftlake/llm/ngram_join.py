"""N-gram Jaccard join (operator 10): size-banded tiles with hashed bitmap signatures.

1. Texts with one shingle set form a class; from here on a class stands for its documents, so copies cost one row.
2. Every class gives the prefix of its set under one order of shingles: frequent ones last, then by hash. Two sets that
   are similar enough share a shingle of their prefixes. Frequent shingles are those that over `heavy` sets hold among
   the first of their hash order; a set of at most 2 ** 20 of them is sent to the tasks (where more are, the bound rises
   to the first that keeps that). Which shingles count as frequent changes the work, never the result.
3. Classes that share a prefix shingle meet, except those that have no partner of a size that allows a link there. First
   each class meets one other of the shingle's classes, which gathers groups of near copies into components in linear
   work, and shingles of two classes are done. Then those still in different components meet pairwise, in tiles of one shingle, where each row meets the band of sizes around its own that the threshold allows,
   each pair at the first shingle that it shares there, if that is an early one. The rows of a shingle with more than
   BLOCK of them are dealt to blocks, and a tile holds two of these. `stars` turns gather, the first by stars, the others
   by FORESTS spanning forests of each tile's pairs, so that what leaves these turns is linear in the rows; the last turn
   lets every pair through that is left.
4. The meeting itself lets a pair through only if two upper bounds on the overlap allow a link: from the shingle's places
   in the two prefixes (what stands before it can't be shared where it is the first that is), and from bitmap
   signatures of 64 * WORDS bits (a set bit of one that the other lacks is a shingle less). Pairwise, the signatures are
   of 64 * WIDE bits and another 64 * TWICE for the places of the first that two shingles have, so that shingles that
   share a bit are counted too; tiles compare them in arrays.
5. Only classes of a pair that passed get their whole set read from their text; what passes the wide signature too is
   intersected exactly on the sorted arrays, and links become components.

What is written grows with the prefixes: signatures join the shingles that two classes share at least, not all, and whole
sets exist only for classes of a turn's pairs, until these are verified.

A group of n unlinked classes with common shingles and a size in common is compared in n * n bit counts in step 3, though
hardly any of these pairs leaves it.

The prefix and the band are exact bounds, so no link is lost; shingles are 64-bit hashes, a set's key is 128 bits.

Defined cases: a null, empty or wordless text has 0 shingles and is its own component; rows with one set are linked,
also with one id; ids may repeat or be null: a component's id is the smallest id of its rows, null if it has none; a
row of no shingles keeps its own id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from .common import Staged, by_batch, checkpointed, same_each_read
from .hashing import shingles


#: So many prefix lengths of each set are counted to find the frequent shingles.
COUNTED = 3
#: Longs of a signature that goes with each shared shingle, and of the one that goes with those left for the pairwise turn; the first is the second, folded. Longs of what follows the second: which of its bits, folded, two shingles have.
WORDS, WIDE, TWICE = 8, 32, 16
#: At most so many frequent shingles are sent to the tasks.
FREQUENT = 1 << 20
#: So many edge-disjoint spanning forests of its pairs leave a tile in a turn that gathers.
FORESTS = 3
#: So many rows of one shingle meet in one tile; more are dealt to blocks. A tile's pairs are compared so many at a time.
BLOCK, AT_ONCE = 2048, 1 << 14
#: So many wanted rows are sent to the tasks that read the texts; more are joined by a shuffle.
SENT = 1 << 18
#: Classes are gathered in so many rounds by key, and their shingles meet in so many by shingle: what a round shuffles is gone before the next.
GATHERED, ROUNDS = 2, 4
#: So many of a class's first shared shingles keep a pair from leaving the pairwise turn again at a later one.
FIRST = 8


def key_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def signature(found: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * WIDE bits and one of 64 * TWICE, as longs."""
    held = np.bincount(((found >> np.uint64(40)) % np.uint64(64 * WIDE)).astype(np.int64), minlength=64 * WIDE)
    twice = (held > 1).reshape(-1, 64 * TWICE).any(0)
    return np.packbits(np.concatenate([held > 0, twice]), bitorder="little").view(np.int64)


def folded(wide: str, k: int) -> Column:
    """Long k of the signature of WORDS longs, from the one of WIDE."""
    out = F.get(wide, F.lit(k))
    for j in range(k + WORDS, WIDE, WORDS):
        out = out.bitwiseOR(F.get(wide, F.lit(j)))
    return out


def upper(found: np.ndarray) -> np.ndarray:
    """The upper halves of hashes, as ints: what frequent shingles are told by."""
    return (found >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, row, key, size, prefix, more, wide, hidden, hidden_wide) of every row (id, row, text); more: the upper halves of the shingles after the prefix that are counted too; hidden: how many shingles the signature of WORDS longs and the whole one don't show."""

    def run(x: dict) -> dict:
        out = {"id": x["id"], "row": x["row"], "key": [], "size": [], "prefix": [], "more": [], "wide": [], "hidden": [], "hidden_wide": []}
        for text in x["text"]:
            s = shingles(text, n)
            out["key"].append(key_of(s))
            out["size"].append(len(s))
            p = prefix_length(len(s), num, den) if len(s) else 0
            out["prefix"].append(s[:p].view(np.int64))
            out["more"].append(upper(s[p : COUNTED * p]))
            wide = signature(s)
            out["wide"].append(wide)
            for name, words in (("hidden", np.bitwise_or.reduce(wide[:WIDE].reshape(-1, WORDS))), ("hidden_wide", wide)):
                out[name].append(len(s) - int(np.bitwise_count(words.view(np.uint64)).sum()))
        return out

    kind = dict(docs.dtypes)["id"]
    return by_batch(docs.select("id", "row", "text"), f"id {kind}, row long, key binary, size long, prefix array<long>, more array<int>, wide array<long>, hidden long, hidden_wide long", run, binary=("text",))


def reordered(docs: DataFrame, heavy, n: int, num: int, den: int) -> DataFrame:
    """(key, prefix) of the rows whose prefix changes when heavy shingles come last. heavy: a broadcast of the sorted upper halves of their hashes."""

    def run(x: dict) -> dict:
        out: dict = {"key": [], "prefix": []}
        for text in x["text"]:
            s = shingles(text, n)
            p = prefix_length(len(s), num, den)
            half = upper(s)
            at = np.searchsorted(heavy.value, half)
            at[at == len(heavy.value)] = 0
            late = heavy.value[at] == half
            if len(s) and late[:p].any():
                out["key"].append(key_of(s))
                out["prefix"].append(np.concatenate([s[~late], s[late]])[:p].view(np.int64))
        return out

    return by_batch(docs.select("text"), "key binary, prefix array<long>", run, binary=("text",))


def frequent(counts: DataFrame) -> DataFrame:
    """(token) of the shingles (token, n) that occur most, FREQUENT at most: all over the least n that keeps that."""
    room, bound = FREQUENT, 0
    for n, tokens in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        room -= tokens
        if room < 0:
            bound = n
            break
    return counts.filter(F.col("n") > bound).select("token")


def lacking(x: list[Column], y: list[Column]) -> Column:
    """How many set bits of signature x signature y lacks: shingles that its set lacks at least."""
    return sum((F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in zip(x, y, strict=True)), F.lit(0))


def fits(a: str, b: str, num: int, den: int) -> Column:
    """Whether rows a and b of one shingle (size, place, hidden, sign0, sign1, ...) may be linked, by their sizes, the places in their prefixes and their signatures.

    hidden: the shingles that the set's signature doesn't show, size less the bits set. Each bound stands once in a comparison, so that it is computed once a pair.
    """
    size = [F.col(f"{x}size") for x in (a, b)]
    left = F.least(*(F.col(f"{x}size") - F.col(f"{x}place") for x in (a, b)))
    both = reduce(Column.__add__, (F.bit_count(F.col(f"{a}sign{k}").bitwiseAND(F.col(f"{b}sign{k}"))) for k in range(WORDS)))
    enough = lambda most: (num + den) * most >= num * (size[0] + size[1])
    return (den * F.least(*size) >= num * F.greatest(*size)) & enough(left) & enough(F.least(f"{a}hidden", f"{b}hidden") + both)


def shingle_sets(wanted: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(cid, size, wide, found): size, wide signature and sorted shingle set of each class of wanted (cid, row), from the whole text of one row of it."""

    def run(x: dict) -> dict:
        sets = [shingles(t, n) for t in x["text"]]
        return {"cid": x["cid"], "size": [len(s) for s in sets], "wide": [signature(s) for s in sets], "found": [np.sort(s.view(np.int64)).tobytes() for s in sets]}

    return by_batch(docs.select("row", "text").join(wanted, "row").select("cid", "text"), "cid long, size long, wide array<long>, found binary", run, binary=("text",))


def fitting(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their wide signatures allow to be linked."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("cid").alias(x), F.col("size").alias(f"size_{x}"), F.col("wide").alias(f"wide_{x}")), x)
    wide = {x: [F.get(f"wide_{x}", F.lit(k)) for k in range(WIDE + TWICE)] for x in "ab"}
    most = F.least(F.col("size_a") - lacking(wide["a"], wide["b"]), F.col("size_b") - lacking(wide["b"], wide["a"]))
    return pairs.filter(den * most >= num * (F.col("size_a") + F.col("size_b") - most)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs (a, b) that their sorted shingle sets link."""
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("found").alias("y")), "b").join(sets.select(F.col("cid").alias("a"), F.col("found").alias("x")), "a")

    def check(x: dict) -> dict:
        linked = []
        for p, q in zip(x["x"], x["y"], strict=True):
            p, q = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            same = int((q[at] == p).sum())
            linked.append(den * same >= num * (len(p) + len(q) - same))
        return {k: [v for v, is_linked in zip(x[k], linked, strict=True) if is_linked] for k in "ab"}

    return by_batch(both.select("a", "b", "x", "y"), "a long, b long", check)


def linked_classes(docs: DataFrame, *, id_col: str, text_col: str, n: int, num: int, den: int, heavy: int, stars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, key, size), classes (cid, key, size) and the components (node, component) of linked classes."""
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "ngrams")
    docs = same_each_read(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), staged).withColumn("row", F.monotonically_increasing_id())
    rows = staged.write(sketches(docs, n, num, den), "sketches")
    members = staged.write(rows.select("id", "key", "size"), "members")
    parts = []
    for k in range(GATHERED):
        part = rows.filter((F.col("size") > 0) & (F.pmod(F.xxhash64("key"), F.lit(GATHERED)) == k)).groupBy("key")
        part = part.agg(*(F.min_by(c, "row").alias(c) for c in ("size", "prefix", "more", "wide", "hidden", "hidden_wide")), F.min("row").alias("row"))
        parts.append(staged.write(part.withColumn("cid", F.monotonically_increasing_id() * GATHERED + k), f"classes-{k}"))
    classes = reduce(DataFrame.unionAll, parts)
    staged.drop("sketches")
    half = classes.select(F.explode("prefix").alias("token")).select(F.shiftright("token", 32).cast("int").alias("token"))
    counts = half.unionAll(classes.select(F.explode("more").alias("token"))).groupBy("token").agg(F.count("*").alias("n"))
    often = frequent(staged.write(counts.filter(F.col("n") > heavy), "counts")).toArrow().column(0).to_numpy()
    staged.drop("counts")
    short, lists = classes.select("cid", "key", "size", "prefix"), classes.select("cid", "size", "prefix")
    if len(often):
        sent = spark.sparkContext.broadcast(np.sort(often))
        changed = staged.write(reordered(docs, sent, n, num, den).groupBy("key").agg(F.first("prefix").alias("prefix")), "changed")
        lists = short.join(changed.withColumnRenamed("prefix", "other"), "key", "left").select("cid", "size", F.coalesce("other", "prefix").alias("prefix"))
        lists = staged.write(lists, "lists")
        staged.drop("changed")
    tokens = lists.select("cid", "size", F.posexplode("prefix").alias("place", "token"))
    parts = [staged.write(meeting(tokens.filter(F.pmod("token", F.lit(ROUNDS)) == k), num, den), f"met-{k}") for k in range(ROUNDS)]
    staged.drop("lists")
    facts = classes.select("cid", "hidden", *(folded("wide", k).alias(f"sign{k}") for k in range(WORDS)))
    met = staged.write(reduce(DataFrame.unionAll, parts).join(facts, "cid"), "met")
    wides = staged.write(classes.select("cid", "wide", F.col("hidden_wide").alias("hidden")).join(met.select("cid").distinct(), "cid", "left_semi"), "wides")
    classes = staged.write(classes.select("cid", "key", "size", "row"), "slim")
    for name in (*(f"classes-{k}" for k in range(GATHERED)), *(f"met-{k}" for k in range(ROUNDS))):  # what they hold of prefixes and signatures is in `met` and `wides`
        staged.drop(name)

    row = ["cid", "size", "component", "place", "hidden", *(f"sign{k}" for k in range(WORDS))]
    linked, found = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, component long")
    tested = linked
    for turn in range(stars + 1):  # the last one lets all pairs through
        placed = met.join(found, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid")).select("token", *row)
        by_star, gathers = turn == 0 < stars, turn < stars
        pairs = pivoted(placed, row, turn, num, den) if by_star else tiles(placed, wides, num, den, FORESTS if gathers else 0)
        if turn:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged.write(pairs, f"pairs-{turn}")
        if not turn:  # where two classes share a shingle, that was their only pair
            met = met.filter("n > 2")
        if pairs.isEmpty():
            continue
        tested = tested.unionAll(pairs)
        wanted = staged.write(classes.select("cid", "row").join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi"), f"wanted-{turn}")
        sets = staged.write(shingle_sets(F.broadcast(wanted) if wanted.count() <= SENT else wanted, docs, n), f"sets-{turn}")
        if by_star:
            near = staged.write(fitting(pairs, sets, num, den), f"near-{turn}")
        else:
            near = pairs
        new = []
        for k in range(ROUNDS):  # a set goes with each of its pairs
            some = near.filter(F.pmod(F.xxhash64("a"), F.lit(ROUNDS)) == k)
            used = some.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
            held = sets.join(F.broadcast(used), "cid", "left_semi") if used.count() <= SENT else sets
            new.append(staged.write(verified(some, held, num, den), f"linked-{turn}-{k}"))
        staged.drop(f"sets-{turn}")
        new = reduce(DataFrame.unionAll, new)
        if not new.isEmpty():
            linked = linked.unionAll(new)
            found = connected_components(linked, "a", "b", checkpointed)
    for name in ("met", "wides", *(f"{x}-{k}" for k in range(stars + 1) for x in ("pairs", "wanted", "near")), *(f"linked-{x}-{k}" for x in range(stars + 1) for k in range(ROUNDS))):
        staged.drop(name)
    return members, classes.select("cid", "key", "size"), found


def meeting(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (token, cid, size, place, n) that share their shingle with one whose size allows a link, n such rows in all; of the others of a shingle the nearest sizes decide.

    A larger partner must also make up for what stands before the shingle, which can't be shared if this is the first shared one.
    The shingles are dealt out once, for the facts of each and for its rows: both sides of the join take the same columns.
    """
    left, dealt = F.col("size") - F.col("place"), tokens.repartition("token")
    shared = dealt.groupBy("token").agg(F.count("cid").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.min(left).alias("left"))
    shared = shared.filter((F.col("n") > 2) | ((F.col("n") == 2) & (den * F.col("left") >= num * (F.col("lo") + F.col("hi") - F.col("left")))))
    by_size = Window.partitionBy("token").orderBy("size")
    near = dealt.join(shared.select("token"), "token").withColumns({"below": F.lag("size").over(by_size), "above": F.lead("size").over(by_size)})
    near = near.filter((den * F.col("below") >= num * F.col("size")) | (den * left >= num * (F.col("above") + F.col("place"))))
    return near.withColumn("n", F.count("*").over(Window.partitionBy("token"))).filter("n > 1").select("token", "cid", "size", "place", "n")


def pivoted(rows: DataFrame, row: list[str], turn: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each class and one other of its shingle's classes, another one each turn; rows (token, *row)."""
    pivot = F.min_by(F.struct(*row), F.xxhash64("cid", F.lit(turn))).over(Window.partitionBy("token"))
    both = rows.withColumn("pivot", pivot).filter(F.col("component") != F.col("pivot.component"))
    both = both.select(*(F.col(c).alias(f"a_{c}") for c in row), *(F.col(f"pivot.{c}").alias(f"b_{c}") for c in row)).filter(fits("a_", "b_", num, den))
    return both.select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()


def tiles(rows: DataFrame, wides: DataFrame, num: int, den: int, forests: int) -> DataFrame:
    """Pairs (a, b) in different components that meet in a tile of one shingle, all or those of so many forests; rows (token, cid, size, component, place); wides (cid, wide, hidden).

    Of any such pair one at least is outside the shingle's main component, so the other members of that meet only these. A pair that
    shares one of the FIRST of both passes only at the first of these: its bound by places is the loosest there. The few others may
    pass at several shingles.
    """
    by_token, by_place = Window.partitionBy("token"), Window.partitionBy("cid").orderBy("place")
    rows = rows.select("token", "cid", "size", "component", "place").withColumns({
        "lo": F.min("component").over(by_token), "hi": F.max("component").over(by_token), "main": F.mode("component").over(by_token), "n": F.count("*").over(by_token),
    }).filter("lo <> hi").drop("lo", "hi")
    rows = rows.withColumn("early", F.when(F.row_number().over(by_place) <= FIRST, F.col("token")))
    rows = rows.withColumn("before", F.collect_list("early").over(by_place.rowsBetween(Window.unboundedPreceding, -1))).drop("early")
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(wides, "cid")
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least("block", k) * F.col("blocks") + F.greatest("block", k))
    rows = rows.select("token", F.explode(with_each).alias("tile"), "blocks", "block", "cid", "size", "component", "main", "place", "hidden", "before", "wide")
    rows = rows.repartition("token", "tile").sortWithinPartitions("token", "tile")
    return rows.mapInArrow(lambda batches: whole_tiles(batches, num, den, forests), "a long, b long").distinct()


def whole_tiles(batches: Iterator[pa.RecordBatch], num: int, den: int, forests: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of the tiles in batches of rows sorted by tile; a tile's rows may come in several batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch["token"].to_numpy(), batch["tile"].to_numpy()

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            for a, b in tile_pairs(pa.Table.from_batches(parts).combine_chunks(), num, den, forests):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        token, tile = ends(batch)
        start = int(np.argmax((token == token[-1]) & (tile == tile[-1])))
        if start or last not in (None, (token[-1], tile[-1])):
            yield from out([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        last = (token[-1], tile[-1])
    yield from out(held)


class Forests:
    """Edge-disjoint spanning forests of the edges offered so far: an edge goes to the first forest that doesn't connect its ends yet."""

    def __init__(self, nodes: int, forests: int):
        self.parents = [list(range(nodes)) for _ in range(forests)]
        self.last = np.arange(nodes)

    @staticmethod
    def root(parent: list[int], x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def taken(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The places of the edges (u, v) that go to a forest. What the last one connects, the others do too."""
        out = []
        for k in np.flatnonzero(self.last[u] != self.last[v]).tolist():
            for parent in self.parents:
                p, q = self.root(parent, int(u[k])), self.root(parent, int(v[k]))
                if p != q:
                    parent[p] = q
                    out.append(k)
                    break
        if out:
            self.last = np.array([self.root(self.parents[-1], x) for x in range(len(self.last))])
        return np.array(out, np.int64)


def tile_pairs(rows: pa.Table, num: int, den: int, forests: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays a and b of the pairs that whole tiles let through; with forests, the safest first, only those that go to one of so many."""
    x = {c: rows[c].to_numpy() for c in ("token", "tile", "blocks", "block", "cid", "size", "component", "main", "place", "hidden")}
    group = np.cumsum(np.concatenate([[0], (np.diff(x["token"]) != 0) | (np.diff(x["tile"]) != 0)]))
    order = np.lexsort((x["size"], group))
    x = {c: v[order] for c, v in x.items()}
    wide = rows["wide"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(order), -1)[order]
    thin = np.bitwise_or.reduce(wide[:, :WIDE].reshape(len(order), -1, WORDS), axis=1)
    lists = rows["before"].combine_chunks()
    n_before, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    before, there = np.zeros((len(order), FIRST), np.int64), np.arange(FIRST) < n_before[:, None]
    before[there] = values
    before, there = before[order], there[order]
    size, left, other = x["size"], x["size"] - x["place"], x["component"] != x["main"]
    hidden_thin = size - np.bitwise_count(thin).sum(1, dtype=np.int64)
    one_block = x["tile"] // x["blocks"] == x["tile"] % x["blocks"]
    key = (group << 40) + size  # sorted, as order keeps the groups in place
    mine = np.flatnonzero(other)
    low = np.searchsorted(key, (group[mine] << 40) + -(-num * size[mine] // den))
    high = np.searchsorted(key, (group[mine] << 40) + den * size[mine] // num, side="right")
    ends = np.cumsum(high - low)
    component = np.unique(x["component"], return_inverse=True)[1]
    grown = Forests(int(component.max()) + 1, forests) if forests else None

    def enough(most: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (num + den) * most >= num * (size[a] + size[b])

    def passing(bits: np.ndarray, hidden: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = enough(np.minimum(hidden[a], hidden[b]) + np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64), a, b)
        return a[fit], b[fit]

    for at in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        pair = np.arange(at, min(at + AT_ONCE, int(ends[-1])))
        k = np.searchsorted(ends, pair, side="right")
        a, b = mine[k], high[k] - (ends[k] - pair)
        fit = (x["component"][a] != x["component"][b]) & (~other[b] | (a < b)) & (one_block[a] | (x["block"][a] != x["block"][b])) & enough(np.minimum(left[a], left[b]), a, b)
        a, b = passing(thin, hidden_thin, a[fit], b[fit])
        a, b = passing(wide, x["hidden"], a, b)
        if len(a):
            met = ((before[a][:, :, None] == before[b][:, None, :]) & there[a][:, :, None] & there[b][:, None, :]).any((1, 2))
            a, b = a[~met], b[~met]
            if grown:
                most = np.minimum(x["hidden"][a], x["hidden"][b]) + np.bitwise_count(wide[a] & wide[b]).sum(1, dtype=np.int64)
                by_share = np.argsort(-most / (size[a] + size[b]), kind="stable")
                a, b = a[by_share], b[by_share]
                tree = grown.taken(component[a], component[b])
                a, b = a[tree], b[tree]
            a, b = x["cid"][a], x["cid"][b]
            yield np.minimum(a, b), np.maximum(a, b)


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100, heavy: int = 16, stars: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    members, classes, found = linked_classes(docs, id_col=id_col, text_col=text_col, n=n, num=num, den=den, heavy=heavy, stars=stars)
    by_class = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("key", F.coalesce("component", "cid").alias("component"))
    placed = members.join(by_class, "key", "left")
    least = placed.filter("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    return placed.join(least, "component", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
