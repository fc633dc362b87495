"""Duplicate groups, representatives, conflicts and curation of records.

Records carry `id`, `path_rank` (what is first), `sha` (content identity), `near` (near-duplicate key), `label` (null if
unresolved) and `source`. Groups may be of any size: nothing pairs the members of a group with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as e
from .checkpoints import checkpointed
from .components import connected_components

#: Bits of a text's fingerprint.
BITS = 60


def fingerprints(texts: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint) of rows (key, text): a bit is set where most of the distinct words of the whole text have it in their hash (the role of a perceptual hash for text).

    Texts without words get no row. Words are counted where they are read, a row a text is shuffled; equal keys must have equal texts.
    """
    words = texts.select(key, F.explode(e.text_words(F.col("text"))).alias("word")).select(key, e.word_bits(F.col("word")).alias("bits"))
    votes = words.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("bits", b).bitwiseAND(1)).alias(f"b{b}") for b in range(BITS)))
    bits = (F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(BITS))
    return votes.select(key, reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def paired(own: DataFrame) -> DataFrame:
    """The fingerprints of `own` (distinct) that hold two of four quarters of their bits in common with another one: near ones always do, as two bits spoil two quarters at most.

    Six rows each, whatever they hold in common; of a common value only the least and the greatest holder are kept, since a third one differs from one of them.
    """
    quarter = BITS // 4
    both = [((1 << quarter) - 1 << quarter * i) | ((1 << quarter) - 1 << quarter * j) for j in range(4) for i in range(j)]
    keys = F.array(*(F.struct(F.lit(k).alias("which"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("held")) for k, m in enumerate(both)))
    named = own.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.*")
    shared = named.groupBy("which", "held").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).filter("lo <> hi").select("which", "held")
    return named.join(shared, ["which", "held"], "left_semi").select("fingerprint").distinct()


def near_classes(prints: DataFrame) -> DataFrame:
    """(fingerprint, near) of the fingerprints that another one is near, directly or through others: `near` is the least of them. Two are near if they differ in two bits at most.

    No pairs are made: each fingerprint names itself and its 60 neighbours at one bit, and two are near exactly if they name one value in
    common, so a value is named by 61 at most, however many rows share a fingerprint. Only those of `paired` do, as others are near none.
    """
    own = checkpointed(paired(prints.select("fingerprint").distinct()))
    flips = F.array(F.col("fingerprint"), *(F.col("fingerprint").bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(BITS)))
    named = own.select("fingerprint", F.explode(flips).alias("named"))
    stars = named.groupBy("named").agg(F.collect_set("fingerprint").alias("who")).filter(F.size("who") > 1)  # 61 at most
    edges = stars.select(F.array_min("who").alias("least"), F.explode("who").alias("fingerprint")).filter("least <> fingerprint").distinct()
    return connected_components(edges, "fingerprint", "least", checkpointed).select(F.col("node").alias("fingerprint"), F.col("component").alias("near"))


def ranked_keys(rows: DataFrame, key: str, prefix: str, least: int = 1) -> DataFrame:
    """(key, group): `prefix` and the 0-based rank of each distinct key; groups under `least` members are null.

    Distinct keys are range-partitioned and numbered by partition offsets, so that no task sees them all. The partitioned
    keys are written once: offsets and ranks must come from the same ranges, and a range partitioning that is made anew
    samples its bounds anew.
    """
    keys = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("members"))
    part = checkpointed(keys.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id()))
    counts = part.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = part.join(F.broadcast(offsets.select("part", "before")), "part")  # a row for each partition
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return own.select(key, F.when(F.col("members") >= least, F.concat(F.lit(prefix), rank.cast("string"))).alias("group"), "members")


def representatives(rows: DataFrame, key: str = "sha", eligible: Column | None = None) -> DataFrame:
    """Rows with `representative`: the first eligible id of their key (J04). A grouped minimum joined back, so hot keys are combined early."""
    first = rows.filter(eligible if eligible is not None else F.lit(True)).groupBy(key).agg(F.min_by("id", "path_rank").alias("representative"))
    return rows.join(first, key, "left")


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """Each further member of an exact group with its representative, and each further exact class of a near group with the near group's first.

    Members of a class are tied to one representative instead of all pairs; every pair of the group follows from these rows.
    """
    exact = representatives(rows).filter("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit("exact").alias("kind"))
    classes = rows.groupBy("near", "sha").agg(F.min_by("id", "path_rank").alias("id"), F.min("path_rank").alias("path_rank"))
    near = representatives(classes, "near").filter("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit("near").alias("kind"))
    label = rows.select("id", "label")
    pairs = exact.unionAll(near).join(label.withColumnsRenamed({"id": "a", "label": "label_a"}), "a").join(label.withColumnsRenamed({"id": "b", "label": "label_b"}), "b")
    return pairs.select("a", "b", "kind", e.label_relation(F.col("label_a"), F.col("label_b")).alias("relation"))


def label_conflicts(rows: DataFrame, key: str = "near") -> DataFrame:
    """Groups whose members hold more than one label, with their sizes."""
    return rows.groupBy(key).agg(F.count("*").alias("members"), F.count_distinct("label").alias("labels")).filter("labels > 1")


def curated(rows: DataFrame) -> DataFrame:
    """Rows with `reason` of exclusion ('' if included) and `representative` among eligible rows."""
    conflict = label_conflicts(rows).select("near", F.lit(True).alias("conflict"))
    rows = rows.join(conflict, "near", "left")
    reason = e.first_reason((F.col("sha").isNull(), "CORRUPT"), (F.col("label").isNull(), "LABEL_UNRESOLVED"), (F.coalesce("conflict", F.lit(False)), "LABEL_CONFLICT_GROUP"))
    rows = rows.withColumn("label_reason", reason)
    rows = representatives(rows, eligible=F.col("label_reason") == "")
    return rows.withColumn("reason", F.when((F.col("label_reason") == "") & (F.col("id") != F.col("representative")), "EXACT_DUPLICATE").otherwise(F.col("label_reason")))


def dedup_actions(rows: DataFrame) -> DataFrame:
    """(id, action): what to do with each row; the representative is the first row whether or not its label is resolved."""
    groups = label_conflicts(rows).select("near", F.lit(True).alias("conflict"))
    sizes = rows.groupBy("near").agg(F.count("*").alias("members"))
    full = representatives(rows).join(groups, "near", "left").join(sizes, "near")
    return full.select("id", F.when(F.col("sha").isNull(), "CORRUPT").when(F.coalesce("conflict", F.lit(False)) & F.col("label").isNull(), "REVIEW_LABEL_CONFLICT").when(F.coalesce("conflict", F.lit(False)), "EXCLUDE_LABEL_CONFLICT").when(F.col("id") != F.col("representative"), "DROP_EXACT_DUPLICATE").when(F.col("members") > 1, "KEEP_GROUPED").otherwise("KEEP").alias("action"))


def _bands(most: int, bits: int):
    """How many bands the bits are cut into for pairs within `most`, and a function of a hash and a band's number that gives its bits."""
    m = most // 3 + 1
    edges = [round(k * bits / m) for k in range(m + 1)]
    return m, lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)


def named_values(classes: DataFrame, most: int = 8, bits: int = 63) -> DataFrame:
    """(hash, n, named) of rows (hash, n): for each band a value for its bits and for each of its neighbours at one bit."""
    m, band = _bands(most, bits)
    widths = [round((k + 1) * bits / m) - round(k * bits / m) for k in range(m)]
    named = [band(F.col("hash"), k).bitwiseXOR(F.lit(turned)) * m + k for k in range(m) for turned in (0, *(1 << b for b in range(widths[k])))]
    return classes.select("hash", "n", F.explode(F.array(*named)).alias("named"))


def hamming_histogram(hashes: DataFrame, most: int = 8, bits: int = 63) -> DataFrame:
    """(distance, pairs) for 0..most over all pairs of rows (id, hash), J03.

    Equal hashes are counted as classes. Of most // 3 + 1 bands of the bits, two hashes within `most` differ in two bits of one at most,
    so each class names, band by band, its bits and its neighbours at one bit, and such a pair names one value in common. It counts in its
    first such band only, at the value that is the smaller hash's with the lowest differing bit turned.
    """
    classes = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    m, band = _bands(most, bits)
    parts = named_values(classes, most, bits)
    a, b = (parts.select("named", F.col("hash").alias(f"hash_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    apart = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    here, counts = F.col("named") % m, F.lit(False)
    for k in reversed(range(m)):
        x = band(apart, k)
        value = band(F.col("hash_a"), k).bitwiseXOR(x.bitwiseAND(-x)) * m + k
        counts = F.when(F.bit_count(x) <= 2, (here == k) & (F.col("named") == value)).otherwise(counts)
    pairs = a.join(b, "named").filter((F.col("hash_a") < F.col("hash_b")) & (F.bit_count(apart) <= most) & counts)
    near = pairs.select(e.hamming(F.col("hash_a"), F.col("hash_b")).alias("distance"), (F.col("n_a") * F.col("n_b")).alias("pairs"))
    own = classes.select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("pairs"))
    counted = near.unionAll(own).groupBy("distance").agg(F.sum("pairs").alias("pairs"))
    dim = hashes.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("distance"))
    return dim.join(counted, "distance", "left").select("distance", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"))


def leakage_flags_of(rows: DataFrame) -> DataFrame:
    """(id, flags): the flags of each row's group, `;`-joined in this order: exact (its content stands twice), near (one near key, more contents), cross_source."""
    shas = rows.groupBy("sha").agg(F.count("*").alias("copies"))
    near = rows.groupBy("near").agg((F.min("sha") < F.max("sha")).alias("is_near"), (F.min("source") < F.max("source")).alias("is_cross"))
    flags = F.concat_ws(";", F.when(F.col("copies") > 1, "exact"), F.when(F.col("is_near"), "near"), F.when(F.col("is_cross"), "cross_source"))
    return rows.select("id", "sha", "near").join(shas, "sha").join(near, "near").select("id", flags.alias("flags"))


def representative_samples(rows: DataFrame) -> DataFrame:
    """(name, id): the first row by id of each label, then of each source (F07). Grouped minima, so hot values are combined early."""
    first = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias("id")).select(F.concat_ws(":", F.lit(c), F.col(c)).alias("name"), "id")
    return first("label").unionAll(first("source"))
