"""Registry of the library's queries on the driver's tables, and of the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as e
from .operators import audit, dedup, evaluation, guards, isolation, metrics, reports, runs, splits, suites
from .operators.checkpoints import checkpointed, shared_dir
from .operators.components import connected_components
from .sources import includes, outputs, probes
from .streaming import run_states as states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL of the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: id, path_rank, sha, near, label, source, lang, n_chars. Written once, narrow: the queries read them in several branches.

    `near` names the group of near texts by their fingerprints; a text without words is near its exact copies alone.
    """
    label = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")))
    docs = table(spark, d, "documents")
    prints = dedup.fingerprints(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = docs.select(F.col("doc_id").alias("id"), e.sha256_hex(F.col("text")).alias("sha"), "source", "lang", "n_chars").join(prints, "id", "left")
    rows = checkpointed(rows.join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id", "left").select("id", "sha", "fingerprint", label.alias("label"), "source", "lang", "n_chars"))
    near = F.coalesce(F.concat(F.lit("n"), F.coalesce("near", "fingerprint").cast("string")), "sha")
    classes = dedup.near_classes(rows.filter("fingerprint is not null"))
    return checkpointed(rows.join(classes, "fingerprint", "left").select("id", F.col("id").alias("path_rank"), "sha", near.alias("near"), "label", "source", "lang", "n_chars"))


_PRINT = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b} ELSE 0 END" for b in range(dedup.BITS))
RECORDS = rf"""WITH RECURSIVE words AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents),
prints AS (SELECT doc_id, ({_PRINT})::BIGINT AS fp FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM words) GROUP BY doc_id),
fps AS (SELECT DISTINCT fp FROM prints),
close AS (SELECT a.fp AS u, b.fp AS v FROM fps a JOIN fps b ON bit_count(xor(a.fp, b.fp)) <= 2),
near_reach(u, v) AS (SELECT fp, fp FROM fps UNION SELECT r.u, c.v FROM near_reach r JOIN close c ON r.v = c.u),
near_of AS (SELECT u AS fp, min(v) AS near FROM near_reach GROUP BY u),
records AS (
 SELECT d.doc_id AS id, sha256(text) AS sha, source, lang, n_chars, coalesce('n' || near, sha256(text)) AS near,
  CASE WHEN quality IS NOT NULL THEN 'q' || quality || 't' || toxic END AS label
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN prints p ON p.doc_id = d.doc_id LEFT JOIN near_of USING (fp)),
conflicts AS (SELECT near, count(*) AS members, count(DISTINCT label) AS labels FROM records GROUP BY near HAVING count(DISTINCT label) > 1),
reasoned AS (SELECT r.*, CASE WHEN label IS NULL THEN 'LABEL_UNRESOLVED' WHEN c.near IS NOT NULL THEN 'LABEL_CONFLICT_GROUP' ELSE '' END AS label_reason, c.near IS NOT NULL AS conflict
 FROM records r LEFT JOIN conflicts c ON r.near = c.near),
reps AS (SELECT sha, min(id) AS representative FROM reasoned WHERE label_reason = '' GROUP BY sha),
clean AS (SELECT r.*, p.representative, CASE WHEN label_reason = '' AND id <> p.representative THEN 'EXACT_DUPLICATE' ELSE label_reason END AS reason FROM reasoned r LEFT JOIN reps p ON r.sha = p.sha)
"""


def near_groups(spark, d) -> DataFrame:
    return records(spark, d).withColumnRenamed("near", "group")


@query(RECORDS + "SELECT sha, count(*) AS members, min(id) AS first FROM records GROUP BY sha HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return records(spark, d).groupBy("sha").agg(F.count("*").alias("members"), F.min("id").alias("first")).filter("members > 1")


@query(RECORDS + "SELECT id, CASE WHEN n > 1 THEN 'x' || k END AS \"group\" FROM records r JOIN (SELECT sha, count(*) AS n, row_number() OVER (ORDER BY sha) - 1 AS k FROM records GROUP BY sha) g ON r.sha = g.sha")
def ranked_group_ids(spark, d):
    rows = records(spark, d).select("id", "sha")
    return rows.join(dedup.ranked_keys(rows, "sha", "x", least=2).select("sha", "group"), "sha").select("id", "group")


@query(RECORDS + ", first AS (SELECT sha, min(id) AS a FROM records GROUP BY sha), classes AS (SELECT near, sha, min(id) AS id FROM records GROUP BY near, sha), nf AS (SELECT near, min(id) AS a FROM classes GROUP BY near), p AS (SELECT a, id AS b, 'exact' AS kind FROM records JOIN first USING (sha) WHERE id <> a UNION ALL SELECT a, id, 'near' FROM classes JOIN nf USING (near) WHERE id <> a) SELECT a, b, kind, CASE WHEN x.label IS NULL OR y.label IS NULL THEN 'UNRESOLVED_LABEL' WHEN x.label = y.label THEN 'SAME_LABEL' ELSE 'LABEL_CONFLICT' END AS relation FROM p JOIN records x ON x.id = a JOIN records y ON y.id = b")
def duplicate_pairs(spark, d):
    return dedup.duplicate_pairs(records(spark, d))


@query(RECORDS + "SELECT id, representative FROM records JOIN (SELECT sha, min(id) AS representative FROM records GROUP BY sha) USING (sha)")
def exact_representatives(spark, d):
    return dedup.representatives(records(spark, d)).select("id", "representative")


@query(RECORDS + "SELECT id, reason, representative FROM clean")
def clean_manifest(spark, d):
    return dedup.curated(records(spark, d)).select("id", "reason", "representative")


@query(RECORDS + "SELECT source, reason, count(*) AS n FROM clean GROUP BY source, reason")
def clean_manifest_summary(spark, d):
    return dedup.curated(records(spark, d)).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(RECORDS + "SELECT source, reason, count(*) AS n, count(DISTINCT sha) AS contents FROM clean GROUP BY GROUPING SETS ((source, reason), (source), ())")
def dedup_summary_rollup(spark, d):
    return dedup.curated(records(spark, d)).rollup("source", "reason").agg(F.count("*").alias("n"), F.count_distinct("sha").alias("contents"))


def _parts(section: str, measure: str, part: str, where: str = "true") -> str:
    return f" UNION ALL SELECT '{section}', '{measure}', {part}, count(*) FROM clean WHERE {where} GROUP BY ALL"


SUMMARY = (
    RECORDS + ", s AS (SELECT sha, count(*) AS n, min(source) < max(source) AS sources FROM clean GROUP BY sha), g AS (SELECT near, count(*) AS n, min(sha) < max(sha) AS contents, min(source) < max(source) AS sources, coalesce(min(label) < max(label), false) AS labels, count(*) FILTER (reason = '') AS kept FROM clean GROUP BY near) "
    "SELECT 'raw' AS section, 'total' AS measure, '' AS part, count(*)::BIGINT AS value FROM clean UNION ALL SELECT 'raw', 'corrupt', '', count(*) FILTER (sha IS NULL) FROM clean UNION ALL SELECT 'excluded', 'total', '', count(*) FILTER (reason <> '') FROM clean UNION ALL SELECT 'clean', 'total', '', count(*) FILTER (reason = '') FROM clean UNION ALL SELECT 'unresolved', 'awaiting_label', '', count(*) FILTER (label IS NULL) FROM clean"
    + _parts("raw", "per_source", "source") + _parts("raw", "per_label", "label", "label IS NOT NULL") + _parts("excluded", "by_reason", "reason", "reason <> ''") + _parts("excluded", "by_source_and_reason", "source || '|' || reason", "reason <> ''")
    + _parts("clean", "per_source", "source", "reason = ''") + _parts("clean", "per_label", "label", "reason = ''") + _parts("clean", "per_source_and_label", "source || '|' || label", "reason = ''")
    + " UNION ALL SELECT 'duplicates', 'exact_groups', '', count(*) FILTER (n > 1) FROM s UNION ALL SELECT 'duplicates', 'exact_groups_across_sources', '', count(*) FILTER (sources) FROM s UNION ALL SELECT 'duplicates', 'near_groups', '', count(*) FILTER (contents) FROM g UNION ALL SELECT 'duplicates', 'near_groups_across_sources', '', count(*) FILTER (contents AND sources) FROM g"
    " UNION ALL SELECT 'duplicates', 'conflicting_groups', '', count(*) FILTER (labels) FROM g UNION ALL SELECT 'duplicates', 'records_in_conflicting_groups', '', coalesce(sum(n) FILTER (labels), 0)::BIGINT FROM g UNION ALL SELECT 'clean', 'groups', '', count(*) FILTER (kept > 0) FROM g UNION ALL SELECT 'clean', 'groups_of_several', '', count(*) FILTER (kept > 1) FROM g UNION ALL SELECT 'clean', 'largest_group', '', max(kept) FROM g"
)


@query(SUMMARY)
def dedup_summary(spark, d):
    return reports.dedup_summary(dedup.curated(records(spark, d)))


@query(RECORDS + ", i AS (SELECT *, n_chars // 500 AS size FROM clean WHERE reason = ''), g AS (SELECT near, count(*) AS n, min(source) < max(source) AS across, bool_or(id % 10 = 0) AS specimens FROM i GROUP BY near), t AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM i GROUP BY label)), z AS (SELECT sum(n) AS n FROM (SELECT max(n) AS n FROM (SELECT size, count(*) AS n FROM i GROUP BY size, label) GROUP BY size)), o AS (SELECT sum(n) AS n FROM (SELECT max(n) AS n FROM (SELECT source, count(*) AS n FROM i GROUP BY source, label) GROUP BY source)), c AS (SELECT count(*) AS n FROM i) SELECT 'duplicates_within_a_source' AS check, count(*)::BIGINT AS groups, coalesce(sum(n), 0)::BIGINT AS records, (SELECT count(*) FROM clean WHERE reason = 'EXACT_DUPLICATE') AS excluded, NULL::DOUBLE AS bound, NULL::DOUBLE AS baseline FROM g WHERE n > 1 AND NOT across UNION ALL SELECT 'duplicates_across_sources', count(*), coalesce(sum(n), 0)::BIGINT, (SELECT count(*) FROM clean WHERE reason = 'LABEL_CONFLICT_GROUP'), NULL, NULL FROM g WHERE across UNION ALL SELECT 'same_specimen', count(*), coalesce(sum(n), 0)::BIGINT, 0, NULL, NULL FROM g WHERE specimens UNION ALL SELECT 'label_in_name', 0, count(*), 0, NULL, NULL FROM i WHERE source LIKE '%1' UNION ALL SELECT 'metadata', 0, count(*), 0, NULL, NULL FROM i WHERE n_chars % 2 = 0 UNION ALL SELECT 'size_shortcut', 0, c.n, 0, z.n::DOUBLE / c.n, t.n::DOUBLE / c.n FROM c, z, t UNION ALL SELECT 'source_shortcut', 0, c.n, 0, o.n::DOUBLE / c.n, t.n::DOUBLE / c.n FROM c, o, t")
def leakage_findings(spark, d):
    rows = dedup.curated(records(spark, d)).withColumns({"specimen": F.when(F.col("id") % 10 == 0, F.col("near")), "reveals": F.endswith("source", F.lit("1")), "metadata": F.col("n_chars") % 2 == 0, "size": F.expr("n_chars div 500")})
    return reports.written_with_findings(rows.select("id", "sha", "near", "label", "source", "reason", "specimen", "reveals", "metadata", "size"), f"{shared_dir(spark).rstrip('/')}/siftlake-clean-{uuid.uuid4().hex}")


@query("WITH r AS (SELECT doc_id AS path, lang AS label, source AS extension, (n_chars % 3)::VARCHAR AS mode, (n_chars // 1000)::VARCHAR AS size, sha256(text) AS sha, length(text) >= 20 AS readable FROM documents), f AS (SELECT 'class' AS measure, label AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'extension', extension, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'mode', mode, count(*) FROM r WHERE readable GROUP BY ALL UNION ALL SELECT 'size', size, count(*) FROM r WHERE readable GROUP BY ALL UNION ALL SELECT 'unreadable', path::VARCHAR, count(*) FROM r WHERE NOT readable GROUP BY ALL UNION ALL SELECT 'duplicate', sha || ' ' || min(path), count(*) FROM r GROUP BY sha HAVING count(*) > 1) SELECT * FROM f UNION ALL SELECT 'total', '', count(*) FROM r UNION ALL SELECT 'ok', '', (count(*) FILTER (measure IN ('duplicate', 'unreadable')) = 0)::BIGINT FROM f")
def content_audit(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("path"), F.col("lang").alias("label"), F.col("source").alias("extension"), (F.col("n_chars") % 3).alias("mode"), F.expr("n_chars div 1000").alias("size"), e.sha256_hex(F.col("text")).alias("sha"), (F.length("text") >= 20).alias("readable"))
    return reports.content_audit(rows)


@query(RECORDS + ", f AS (SELECT sha, min(id) AS a FROM records GROUP BY sha), s AS (SELECT near, count(*) AS m FROM records GROUP BY near) SELECT id, CASE WHEN conflict AND label IS NULL THEN 'REVIEW_LABEL_CONFLICT' WHEN conflict THEN 'EXCLUDE_LABEL_CONFLICT' WHEN id <> a THEN 'DROP_EXACT_DUPLICATE' WHEN m > 1 THEN 'KEEP_GROUPED' ELSE 'KEEP' END AS action FROM reasoned JOIN f USING (sha) JOIN s USING (near)")
def dedup_action(spark, d):
    return dedup.dedup_actions(records(spark, d))


@query(RECORDS + "SELECT near, members, labels FROM conflicts")
def label_conflict_groups(spark, d):
    return dedup.label_conflicts(records(spark, d))


@query("SELECT o_custkey AS customer, count(*) AS members, count(DISTINCT o_orderpriority) AS labels FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def label_conflicts_by_customer(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("label"))
    return dedup.label_conflicts(rows, "customer")


HASHES = "WITH h AS (SELECT vec_id, list_reduce(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN 1::BIGINT ELSE 0::BIGINT END), lambda t, b: t * 2 + b) AS h FROM embeddings)"


@query(HASHES + ", p AS (SELECT bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id) SELECT k::INT AS distance, count(p.distance)::BIGINT AS pairs FROM range(9) t(k) LEFT JOIN p ON p.distance = k GROUP BY k")
def hamming_histogram(spark, d):
    return dedup.hamming_histogram(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.difference_bits(F.col("embedding")).alias("hash")))


@query(HASHES + "SELECT vec_id, h AS hash FROM h")
def difference_hash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", e.difference_bits(F.col("embedding")).alias("hash"))


@query(RECORDS + ", keys AS (SELECT id, 's' || sha AS k FROM records UNION ALL SELECT id, 'n' || near FROM records), edges AS (SELECT DISTINCT a.id AS u, m.m AS v FROM keys a JOIN (SELECT k, min(id) AS m FROM keys GROUP BY k) m USING (k)), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), reach(u, v) AS (SELECT id, id FROM records UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u) SELECT u AS id, min(v) AS component FROM reach GROUP BY u")
def leakage_components(spark, d):
    rows = records(spark, d)
    keys = rows.select("id", F.concat(F.lit("s"), "sha").alias("k")).unionAll(rows.select("id", F.concat(F.lit("n"), "near")))
    edges = keys.join(keys.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "k").select("id", "least")
    found = connected_components(edges, "id", "least", checkpointed)
    return rows.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(RECORDS + ", a AS (SELECT sha, count(*) AS same FROM records GROUP BY sha), g AS (SELECT near, count(DISTINCT sha) AS c, count(DISTINCT source) AS s FROM records GROUP BY near) SELECT id, concat_ws(';', CASE WHEN same > 1 THEN 'exact_duplicate' END, CASE WHEN c > 1 THEN 'near_duplicate' END, CASE WHEN s > 1 THEN 'cross_dataset' END) AS flags FROM records JOIN a USING (sha) JOIN g USING (near)")
def leakage_flags(spark, d):
    return audit.leakage_flags(records(spark, d))


@query(RECORDS + ", a AS (SELECT sha, count(*) AS same FROM records GROUP BY sha), g AS (SELECT near, min(sha) < max(sha) AS c, min(source) < max(source) AS s FROM records GROUP BY near), n AS (SELECT *, replace(replace(lower(source || '_' || lang || CASE WHEN id % 7 = 0 THEN '-AUG' ELSE '' END), '_', ' '), '-', ' ') AS name FROM records) SELECT id, concat_ws(';', CASE WHEN same > 1 THEN 'exact_duplicate_group' END, CASE WHEN c THEN 'near_duplicate_group' END, CASE WHEN s THEN 'cross_dataset_group' END, CASE WHEN id % 10 = 0 THEN 'specimen_group' END, CASE WHEN contains(name, '1 de') OR contains(name, 'fr') THEN 'filename_reveals_label' END, CASE WHEN contains(name, 'aug') OR contains(name, 'flip') OR contains(name, 'rot') THEN 'pre_augmented_filename' END) AS flags FROM n JOIN a USING (sha) JOIN g USING (near)")
def record_flags(spark, d):
    name = F.concat_ws("_", "source", "lang")
    rows = records(spark, d).withColumns({"specimen": F.when(F.col("id") % 10 == 0, F.col("near")), "name": F.concat(name, F.when(F.col("id") % 7 == 0, "-AUG").otherwise(""))})
    return audit.record_flags(rows, ["1 de", "fr"])


@query("SELECT doc_id AS id, (list_position(['en', 'de', 'fr', 'es'], lang) - 1)::INT AS label FROM documents")
def declared_class_index(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), e.class_index(F.col("lang"), ["en", "de", "fr", "es"]).alias("label"))


@query(RECORDS + "SELECT members, count(*) AS groups FROM (SELECT near, count(*) AS members FROM records GROUP BY near) GROUP BY members")
def group_size_histogram(spark, d):
    return audit.group_sizes(records(spark, d), "near")


@query(RECORDS + ", g AS (SELECT near, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT label) AS l FROM records GROUP BY near) SELECT count(*) AS groups, count(*) FILTER (n > 1) AS multi, count(*) FILTER (s > 1) AS spanning, max(n) AS largest, count(*) FILTER (l > 1) AS mixed, count(*) FILTER (s = 1 AND n > 1) AS within_one FROM g")
def group_summary(spark, d):
    return audit.group_summary(records(spark, d), "near", "source", "label")


def _shortcut(feature: str) -> str:
    return f"{RECORDS}, c AS (SELECT {feature} AS f, lang, count(*) AS n FROM records GROUP BY 1, 2), b AS (SELECT f, max(n) AS best, sum(n) AS n FROM c GROUP BY f), m AS (SELECT sum(n) AS m FROM c GROUP BY lang) SELECT sum(best)::DOUBLE / sum(n)::DOUBLE AS bound, (SELECT max(m) FROM m)::DOUBLE / sum(n)::DOUBLE AS baseline, sum(n)::BIGINT AS n FROM b"


@query(_shortcut("source"))
def shortcut_source(spark, d):
    return audit.shortcut_bound(records(spark, d), F.col("source"), "lang")


@query(_shortcut("n_chars // 500"))
def shortcut_size(spark, d):
    return audit.shortcut_bound(records(spark, d), F.expr("n_chars div 500"), "lang")


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def class_source_crosstab(spark, d):
    return audit.crosstab(table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("WITH c AS (SELECT lang, n_chars // 100 AS value, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS rank FROM c) SELECT lang, value, n, rank::INT AS rank FROM r WHERE rank <= 4")
def top4_size_by_class(spark, d):
    return audit.most_common(table(spark, d, "documents"), "lang", F.expr("n_chars div 100"), 4, "doc_id")


@query("SELECT n_chars // 1000 AS size, min(source) AS source, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) = 1")
def single_source_classes(spark, d):
    return audit.single_source(table(spark, d, "documents").withColumn("size", F.expr("n_chars div 1000")), "size", "source")


@query("WITH t AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS size FROM documents GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS records, sum(size)::BIGINT AS total_size, string_agg(lang || '=' || n, '; ' ORDER BY lang || '=' || n) AS histogram FROM t GROUP BY source")
def inventory(spark, d):
    return audit.inventory(table(spark, d, "documents"), ["source"], size=F.col("n_chars"), tag="lang")


@query(r"SELECT page_id, array_to_string(list_filter(['blog', 'en', 'example net'], lambda t: contains(regexp_replace(lower(url), '[_\-.]+', ' ', 'g'), t)), ',') AS tokens FROM pages")
def filename_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(e.name_tokens(F.col("url"), ["blog", "en", "example net"]), ",").alias("tokens"))


@query(r"WITH t AS (SELECT starts_with(url, 'https') AS secure, len(list_filter(['blog', 'wiki'], lambda t: contains(regexp_replace(lower(url), '[_\-.]+', ' ', 'g'), t))) > 0 AS hit FROM pages) SELECT secure, count(*) AS records, count(*) FILTER (hit) AS with_token, round(100.0 * count(*) FILTER (hit) / count(*), 1)::DOUBLE AS percent FROM t GROUP BY secure")
def token_leakage(spark, d):
    pages = table(spark, d, "pages").withColumn("secure", F.startswith("url", F.lit("https")))
    return audit.token_leakage(pages, "secure", e.name_tokens(F.col("url"), ["blog", "wiki"])).withColumn("percent", F.col("percent").cast("double"))


@query(r"WITH t AS (SELECT starts_with(url, 'https') AS secure, url, contains(url, 'http') AS told, len(list_filter(['blog', 'wiki'], lambda t: contains(regexp_replace(lower(url), '[_\-.]+', ' ', 'g'), t))) > 0 AS hit FROM pages) SELECT secure, count(*) AS records, count(*) FILTER (hit) AS with_token, round(100.0 * count(*) FILTER (hit) / count(*), 1)::DOUBLE AS percent, bool_and(told) AS label_in_path, coalesce(array_to_string(list(url ORDER BY url) FILTER (hit)[1:3], '; '), '') AS examples FROM t GROUP BY secure")
def target_leakage(spark, d):
    pages = table(spark, d, "pages").withColumns({"secure": F.startswith("url", F.lit("https")), "label": F.lit("http")})
    return audit.target_leakage(pages, "secure", e.name_tokens(F.col("url"), ["blog", "wiki"]), "label", "url")


STRATA = RECORDS + ", c AS (SELECT near, source, count(*) AS n FROM records GROUP BY near, source), l AS (SELECT near, min(label) AS label FROM records GROUP BY near), w AS (SELECT near, source, row_number() OVER (PARTITION BY near ORDER BY n DESC, source) AS k FROM c), strata AS (SELECT near AS \"group\", coalesce(label, '') || '|' || source AS stratum FROM w JOIN l USING (near) WHERE k = 1)"


@query(STRATA + ' SELECT "group", stratum FROM strata')
def majority_source_stratum(spark, d):
    return splits.strata(near_groups(spark, d))


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT lang, part, n, n * ratio AS x FROM n, (VALUES (0, 0.7::DOUBLE), (1, 0.15::DOUBLE), (2, 0.15::DOUBLE)) v(part, ratio)), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x - floor(x) DESC, part) AS k, n - sum(floor(x)) OVER (PARTITION BY lang) AS spare FROM p) SELECT lang, part, (floor(x) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM q")
def largest_remainder_quota(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return splits.largest_remainder(counts, "lang", [0.7, 0.15, 0.15])


@query("WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('42:' || c_custkey), c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, c_nationkey, CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r")
def hash_split(spark, d):
    return splits.hash_split(table(spark, d, "customer"), "c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY sha256('42:' || c_custkey), c_custkey LIMIT 50")
def hash_sample(spark, d):
    return splits.hash_sample(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 50)


def _dealt(ratios: list[float]) -> str:
    """The groups in their order, each stratum dealt one group a step, then the groups of a size by the numbers that each part got."""
    k, quota = len(ratios), ", ".join(f"({i}, {r}::DOUBLE)" for i, r in enumerate(ratios))
    best = f"list_transform(range(1, {k + 1}), lambda i: (quota[i] - filled[i])::DOUBLE / greatest(quota[i], 1))"
    return STRATA + f""", sized AS (SELECT near AS g, count(*) AS n FROM records GROUP BY near),
o AS (SELECT stratum, g, n, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, sha256('42:' || g)) AS k, row_number() OVER (PARTITION BY stratum, n ORDER BY sha256('42:' || g)) AS r FROM sized JOIN strata ON "group" = g),
t AS (SELECT stratum, sum(n)::BIGINT AS n FROM o GROUP BY stratum), p AS (SELECT stratum, part, n, n * ratio AS x FROM t, (VALUES {quota}) v(part, ratio)),
q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY x - floor(x) DESC, part) AS k, n - sum(floor(x)) OVER (PARTITION BY stratum) AS spare FROM p),
quotas AS (SELECT stratum, list((floor(x) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT ORDER BY part) AS quota FROM q GROUP BY stratum),
steps(stratum, k, n, filled, best) AS (SELECT stratum, 0::BIGINT, 0::BIGINT, list_transform(range({k}), lambda i: 0::BIGINT), -1 FROM quotas UNION ALL
 SELECT stratum, k, n, list_transform(range(1, {k + 1}), lambda i: filled[i] + CASE WHEN i = best + 1 THEN n ELSE 0 END), best FROM (
  SELECT s.stratum, o.k, o.n, s.filled, (list_position({best}, list_max({best})) - 1)::INT AS best FROM steps s JOIN o ON o.stratum = s.stratum AND o.k = s.k + 1 JOIN quotas z ON z.stratum = s.stratum)),
got AS (SELECT stratum, n, best AS part, count(*) AS c FROM steps WHERE best >= 0 GROUP BY ALL), ends AS (SELECT *, sum(c) OVER (PARTITION BY stratum, n ORDER BY part) AS e FROM got),
dealt AS (SELECT g, min(part)::INT AS part FROM o JOIN ends USING (stratum, n) WHERE r <= e GROUP BY g)"""


@query(_dealt([0.8, 0.2]) + ' SELECT g AS "group", part FROM dealt')
def greedy_group_assignment(spark, d):
    return splits.assigned_groups(near_groups(spark, d), [0.8, 0.2])


def _folds(spark, d) -> DataFrame:
    rows = near_groups(spark, d)
    return rows.join(splits.assigned_groups(rows, [0.2] * 5), "group").withColumn("fold", F.col("part") + 1)


@query(_dealt([0.2] * 5) + ", f AS (SELECT part + 1 AS fold, coalesce(label, '') AS label, count(*) AS n FROM records JOIN dealt ON near = g GROUP BY ALL), v AS (SELECT fold, sum(n)::BIGINT AS validation, string_agg(label || '=' || n, '; ' ORDER BY label || '=' || n) AS labels FROM f GROUP BY fold) SELECT fold, validation, (sum(validation) OVER () - validation)::BIGINT AS train, labels FROM v")
def fold_report(spark, d):
    return splits.fold_report(_folds(spark, d))


@query("SELECT l_orderkey AS \"group\", count(DISTINCT l_returnflag) AS parts FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def straddling_groups(spark, d):
    return splits.straddling(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_returnflag").alias("part")))


@query("SELECT 'straddling_groups' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'rows_without_fold', 0 UNION ALL SELECT 'folds', 5")
def fold_members(spark, d):
    """Each record's fold by whole groups: no group in two folds, no record without one, five folds in use."""
    folds = checkpointed(_folds(spark, d).select("id", "group", "fold"))
    rule = lambda name, rows: rows.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    lost = records(spark, d).join(folds, "id", "left_anti")
    return rule("straddling_groups", splits.straddling(folds, "fold")).unionAll(rule("rows_without_fold", lost)).unionAll(rule("folds", folds.select("fold").distinct()))


@query("SELECT l_returnflag AS \"group\", row_number() OVER (ORDER BY l_returnflag) - 1 AS rank FROM (SELECT DISTINCT l_returnflag FROM lineitem) UNION ALL SELECT k, row_number() OVER (ORDER BY k) - 1 FROM (SELECT DISTINCT l_orderkey || '/' || l_linenumber AS k FROM lineitem)")
def ranked_many_keys(spark, d):
    rows = table(spark, d, "lineitem")
    many = dedup.ranked_keys(rows.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k")), "k", "")
    few = dedup.ranked_keys(rows.select(F.col("l_returnflag").alias("k")), "k", "")
    return few.unionAll(many).select(F.col("k").alias("group"), F.col("group").cast("long").alias("rank"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def mapped_labels(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    mapping = guards.mapped(nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), region.select("r_regionkey", "r_name"), ["r_regionkey"])
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return guards.mapped(rows, mapping.select("n_nationkey", "n_name", "r_name"), ["n_nationkey"]).select("c_custkey", "n_name", "r_name")


@query("SELECT 'mapped_without_target' AS rule, count(*) FILTER (n_regionkey < 3 AND n_name < 'C') AS violations FROM nation UNION ALL SELECT 'target_without_mapped', count(*) FILTER (n_regionkey >= 3 AND n_name >= 'C') FROM nation UNION ALL SELECT 'key_twice', count(*) FROM (SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) > 1) UNION ALL SELECT 'unknown_target', count(*) FROM nation WHERE n_name >= 'C' AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0)")
def mapping_table_rules(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", F.when(F.col("n_regionkey") < 3, "mapped").otherwise("excluded").alias("status"), F.when(F.col("n_name") >= "C", F.col("n_regionkey")).alias("target"))
    return guards.mapping_rules(rows, ["n_regionkey"], "target", table(spark, d, "region").filter("r_regionkey > 0").select("r_regionkey"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 + 1 = 2 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def forbidden_for_fold(spark, d):
    folds = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 + 1).alias("fold"))
    return guards.forbidden_ids(folds, 2, table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id")))


@query("SELECT c_custkey AS id, c_mktsegment AS label FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_files(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return guards.absent(rows, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id").select("id", "label")


@query("SELECT doc_id AS id, lang AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return guards.absent(rows, table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id").select("id", "label")


@query(RECORDS + "SELECT 'label:' || label AS name, min(id) AS id FROM records WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT 'source:' || source, min(id) FROM records WHERE source IS NOT NULL GROUP BY source")
def representative_samples(spark, d):
    return dedup.representative_samples(records(spark, d))


@query(RECORDS + "SELECT r.id, concat_ws(';', CASE WHEN s.copies > 1 THEN 'exact' END, CASE WHEN g.shas > 1 THEN 'near' END, CASE WHEN g.sources > 1 THEN 'cross_source' END) AS flags FROM records r JOIN (SELECT sha, count(*) AS copies FROM records GROUP BY sha) s ON r.sha = s.sha JOIN (SELECT near, count(DISTINCT sha) AS shas, count(DISTINCT source) AS sources FROM records GROUP BY near) g ON r.near = g.near")
def group_flags(spark, d):
    return dedup.leakage_flags_of(records(spark, d))


def _rules(**counts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, ({count})::BIGINT AS violations" for rule, count in counts.items())


def _twice(table: str, key: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL AND {where} GROUP BY {key} HAVING count(*) > 1)"


def _several(table: str, key: str, value: str, where: str = "true", least: str = "> 1") -> str:
    return f"SELECT count(*) FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL AND {where} GROUP BY {key} HAVING count(DISTINCT {value}) {least})"


def _where(table: str, test: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {test}"


def _k() -> Column:
    return F.col("o_orderkey")


@query("WITH r AS (SELECT o_orderkey - (o_orderkey % 97 = 0)::INT AS id, o_custkey || o_orderpriority AS sha, CASE WHEN o_orderkey % 31 > 0 THEN o_orderpriority END AS label, o_custkey AS grp, o_orderkey % 2 = 0 AS included, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 26 = 0 THEN 'EXACT' ELSE '' END WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'ODD' ELSE 'EXACT' END AS reason, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - o_orderkey % 10 END AS representative FROM orders) " + _rules(
    included_with_reason=_where("r", "included AND reason <> ''"), excluded_without_reason=_where("r", "NOT included AND reason = ''"), unknown_reason=_where("r", "NOT included AND reason NOT IN ('', 'EXACT')"), included_without_label=_where("r", "included AND label IS NULL"),
    representative_of_itself=_where("r", "representative = id"), id_twice=_twice("r", "id"), representative_unknown="SELECT count(DISTINCT representative) FROM r WHERE representative IS NOT NULL AND representative NOT IN (SELECT id FROM r)",
    included_content_twice=_twice("r", "sha", "included"), groups_of_several_labels=_several("r", "grp", "label", "included"),
))
def clean_rules(spark, d):
    reason = F.when(_k() % 2 == 0, F.when(_k() % 26 == 0, "EXACT").otherwise("")).when(_k() % 13 == 0, "").when(_k() % 17 == 0, "ODD").otherwise("EXACT")
    rows = table(spark, d, "orders").select((_k() - (_k() % 97 == 0).cast("int")).alias("id"), F.concat(F.col("o_custkey").cast("string"), "o_orderpriority").alias("sha"), F.when(_k() % 31 > 0, F.col("o_orderpriority")).alias("label"), F.col("o_custkey").alias("group"), (_k() % 2 == 0).alias("included"), reason.alias("reason"), F.when(_k() % 5 == 0, _k() - _k() % 10).alias("representative"))
    return suites.clean_rules(rows, ["EXACT"])


CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LABELLED = "o_orderkey - (o_orderkey % 97 = 0)::INT AS id, o_orderpriority AS class, (left(o_orderpriority, 1)::INT - 1 + (o_orderkey % 101 = 0)::INT)::INT AS label"


def _labelled(*more) -> list:
    return [(_k() - (_k() % 97 == 0).cast("int")).alias("id"), F.col("o_orderpriority").alias("class"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1 + (_k() % 101 == 0).cast("int")).alias("label"), *more]


_MISNAMED = "['" + "', '".join(CLASSES) + "'][label + 1] IS DISTINCT FROM class"


@query(f"WITH s AS (SELECT {_LABELLED}, o_orderkey // 3 AS grp, CASE WHEN o_orderpriority = '5-LOW' OR o_orderkey % 10 < 8 THEN 'development' WHEN o_orderkey % 10 = 8 THEN 'final_test' ELSE 'train' END AS part FROM orders WHERE o_orderkey % 7 > 0), c AS (SELECT o_orderkey AS id, o_orderkey % 11 > 0 AS included FROM orders), p AS (SELECT * FROM s WHERE part <> 'train') " + _rules(
    unknown_part=_where("s", "part = 'train'"), label_isnt_class=_where("s", _MISNAMED), id_twice=_twice("s", "id"), empty_parts="SELECT 2 - count(DISTINCT part) FROM p", classes_of_one_part=_several("p", "class", "part", least="= 1"), groups_in_both_parts=_several("s", "grp", "part"),
    included_rows_left_out="SELECT count(*) FROM (SELECT id FROM c WHERE included EXCEPT SELECT id FROM s)", rows_not_included="SELECT count(*) FROM (SELECT id FROM s EXCEPT SELECT id FROM c WHERE included)", excluded_rows="SELECT count(*) FROM (SELECT id FROM s INTERSECT SELECT id FROM c WHERE NOT included)",
))
def split_rules(spark, d):
    orders = table(spark, d, "orders")
    part = F.when((F.col("o_orderpriority") == "5-LOW") | (_k() % 10 < 8), "development").when(_k() % 10 == 8, "final_test").otherwise("train")
    rows = orders.filter(_k() % 7 > 0).select(*_labelled(F.expr("o_orderkey div 3").alias("group"), part.alias("split")))
    return suites.split_rules(rows, orders.select(_k().alias("id"), (_k() % 11 > 0).alias("included")), CLASSES)


@query(f"WITH r AS (SELECT {_LABELLED}, o_custkey AS grp, (o_custkey % 11 + (o_orderkey % 89 = 0)::INT)::INT AS fold FROM orders) " + _rules(
    fold_out_of_range=_where("r", "fold NOT BETWEEN 1 AND 13"), label_isnt_class=_where("r", _MISNAMED), id_twice=_twice("r", "id"), empty_folds="SELECT 13 - count(DISTINCT fold) FROM r WHERE fold BETWEEN 1 AND 13", groups_in_several_folds=_several("r", "grp", "fold"),
))
def fold_rules(spark, d):
    fold = (F.col("o_custkey") % 11 + (_k() % 89 == 0).cast("int")).cast("int")
    return suites.fold_rules(table(spark, d, "orders").select(*_labelled(F.col("o_custkey").alias("group"), fold.alias("fold"))), 13, CLASSES)


@query("WITH x AS (SELECT n_name AS model, f.k::INT AS fold, a.arm, n_nationkey AS n FROM nation, range(1, 5) f(k), (VALUES ('without_gan'), ('with_gan')) a(arm) WHERE n_nationkey < 12 AND n_nationkey * 10 + f.k <> 33), r AS (SELECT model || fold || CASE WHEN n = 5 THEN '' ELSE arm END AS id, CASE WHEN n = 6 THEN 'other' ELSE model END AS model, CASE WHEN n = 7 AND fold = 4 THEN 3 ELSE fold END AS fold, arm, 'fold_0' || fold || CASE WHEN arm = 'with_gan' AND n <> 8 THEN '_train_gan.csv' ELSE '_train.csv' END AS train, CASE WHEN n = 9 THEN 'm/final_test.csv' ELSE 'm/fold_0' || fold || '_validation.csv' END AS val, CASE WHEN n = 10 THEN 'DONE' ELSE 'PENDING' END AS status FROM x), k AS (SELECT * FROM r WHERE model <> 'other') " + _rules(
    off_the_axes=_where("r", "model = 'other'"), train_manifest_name=_where("r", "train <> 'fold_0' || fold || CASE WHEN arm = 'with_gan' THEN '_train_gan.csv' ELSE '_train.csv' END"), validation_manifest_name=_where("r", "val NOT LIKE '%/fold_0' || fold || '_validation.csv'"), final_test_as_manifest=_where("r", "val LIKE '%final_test%'"),
    unknown_status=_where("r", "status = 'DONE'"), id_twice=_twice("r", "id"), combination_twice="SELECT count(*) FROM (SELECT 1 FROM k GROUP BY model, fold, arm HAVING count(*) > 1)", combination_missing="SELECT 96 - count(*) FROM (SELECT DISTINCT model, fold, arm FROM k)",
    uneven_axis_values="SELECT (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY model HAVING count(*) <> 8)) + (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY fold HAVING count(*) <> 24)) + (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY arm HAVING count(*) <> 48))",
))
def matrix_rules(spark, d):
    n, fold, arm = F.col("n_nationkey"), F.col("fold"), F.col("arm")
    nation = table(spark, d, "nation").filter(n < 12)
    names = [r["n_name"] for r in nation.orderBy("n_nationkey").collect()]  # the matrix's models: twelve
    x = nation.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("fold")).filter(n * 10 + fold != 33).select("*", F.explode(F.array(F.lit("without_gan"), F.lit("with_gan"))).alias("arm"))
    file = lambda tail: F.concat(F.lit("fold_0"), fold.cast("string"), tail)
    rows = x.select(
        F.concat("n_name", fold.cast("string"), F.when(n == 5, "").otherwise(arm)).alias("experiment_id"), F.when(n == 6, "other").otherwise(F.col("n_name")).alias("model"), F.when((n == 7) & (fold == 4), 3).otherwise(fold).alias("fold"), "arm",
        file(F.when((arm == "with_gan") & (n != 8), "_train_gan.csv").otherwise("_train.csv")).alias("train_manifest"), F.when(n == 9, "m/final_test.csv").otherwise(F.concat(F.lit("m/"), file(F.lit("_validation.csv")))).alias("validation_manifest"), F.when(n == 10, "DONE").otherwise("PENDING").alias("status"),
    )
    return suites.matrix_rules(rows, names, 4)


@query("WITH r AS (SELECT page_id AS id, (page_id % 3 + 1)::INT AS fold, ['a', 'b', 'c', 'd'][page_id % 4 + 1] AS class, (page_id % 4 % 3)::INT AS label, 'gan/fold_0' || (page_id % 5 + 1) || CASE WHEN page_id % 9 = 0 THEN '/val/' ELSE '/train/' END || page_id AS path FROM pages), f AS (SELECT path FROM r WHERE id % 13 > 0) " + _rules(
    of_another_fold=_where("r", "fold <> 2"), unknown_class=_where("r", "class = 'd'"), label_isnt_class=_where("r", "['a', 'b', 'c'][label + 1] IS DISTINCT FROM class"), path_not_of_train=_where("r", "path LIKE '%/val/%'"), path_outside_fold=_where("r", "path NOT LIKE '%/fold_02/%'"),
    file_missing="SELECT count(*) FROM (SELECT path FROM r EXCEPT SELECT path FROM f)",
))
def synthetic_rules(spark, d):
    p = F.col("page_id")
    path = F.concat(F.lit("gan/fold_0"), (p % 5 + 1).cast("string"), F.when(p % 9 == 0, "/val/").otherwise("/train/"), p.cast("string"))
    rows = table(spark, d, "pages").select(p.alias("id"), (p % 3 + 1).cast("int").alias("fold"), F.get(F.array(*map(F.lit, "abcd")), (p % 4).cast("int")).alias("class"), (p % 4 % 3).cast("int").alias("label"), path.alias("path"))
    return suites.synthetic_rules(rows, rows.filter("id % 13 > 0").select("path"), 2, ["a", "b", "c"])


SPLIT = "split AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 7 THEN 'development' WHEN o_orderkey % 10 < 9 THEN 'final_test' END AS split FROM orders WHERE o_orderkey % 10 < 9)"


def _split(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("group"), F.col("o_orderstatus").alias("source"))
    part = F.when(F.col("id") % 10 < 7, "development").when(F.col("id") % 10 < 9, "final_test")
    return splits.with_split(rows, rows.filter(F.col("id") % 10 < 9).select("id", part.alias("split")))


@query("WITH " + SPLIT + " SELECT o_orderkey AS id, coalesce(split, '') AS split FROM orders LEFT JOIN split ON o_orderkey = id")
def split_of_all(spark, d):
    return _split(spark, d).select("id", "split")


@query("WITH " + SPLIT + " SELECT row_number() OVER (ORDER BY CASE split WHEN 'development' THEN 0 WHEN 'final_test' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) AS row, o_orderkey AS id, o_orderpriority AS label, coalesce(split, '') AS split FROM orders LEFT JOIN split ON o_orderkey = id")
def published_split(spark, d):
    """The split manifest, published in order with its digests, verified and read back with the place of each row over all files."""
    path = f"{shared_dir(spark).rstrip('/')}/siftlake-published-{uuid.uuid4().hex}"
    rows = _split(spark, d).select("id", "label", "split")
    outputs.publish(rows, path, [F.array_position(F.array(F.lit("development"), F.lit("final_test"), F.lit("")), F.col("split")), "label", "id"])
    outputs.verified(spark, path, rows.schema)
    back = outputs.numbered(outputs.placed(spark, path, rows.schema))
    return back.select(F.col("row").cast("long").alias("row"), "id", "label", F.coalesce("split", F.lit("")).alias("split"))


@query("WITH l AS (SELECT o_orderkey::VARCHAR AS filepath, o_custkey AS file_size FROM orders), m AS (SELECT o_orderkey::VARCHAR AS filepath, o_custkey + (o_orderkey % 3 = 0)::INT AS file_size, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT 'c' || c_custkey, 1, 'ok' FROM customer) SELECT coalesce(l.filepath, m.filepath) AS filepath, l.file_size, CASE WHEN l.filepath IS NULL THEN 'gone' WHEN l.file_size = m.file_size AND status <> 'pending' THEN 'reuse' ELSE 'read' END AS plan FROM l FULL JOIN m USING (filepath)")
def probe_plan(spark, d):
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    listed = orders.select(o.cast("string").alias("filepath"), F.col("o_custkey").alias("file_size"))
    status = F.when(o % 5 == 0, "pending").when(o % 7 == 0, "corrupt").otherwise("ok")
    old = orders.filter(o % 11 != 0).select(o.cast("string").alias("filepath"), (F.col("o_custkey") + (o % 3 == 0).cast("int")).alias("file_size"), status.alias("status"))
    gone = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("filepath"), F.lit(1).cast("long").alias("file_size"), F.lit("ok").alias("status"))
    return probes.planned(listed, old.unionByName(gone))


@query("WITH " + SPLIT + ", r AS (SELECT o_custkey AS g, o_orderpriority AS label, o_orderstatus AS source, coalesce(split, '') AS split FROM orders LEFT JOIN split ON o_orderkey = id) SELECT 'all' AS measure, '' AS value, split, count(*) AS rows, count(DISTINCT g) AS groups FROM r GROUP BY split UNION ALL SELECT 'label', label, split, count(*), count(DISTINCT g) FROM r GROUP BY label, split UNION ALL SELECT 'source', source, split, count(*), count(DISTINCT g) FROM r GROUP BY source, split")
def split_summary(spark, d):
    return splits.split_summary(_split(spark, d), ["label", "source"])


@query("WITH " + SPLIT + ", r AS (SELECT o_custkey AS g, o_orderpriority AS label, split = 'final_test' AS held, o_orderkey % 20 = 18 AS specimen FROM orders JOIN split ON o_orderkey = id), g AS (SELECT g, count(*) FILTER (held) AS held, count(*) AS n, bool_or(held AND specimen) AS specimen FROM r GROUP BY g) SELECT 'share_of_label' AS measure, label AS part, round(count(*) FILTER (held)::DOUBLE / count(*), 3) AS value FROM r GROUP BY label UNION ALL SELECT 'share', '', round(count(*) FILTER (held)::DOUBLE / count(*), 4) FROM r UNION ALL SELECT 'groups_straddling', '', (count(*) FILTER (held > 0 AND held < n))::DOUBLE FROM g UNION ALL SELECT 'largest_group_in_test', '', max(held)::DOUBLE FROM g UNION ALL SELECT 'specimen_groups_in_test', '', (count(*) FILTER (specimen))::DOUBLE FROM g")
def split_measures(spark, d):
    return splits.split_measures(_split(spark, d).withColumn("specimen", F.when(F.col("id") % 20 == 18, F.col("id").cast("string"))))


@query("WITH " + SPLIT + ", r AS (SELECT o_orderkey AS id, o_orderpriority AS label, coalesce(split, '') AS split FROM orders LEFT JOIN split ON o_orderkey = id), l AS (SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderpriority >= '2') SELECT 'empty' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS violations FROM r UNION ALL SELECT 'unknown_split', count(*) FILTER (split NOT IN ('development', 'final_test')) FROM r UNION ALL SELECT 'unknown_label', count(*) FROM r WHERE label NOT IN (SELECT label FROM l) UNION ALL SELECT 'id_twice', count(*) FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'label_missing_in_split', count(*) FROM (SELECT label, s FROM l, (VALUES ('development'), ('final_test')) t(s) EXCEPT SELECT label, split FROM r)")
def manifest_rules(spark, d):
    rows = _split(spark, d)
    return splits.manifest_rules(rows, ["development", "final_test"], rows.filter("label >= '2'").select("label"))


ISOLATION = """WITH o AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS grp, (o_orderkey % 5 + 1)::INT AS fold, o_orderpriority = '1-URGENT' AS synthetic, o_orderkey, o_custkey,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'data/gan/fold_0' || (CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 2 END) || '/train/' ELSE 'data/' || CASE WHEN o_orderkey % 101 = 0 THEN 'gan/' ELSE 'raw/' END END || o_orderkey AS path FROM orders),
t AS (SELECT * FROM o WHERE (fold <> 2 OR o_custkey % 7 = 0) AND o_orderkey % 11 <> 0), v AS (SELECT * FROM o WHERE (fold = 2 OR o_custkey % 13 = 0) AND o_orderkey % 11 <> 0), x AS (SELECT id FROM o WHERE o_orderkey % 11 = 0 OR o_orderkey % 97 = 0),
f AS (SELECT 'train_manifest_name' AS rule, NULL AS key WHERE false UNION ALL SELECT 'final_test_as_manifest', 'm/fold_02/fold_02_train_gan.csv m/final_test.csv' UNION ALL SELECT 'validation_manifest_name', 'm/final_test.csv'
 UNION ALL (SELECT 'ids_in_train_and_validation', id FROM t INTERSECT SELECT 'ids_in_train_and_validation', id FROM v) UNION ALL (SELECT 'ids_in_train_and_test', id FROM t INTERSECT SELECT 'ids_in_train_and_test', id FROM x) UNION ALL (SELECT 'ids_in_validation_and_test', id FROM v INTERSECT SELECT 'ids_in_validation_and_test', id FROM x)
 UNION ALL SELECT 'train_rows_of_the_fold', id FROM t WHERE NOT synthetic AND fold = 2 UNION ALL SELECT 'validation_rows_of_other_folds', id FROM v WHERE fold <> 2
 UNION ALL SELECT 'synthetic_outside_its_folder', id FROM t WHERE synthetic AND path NOT LIKE 'data/gan/fold_02/train/%' UNION ALL SELECT DISTINCT 'synthetic_ids_held_out', id FROM t WHERE synthetic AND id IN (SELECT id FROM v UNION SELECT id FROM x)
 UNION ALL SELECT 'validation_rows_synthetic', id FROM v WHERE synthetic OR path LIKE '%/gan/%' UNION ALL SELECT 'real_rows_in_generated_folder', id FROM t WHERE NOT synthetic AND path LIKE '%/gan/%'
 UNION ALL (SELECT 'groups_in_train_and_validation', grp FROM t WHERE NOT synthetic INTERSECT SELECT 'groups_in_train_and_validation', grp FROM v)) """


def _isolated(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as training, validation and test rows of fold 2 that break most rules."""
    o, made = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    place = F.when(made, F.concat(F.lit("data/gan/fold_0"), F.when(F.col("o_orderstatus") == "P", "3").otherwise("2"), F.lit("/train/"))).otherwise(F.when(o % 101 == 0, "data/gan/").otherwise("data/raw/"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", o.alias("id"), F.col("o_custkey").alias("group"), (o % 5 + 1).cast("int").alias("fold"), F.concat(place, o.cast("string")).alias("path"), made.alias("synthetic"))
    known = o % 11 != 0
    return rows.filter(((F.col("fold") != 2) | (F.col("o_custkey") % 7 == 0)) & known), rows.filter(((F.col("fold") == 2) | (F.col("o_custkey") % 13 == 0)) & known), rows.filter(~known | (o % 97 == 0))


@query(ISOLATION + ", n AS (SELECT unnest(['" + "', '".join([*isolation.manifest_rules(1, "with_gan", "", ""), *isolation.KEY_RULES, *isolation.ROW_RULES]) + "']) AS rule) SELECT n.rule, count(f.rule) AS violations, min(key) AS specimen FROM n LEFT JOIN f USING (rule) GROUP BY n.rule")
def isolation_suite(spark, d):
    return isolation.isolation_suite(*_isolated(spark, d), fold=2, arm="with_gan", train_path="m/fold_02/fold_02_train_gan.csv", validation_path="m/final_test.csv")


@query(ISOLATION + "SELECT 'train_rows' AS measure, count(*) AS value FROM t UNION ALL SELECT 'train_real', count(*) FILTER (NOT synthetic) FROM t UNION ALL SELECT 'train_synthetic', count(*) FILTER (synthetic) FROM t UNION ALL SELECT 'validation_rows', count(*) FROM v UNION ALL SELECT 'final_test_ids', count(DISTINCT id) FROM x")
def isolation_counts(spark, d):
    return isolation.isolation_counts(*_isolated(spark, d), fold=2, arm="with_gan")


@query("SELECT doc_id AS id, item_id AS item FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def isolation_guard(spark, d):
    docs, passages = table(spark, d, "documents"), table(spark, d, "benchmark")
    return guards.contaminated(docs.select(F.col("doc_id").alias("id"), "text"), passages.select(F.col("item_id").alias("id"), "text"))


@query(RECORDS + "SELECT 'reason_without_label' AS rule, count(*) FILTER (reason = '' AND label IS NULL) AS violations FROM clean UNION ALL SELECT 'representative_missing', count(*) FILTER (reason = 'EXACT_DUPLICATE' AND representative IS NULL) FROM clean UNION ALL SELECT 'self_representative', count(*) FILTER (reason = 'EXACT_DUPLICATE' AND representative = id) FROM clean UNION ALL SELECT 'unique_id', count(*) FROM (SELECT id FROM clean GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'unique_included_content', count(*) FROM (SELECT sha FROM clean WHERE reason = '' GROUP BY sha HAVING count(*) > 1)")
def constraint_suite(spark, d):
    rows = dedup.curated(records(spark, d))
    one = guards.row_rules(rows, {
        "reason_without_label": (F.col("reason") == "") & F.col("label").isNull(),
        "representative_missing": (F.col("reason") == "EXACT_DUPLICATE") & F.col("representative").isNull(),
        "self_representative": (F.col("reason") == "EXACT_DUPLICATE") & (F.col("representative") == F.col("id")),
    })
    return one.unionAll(guards.key_rules(rows, {"unique_id": ["id"]})).unionAll(guards.key_rules(rows.filter("reason = ''"), {"unique_included_content": ["sha"]}))


@query("SELECT 'orders_of_unknown_customers' AS rule, count(*) AS violations FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT 'customers_that_are_suppliers', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)")
def set_guards(spark, d):
    orders, customer, supplier = (table(spark, d, t) for t in ("orders", "customer", "supplier"))
    unknown = orders.select("o_custkey").distinct().join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    shared = customer.select(F.col("c_custkey").alias("k")), supplier.select(F.col("s_suppkey").alias("k"))
    return unknown.agg(F.lit("orders_of_unknown_customers").alias("rule"), F.count("*").alias("violations")).unionAll(guards.shared_rules({"customers_that_are_suppliers": (*shared, "k")}))


def predictions(spark, d) -> DataFrame:
    """Predictions from embeddings by rational arithmetic: class scores 1 + |x| over the first ten components, shares as probabilities."""
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: (F.floor(F.abs(x) * 1024) + 1).cast("long"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("label", F.lit(10)).alias("target"), scores.alias("s"))
    best = F.array_max("s")
    total = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select("id", "target", (F.array_position("s", best) - 1).cast("int").alias("predicted"), (best / total).alias("confidence"), F.transform("s", lambda x: x / total).alias("probs"))


PREDICTIONS = "WITH s AS (SELECT vec_id AS id, (label % 10)::INT AS target, list_transform(embedding[1:10], lambda x: (floor(abs(x::DOUBLE) * 1024) + 1)::BIGINT) AS s FROM embeddings), p AS (SELECT id, target, (list_position(s, list_max(s)) - 1)::INT AS predicted, list_max(s)::DOUBLE / list_sum(s)::DOUBLE AS confidence, list_transform(s, lambda x: x::DOUBLE / list_sum(s)::DOUBLE) AS probs FROM s), cells AS (SELECT t.k::INT AS target, q.k::INT AS predicted, count(p.id)::BIGINT AS n FROM range(10) t(k) CROSS JOIN range(10) q(k) LEFT JOIN p ON p.target = t.k AND p.predicted = q.k GROUP BY 1, 2), m AS (SELECT a.target, a.support, a.hits, g.guesses FROM (SELECT target, sum(n) AS support, sum(n) FILTER (target = predicted) AS hits FROM cells GROUP BY target) a JOIN (SELECT predicted, sum(n) AS guesses FROM cells GROUP BY predicted) g ON a.target = g.predicted), cm AS (SELECT target, CASE WHEN guesses = 0 THEN 0 ELSE hits::DOUBLE / guesses::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support::DOUBLE END AS recall, CASE WHEN support + guesses = 0 THEN 0 ELSE (2 * hits)::DOUBLE / (support + guesses)::DOUBLE END AS f1, support::BIGINT AS support, hits::BIGINT AS hits FROM m) "


@query(PREDICTIONS + "SELECT target, predicted, n FROM cells")
def confusion_long(spark, d):
    return metrics.confusion(predictions(spark, d), 10)


@query(PREDICTIONS + "SELECT target, " + ", ".join(f"sum(n) FILTER (predicted = {i})::BIGINT AS p{i}" for i in range(10)) + " FROM cells GROUP BY target")
def confusion_wide(spark, d):
    return metrics.confusion_wide(predictions(spark, d), 10)


@query(PREDICTIONS + "SELECT target, predicted, coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY target), 0)::DOUBLE, 0) AS share FROM cells")
def confusion_normalised(spark, d):
    return metrics.confusion_normalised(predictions(spark, d), 10)


@query(PREDICTIONS + "SELECT * FROM cm")
def class_metrics(spark, d):
    return metrics.class_metrics(predictions(spark, d), 10)


@query(PREDICTIONS + "SELECT sum(hits)::DOUBLE / sum(support)::DOUBLE AS accuracy, round(sum(precision) / 10, 9) AS macro_precision, round(sum(recall) / 10, 9) AS macro_recall, round(sum(f1) / 10, 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, sum(support)::BIGINT AS n FROM cm")
def summary_metrics(spark, d):
    out = metrics.summary_metrics(predictions(spark, d), 10)
    return out.select("accuracy", *(F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1")), "n")


BINS = PREDICTIONS + ", b AS (SELECT k::INT AS bin, (k / 10)::FLOAT AS lo, ((k + 1) / 10)::FLOAT AS hi FROM range(10) t(k)), bins AS (SELECT bin, count(p.id)::BIGINT AS n, coalesce(avg((target = predicted)::INT), 0) AS accuracy, coalesce(avg(confidence), 0) AS mean_confidence FROM b LEFT JOIN p ON (confidence::FLOAT > lo OR bin = 0) AND confidence::FLOAT <= hi GROUP BY bin) "


@query(BINS + "SELECT bin, n, round(accuracy, 9) AS accuracy, round(mean_confidence, 9) AS mean_confidence FROM bins")
def calibration_bins(spark, d):
    return metrics.calibration_bins(predictions(spark, d)).select("bin", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_confidence", 9).alias("mean_confidence"))


@query(BINS + "SELECT round((SELECT sum(n * abs(accuracy - mean_confidence)) / sum(n) FROM bins), 9) AS ece, round(avg(confidence), 9) AS mean_all, round(avg(confidence) FILTER (target = predicted), 9) AS mean_right, round(avg(confidence) FILTER (target <> predicted), 9) AS mean_wrong FROM p")
def ece(spark, d):
    out = metrics.calibration_error(predictions(spark, d))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(PREDICTIONS + "SELECT round(avg(-ln(probs[target + 1])), 9) AS loss, avg((target = predicted)::INT::DOUBLE) AS accuracy FROM p")
def cross_entropy(spark, d):
    return metrics.cross_entropy(predictions(spark, d)).select(F.round("loss", 9).alias("loss"), "accuracy")


_ONE = {
    "accuracy": "sum(hits) / sum(support)", "macro_precision": "sum(precision) / 10", "macro_recall": "sum(recall) / 10", "macro_f1": "sum(f1) / 10", "weighted_f1": "sum(f1 * support) / sum(support)", "n": "sum(support)",
}
_ALL = {"mean_all": "avg(confidence)", "mean_right": "avg(confidence) FILTER (target = predicted)", "mean_wrong": "avg(confidence) FILTER (target <> predicted)", "loss": "avg(-ln(probs[target + 1]))"}
REPORT = BINS + ", f AS (SELECT 'confusion' AS output, target AS class, 'p' || predicted AS name, n::DOUBLE AS value FROM cells UNION ALL SELECT 'confusion_normalised', target, 'p' || predicted, coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY target), 0)::DOUBLE, 0) FROM cells"
REPORT += "".join(f" UNION ALL SELECT 'classification_report', target, '{c}', {c}::DOUBLE FROM cm" for c in ("precision", "recall", "f1", "support"))
REPORT += "".join(f" UNION ALL SELECT 'metrics', -1, '{n}', ({c})::DOUBLE FROM cm" for n, c in _ONE.items()) + "".join(f" UNION ALL SELECT 'metrics', -1, '{n}', ({c})::DOUBLE FROM p" for n, c in _ALL.items())
REPORT += " UNION ALL SELECT 'metrics', -1, 'ece', (sum(n * abs(accuracy - mean_confidence)) / sum(n))::DOUBLE FROM bins UNION ALL SELECT 'predictions', target, CASE WHEN target = predicted THEN 'right' ELSE 'wrong' END, count(*)::DOUBLE FROM p GROUP BY ALL) SELECT output, class, name, round(value, 9) AS value FROM f"


@query(REPORT)
def evaluation_report(spark, d):
    """All outputs of an exported report as one table: the class-sized ones, and counts of the right and wrong predictions."""
    path, rows = f"{shared_dir(spark).rstrip('/')}/siftlake-report-{uuid.uuid4().hex}", evaluation.predictions_table(predictions(spark, d))
    evaluation.export_report(rows, 10, path)
    wrong = evaluation.misclassified(spark, path, rows).groupBy("target").agg(F.count("*").alias("n")).select("target", F.lit("wrong").alias("name"), "n")
    right = evaluation.read_predictions(spark, path, rows).filter("correct").groupBy("target").agg(F.count("*").alias("n")).select("target", F.lit("right").alias("name"), "n")
    counted = wrong.unionAll(right).select(F.lit("predictions").alias("output"), F.col("target").alias("class"), "name", F.col("n").cast("double").alias("value"))
    return evaluation.read_report(spark, path, 10).unionAll(counted).withColumn("value", F.round("value", 9))


@query(PREDICTIONS + ", u AS (SELECT id, unnest(range(10))::INT AS c, unnest(probs) AS p FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, c)::INT AS rank FROM u) SELECT id, rank, c, p FROM r WHERE rank <= 3")
def ranked_topk(spark, d):
    return metrics.ranked(predictions(spark, d), 3)


@query(PREDICTIONS + "SELECT id, target, predicted, confidence FROM p WHERE target <> predicted")
def misclassified(spark, d):
    return predictions(spark, d).filter("target <> predicted").select("id", "target", "predicted", "confidence")


RISK = PREDICTIONS + ", r AS (SELECT id, predicted, CASE WHEN least(confidence * 2, 1) < 0.5 THEN 'LOW' WHEN least(confidence * 2, 1) <= 0.8 THEN 'MODERATE' ELSE 'HIGH' END AS risk FROM p) "


@query(RISK + "SELECT risk, count(*) AS n FROM r GROUP BY risk")
def risk_levels(spark, d):
    return predictions(spark, d).groupBy(e.risk_level(F.least(F.col("confidence") * 2, F.lit(1.0))).alias("risk")).agg(F.count("*").alias("n"))


@query(RISK + "SELECT id, CASE WHEN risk = 'LOW' THEN 'retake' WHEN predicted = 0 THEN 'monitor' WHEN risk = 'HIGH' THEN 'treat' ELSE 'inspect' END AS advice FROM r")
def risk_recommendation(spark, d):
    return predictions(spark, d).select("id", e.advice(e.risk_level(F.least(F.col("confidence") * 2, F.lit(1.0))), F.col("predicted") == 0).alias("advice"))


@query("WITH s AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE - list_max(embedding[1:4])::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1 FROM s")
def softmax(spark, d):
    p = e.softmax(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


HISTORY = "WITH h AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events), i AS (SELECT *, before IS NULL OR value > before AS improved, greatest(value, coalesce(before, value)) AS best FROM h) "


@query(HISTORY + "SELECT user_id, event_id, value, improved, best FROM i")
def running_best(spark, d):
    return runs.running_best(table(spark, d, "events"), "user_id", "event_id", "value")


@query(HISTORY + ", w AS (SELECT *, step - max(step) FILTER (improved) OVER (PARTITION BY user_id ORDER BY event_id) AS waited FROM i) SELECT user_id, min(step) FILTER (waited >= 8)::INT AS stop_at, max(best) AS best FROM w GROUP BY user_id")
def early_stop(spark, d):
    return runs.early_stop(table(spark, d, "events"), "user_id", "event_id", "value", 8)


EPOCHS = "WITH g AS (SELECT user_id, event_id, event_type, row_number() OVER w AS global_epoch, coalesce(lag(event_type) OVER w <> event_type, false) AS boundary FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) "


@query(EPOCHS + "SELECT user_id, event_id, event_type, global_epoch::INT AS global_epoch, boundary FROM g")
def global_epoch(spark, d):
    return runs.global_epochs(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query(EPOCHS + "SELECT user_id, global_epoch::INT AS global_epoch FROM g WHERE boundary")
def stage_boundaries(spark, d):
    return runs.global_epochs(table(spark, d, "events"), "user_id", "event_type", "event_id").filter("boundary").select("user_id", "global_epoch")


BEST = "WITH r AS (SELECT event_type, first(event_id ORDER BY value DESC, event_id) AS best_step, max(value) AS best, last(value ORDER BY event_id) AS last, count(*) AS steps FROM events GROUP BY event_type) "


@query(BEST + "SELECT * FROM r")
def best_run(spark, d):
    return runs.best_runs(table(spark, d, "events"), "event_type", "event_id", "value")


@query(BEST + "SELECT event_type, round_even(best, 4) AS best, round_even(round_even(best, 4) - (SELECT round_even(best, 4) FROM r WHERE event_type = 'view'), 4) AS delta FROM r")
def baseline_delta(spark, d):
    return runs.baseline_delta(runs.best_runs(table(spark, d, "events"), "event_type", "event_id", "value"), "event_type", "view")


MATRIX = "WITH m AS (SELECT n_name AS model, f.k::INT AS fold, a.arm, format('{}_fold{:02d}_{}', n_name, f.k, a.arm) AS experiment_id FROM nation, range(1, 11) f(k), (VALUES ('real'), ('augmented')) a(arm)) "


def _matrix(spark, d) -> DataFrame:
    return runs.experiment_matrix(table(spark, d, "nation").select(F.col("n_name").alias("model")), 10, ["real", "augmented"])


@query(MATRIX + "SELECT * FROM m")
def experiment_matrix(spark, d):
    return _matrix(spark, d)


@query(MATRIX + ", r AS (SELECT format('{}_fold{:02d}_real', n_name, n_regionkey + 1) AS experiment_id, 'COMPLETED' AS status, n_nationkey % 2 = 0 AS artifacts FROM nation) SELECT m.experiment_id, model, fold, arm, CASE WHEN status IS NULL THEN 'PENDING' WHEN status = 'COMPLETED' AND NOT artifacts THEN 'FAILED' ELSE status END AS status FROM m LEFT JOIN r USING (experiment_id)")
def matrix_status(spark, d):
    done = table(spark, d, "nation").select(e.experiment_id(F.col("n_name"), F.col("n_regionkey") + 1, F.lit("real")).alias("experiment_id"), F.lit("COMPLETED").alias("status"), (F.col("n_nationkey") % 2 == 0).alias("artifacts"))
    return runs.with_status(_matrix(spark, d), done)


RUN_EVENTS = "WITH e AS (SELECT 'u' || user_id AS run, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'resume' WHEN 'click' THEN 'artifact' WHEN 'purchase' THEN 'complete' ELSE CASE WHEN event_id % 3 = 0 THEN 'interrupt' ELSE 'fail' END END AS kind, 'c' || event_id % 2 AS config, CASE WHEN event_type = 'click' THEN ['config', 'history', 'metrics', 'confusion', 'best', 'latest', 'summary'][event_id // 2 % 7 + 1] END AS artifact FROM events), c AS (SELECT run, config, min(seq) FILTER (kind = 'start') AS first, count(DISTINCT artifact) AS files, max(seq) FILTER (kind <> 'artifact') AS last_seq, arg_max(kind, seq) FILTER (kind <> 'artifact') AS last, row_number() OVER (PARTITION BY run ORDER BY min(seq) FILTER (kind = 'start') NULLS LAST, config) AS k, count(*) OVER (PARTITION BY run) AS configs FROM e GROUP BY run, config) SELECT run, CASE WHEN first IS NULL THEN 'PENDING' WHEN last = 'complete' THEN CASE WHEN files = 7 THEN 'COMPLETED' ELSE 'FAILED' END WHEN last = 'fail' THEN 'FAILED' WHEN last = 'interrupt' THEN 'INTERRUPTED' ELSE 'RUNNING' END AS status, CASE WHEN first IS NOT NULL THEN config END AS config, CASE WHEN first IS NOT NULL THEN last_seq END AS last_seq, CASE WHEN first IS NULL THEN 0 ELSE files END::INT AS artifacts, (configs - (first IS NOT NULL)::INT)::INT AS refused FROM c WHERE k = 1"


def _run_events(rows: DataFrame) -> DataFrame:
    """Events of users in the role of events of runs, each with one of two configs."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "resume").when(F.col("event_type") == "click", "artifact").when(F.col("event_type") == "purchase", "complete")
    kind = kind.otherwise(F.when(F.col("event_id") % 3 == 0, "interrupt").otherwise("fail"))
    file = F.when(F.col("event_type") == "click", F.get(F.array(*map(F.lit, states.ARTIFACTS)), (F.expr("event_id div 2") % 7).cast("int")))
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("config"), file.alias("artifact"))


@query(RUN_EVENTS)
def run_states_batch(spark, d):
    return states.batch_states(_run_events(table(spark, d, "events")))


@query(RUN_EVENTS)
def run_states_stream(spark, d):
    """The same from a stream of files dealt from the table, one a batch, so that events come late; the updates are written and read again."""
    root = f"{shared_dir(spark).rstrip('/')}/siftlake-runs-{uuid.uuid4().hex}"
    _run_events(table(spark, d, "events")).repartition(3, F.xxhash64("seq")).write.parquet(f"{root}/events")
    stream = spark.readStream.schema(states.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    states.write_states(states.run_states(stream), f"{root}/updates", f"{root}/checkpoint").awaitTermination()
    return states.current_states(spark, f"{root}/updates")


@query("SELECT t.event_type, count(e.event_id)::BIGINT AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) t(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1")
def zero_filled_distribution(spark, d):
    dim = spark.createDataFrame([("click",), ("view",), ("purchase",), ("never",)], "event_type string")
    return runs.zero_filled(table(spark, d, "events"), dim, "event_type")


def _sessions(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("event_type").alias("kind"), "value", "ts")


@query("SELECT user_id AS session, count(*) AS n, round(avg(value), 9) AS mean_value, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def session_stats(spark, d):
    return runs.session_stats(_sessions(spark, d)).withColumn("mean_value", F.round("mean_value", 9))


@query("SELECT event_id AS id, user_id AS session, event_type AS kind, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def session_recent(spark, d):
    return runs.recent(_sessions(spark, d), 20).select("id", "session", "kind", "value")


@query("WITH c AS (SELECT lang, count(*) AS real FROM documents GROUP BY lang) SELECT lang, real, least(greatest(max(real) OVER () - real, 0), floor(real * 0.5::DOUBLE))::BIGINT AS synthetic FROM c")
def synthetic_plan(spark, d):
    return runs.synthetic_plan(table(spark, d, "documents"), "lang")


@query("SELECT doc_id AS id, lang AS label, (doc_id % 5)::INT AS fold, source, sha256(text) AS \"group\", false AS synthetic FROM documents UNION ALL SELECT page_id, 'page', -1, 'gan', page_id::VARCHAR, true FROM pages")
def augmented_union(spark, d):
    real = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), (F.col("doc_id") % 5).cast("int").alias("fold"), "source", e.sha256_hex(F.col("text")).alias("group"))
    return runs.augmented(real, table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("label")))


@query("WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS file, 'n' || n_nationkey AS include FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'n4', 'r0'), reached AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS file, 0 AS depth, ['r' || r_regionkey] AS path, false AS cycle FROM region UNION ALL SELECT c.root, e.include, c.depth + 1, list_append(c.path, e.include), list_contains(c.path, e.include) FROM reached c JOIN e ON c.file = e.file WHERE NOT c.cycle) SELECT root, file, min(depth)::INT AS depth, bool_or(cycle) AS cycle FROM reached GROUP BY root, file")
def include_closure(spark, d):
    """Regions that include nations, nations that include customers and some other nations, and a cycle."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    key = F.col("n_nationkey")
    edges = nation.select(name("r", F.col("n_regionkey")).alias("file"), name("n", key).alias("include")).unionAll(customer.select(name("n", F.col("c_nationkey")), name("c", F.col("c_custkey"))))
    edges = edges.unionAll(nation.filter(key % 3 == 0).select(name("n", key), name("n", key + 1))).unionAll(nation.filter(key == 4).select(F.lit("n4"), F.lit("r0")))
    return includes.closure(edges, table(spark, d, "region").select(name("r", F.col("r_regionkey")).alias("file")))


@query("SELECT page_id, 'web-' || left(sha256(url), 12) AS record_id FROM pages")
def image_ids(spark, d):
    return table(spark, d, "pages").select("page_id", e.record_id(F.lit("web"), F.col("url")).alias("record_id"))


@query("SELECT n_nationkey, sha256('key=' || n_nationkey || chr(10) || 'name=' || n_name || chr(10) || 'region=' || n_regionkey) AS config FROM nation")
def config_hash(spark, d):
    return table(spark, d, "nation").select("n_nationkey", e.config_hash(name=F.col("n_name"), region=F.col("n_regionkey"), key=F.col("n_nationkey")).alias("config"))


@query("SELECT n_nationkey, dense_rank() OVER (ORDER BY n_name)::INT - 1 AS label FROM nation")
def class_index(spark, d):
    rows = table(spark, d, "nation")
    return rows.join(dedup.ranked_keys(rows, "n_name", "").select("n_name", F.col("group").cast("int").alias("label")), "n_name").select("n_nationkey", "label")


@query("SELECT event_id, CASE WHEN event_id % 100 <= 5 THEN 'head' ELSE 'full' END AS stage FROM events")
def training_stage(spark, d):
    return table(spark, d, "events").select("event_id", e.pipeline_stage(F.col("event_id") % 100, 5).alias("stage"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS place, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS relative, length(url) || 'x' || length(html) AS size FROM pages")
def page_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("place"), e.relative_path(F.col("url"), "https://").alias("relative"), e.size_bucket(F.length("url"), F.length("html")).alias("size"))
