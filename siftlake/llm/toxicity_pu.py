"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic documents against the text of all documents.

The features of a text are its words and word stems (first 4 to 9 letters) that stand in it once, twice or four times at least.
A linear classifier minimises, by full-batch steps, the risk

    prior * R(positives as 1) + max(0, R(all as 0) - prior * R(positives as 0))

with the logistic loss, where the mean over all documents stands for the unlabelled sample and `prior` is the share of toxic
documents among the labelled ones that may be learned from. When the second term falls below 0, a step climbs it instead (the
correction that keeps a flexible model from calling all unlabelled text harmless). Each step is a Spark job over the documents'
selected features, grouped by equal sets of features; numpy sums in tasks, and one vector of the model's size a task is added up.

What is bounded: the candidate features come from at most `positives` toxic and `others` other labelled documents (those of least
hash), at most `candidates` of them are looked up in every document, and the model has at most `features` weights. Document frequencies, the
unlabelled risk, the positives' risk and the scores cover all documents.

Cases: a null text is empty; a text without selected features gets the score of the bias alone. Rows that repeat an id are each
scored, and each counts as the document that its id's labels say; of several label rows of an id the highest counts, null labels
don't. A row without an id has no label and isn't held out. Without toxic documents to learn from every score is 0; the prior is
kept within [0.0001, 0.9]. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, by_batch, cut

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # runs of A-Z, a-z and characters beyond ASCII
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))  # the same as a table for UTF-8 bytes: all others become spaces
STEMS = range(4, 10)
LEVELS = (1, 2, 4)
LONGEST = 40  # letters of a word that is a feature itself; longer ones count by their stems


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bases(text: str | None) -> Counter[str]:
    """How often each word and each stem (marked `*`) stands in a text."""
    found: Counter[str] = Counter()
    for word, n in Counter(LETTERS.findall((text or "").lower())).items():
        if len(word) <= LONGEST:
            found[word] += n
        for k in STEMS:
            if k >= len(word):
                break
            found[f"{word[:k]}*"] += n
    return found


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned from, one row an id."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def candidate_features(docs: DataFrame, known: DataFrame, *, positives: int, others: int, candidates: int, least: int, screen: float) -> list[tuple[str, int]]:
    """(base, level) that at least `least` of the chosen toxic documents have, and by `screen` standard errors more often than the chosen labelled documents at large; the most frequent first."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(positives).unionAll(known.filter("toxic = 0").orderBy(*order).limit(others))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `positives` and `others` ids at most

    def counted(batch: dict[str, list]) -> dict[str, list]:
        found: dict[int, Counter[tuple[str, int]]] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            found[toxic].update((base, level) for base, n in bases(text).items() for level in LEVELS if n >= level)
            found[toxic]["", 0] += 1
        keys = list(found[0] | found[1])
        return {"base": [k[0] for k in keys], "level": [k[1] for k in keys], "p": [found[1][k] for k in keys], "o": [found[0][k] for k in keys]}

    rows = by_batch(texts.select("text", "toxic"), "base string, level int, p long, o long", counted).groupBy("base", "level").agg(F.sum("p").alias("p"), F.sum("o").alias("o"))
    rows = rows.filter((F.col("p") >= least) | (F.col("level") == 0)).persist()  # summed once for the totals and the list
    total = rows.filter("level = 0").first()
    share = F.lit(0.0)
    if total and total["o"]:
        prior = known.agg(F.avg("toxic")).first()[0]
        share = prior * F.col("p") / total["p"] + (1 - prior) * F.col("o") / total["o"] if total["p"] else share
    n = total["p"] if total else 0
    z = (F.col("p") / n - share) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) / n)
    found = [(r["base"], r["level"]) for r in rows.filter((F.col("level") > 0) & (z >= screen)).orderBy(F.desc("p"), "base", "level").limit(candidates).collect()] if n else []
    rows.unpersist()
    return found


def looked_up(docs: DataFrame, known: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, ids): the candidates that each document has, by their place in the list.

    Each word of a batch is searched once, most of them by their first letters alone; numpy counts what stands in which text.
    """
    names = {base: k for k, base in enumerate(dict.fromkeys(base for base, _ in known))}
    place = np.full((len(LEVELS), len(names)), -1)
    for k, (base, level) in enumerate(known):
        place[LEVELS.index(level), names[base]] = k
    stems, words = {b[:-1]: k for b, k in names.items() if b[-1] == "*"}, {b: k for b, k in names.items() if b[-1] != "*"}

    short = STEMS[0]
    heads = {base[:short] for base in (*stems, *words) if len(base) >= short}

    def of_word(word: str) -> list[int]:
        if len(word) >= short and word[:short] not in heads:
            return []
        out = [stems[word[:k]] for k in STEMS if k < len(word) and word[:k] in stems]
        return [*out, words[word]] if word in words else out

    def ids(texts: list[str | None]) -> pa.ListArray:
        apart = pc.split_pattern(pa.array([(t or "").lower().encode().translate(SPACED).decode() for t in texts], pa.large_string()), " ")
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(apart).to_numpy(zero_copy_only=False))
        coded = apart.flatten().dictionary_encode()
        own = [of_word(w) for w in coded.dictionary.to_pylist()]
        size, code = np.array([len(x) for x in own], np.int64), coded.indices.to_numpy(zero_copy_only=False)
        start, many = np.cumsum(size) - size, size[code]
        bases = np.array([k for x in own for k in x], np.int64)
        entry = np.repeat(start[code], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # each token's bases in turn
        pair, n = np.unique(np.repeat(row, many) * max(len(names), 1) + bases[entry], return_counts=True)
        at, base = np.divmod(pair, max(len(names), 1))
        found = [(at[use], place[k, base[use]]) for k, level in enumerate(LEVELS) for use in [(n >= level) & (place[k, base] >= 0)]]
        at, found = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((found, at))
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[order], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids(b.column("text").to_pylist())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def added(rows: DataFrame, width: int, own: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of `own`'s vectors over all batches: one vector a task, added up by eight tasks, then on the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += own(b)
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()]})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += b.column("total").flatten().to_numpy().reshape(-1, width).sum(0)
        yield pa.RecordBatch.from_pydict({"total": [total.tolist()]})

    parts = rows.mapInArrow(first, "total array<double>").repartition(8).mapInArrow(second, "total array<double>")
    return np.sum([np.zeros(width), *(r["total"] for r in parts.collect())], axis=0)


def frequencies(features: DataFrame, n: int) -> np.ndarray:
    """Documents of each of n candidates."""
    return added(features.select("ids"), n, lambda b: np.bincount(flat(b.column("ids"))[1], minlength=n)) if n else np.zeros(0)


def chosen_features(in_positives: np.ndarray, in_all: np.ndarray, n_positives: float, n_all: float, *, features: int, evidence: float) -> np.ndarray:
    """Candidates that toxic documents have more often than all documents by `evidence` standard errors, the clearest first."""
    share = in_all / n_all
    z = (in_positives / n_positives - share) / np.sqrt(np.maximum(share * (1 - share), 1e-12) / n_positives)
    order = np.lexsort((np.arange(len(z)), -z))
    return order[z[order] >= evidence][:features]


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the entries of an array of lists."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def margins(theta: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins of rows of feature ids, and their flat entries; the last of theta is the bias."""
    row, ids = flat(lists)
    return theta[-1] + np.bincount(row, theta[ids], minlength=len(lists)), row, ids


def selected(place: np.ndarray):
    """For mapInArrow: lists of candidates as lists of the model's features, those that it lacks left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids = flat(b.column("ids"))
            ids = place[ids]
            used = ids >= 0
            ends = np.append(0, np.cumsum(np.bincount(row[used], minlength=b.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[used], pa.int32()))], names=["ids"])

    return run


def sums(patterns: DataFrame, theta: np.ndarray) -> np.ndarray:
    """Over all patterns (ids, n, p): rows for weights n and p, each the sum of sigmoid times features, then of the sigmoid, then of the loss as 0."""
    width = len(theta) + 1

    def own(b: pa.RecordBatch) -> np.ndarray:
        z, row, ids = margins(theta, b.column("ids"))
        s, loss, out = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.logaddexp(0, z), np.zeros((2, width))
        for k, c in enumerate(("n", "p")):
            weight = b.column(c).to_numpy(zero_copy_only=False).astype(float)
            out[k, : width - 2] = np.bincount(ids, (weight * s)[row], minlength=width - 2)
            out[k, -2:] = (weight * s).sum(), (weight * loss).sum()
        return out.ravel()

    return added(patterns, 2 * width, own).reshape(2, width)


def gradient(total: np.ndarray, means: np.ndarray, prior: float, n_all: float, n_positives: float) -> np.ndarray:
    """Direction of the corrected risk: downhill, or uphill in its second term where that is below 0."""
    everyone, positives = total[0] / n_all, total[1] / n_positives
    rest = everyone - prior * positives  # the second term and its gradient
    return -rest[:-1] if rest[-1] < 0 else prior * (positives[:-1] - means) + rest[:-1]


def fitted(patterns: DataFrame, means: np.ndarray, prior: float, n_all: float, n_positives: float, *, rounds: int, rate: float, ridge: float) -> np.ndarray:
    """Weights and bias after `rounds` adaptive full-batch steps; `means` are the positives' feature means, then 1."""
    theta = np.append(np.zeros(len(means) - 1), np.log(prior / (1 - prior)))
    first, second, held = np.zeros(len(theta)), np.zeros(len(theta)), np.append(np.ones(len(means) - 1), 0.0)
    for t in range(1, rounds + 1):
        g = gradient(sums(patterns, theta), means, prior, n_all, n_positives) + ridge * held * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    return theta


def scored(
    docs: DataFrame, labels: DataFrame, *, positives: int = 20_000, others: int = 5_000, candidates: int = 32_768, features: int = 4_096, least: int = 3, screen: float = 2.0, evidence: float = 5.0,
    rounds: int = 40, rate: float = 0.1, ridge: float = 1e-3, threshold: float = 0.7,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    staged = Staged(docs.sparkSession, "toxicity")
    known = staged.write(marked(labels), "labels")
    share = known.agg(F.avg("toxic")).first()[0]
    toxic = known.filter("toxic = 1").select("doc_id")
    names = candidate_features(docs, known, positives=positives, others=others, candidates=candidates, least=least, screen=screen) if share else []
    found = staged.write(looked_up(docs, names), "features")
    confirmed = found.join(toxic, "doc_id")  # a row for each document of a toxic id
    n_all, n_positives = found.count(), confirmed.count() if share else 0
    place, theta = np.full(len(names), -1), None
    if n_positives:
        prior = min(max(share, 1e-4), 0.9)
        in_positives = frequencies(confirmed, len(names))
        use = chosen_features(in_positives, frequencies(found, len(names)), n_positives, n_all, features=features, evidence=evidence)
        place[use] = np.arange(len(use))

        def kept(rows: DataFrame, n: int, p: int) -> DataFrame:
            return rows.select("ids").mapInArrow(selected(place), "ids array<int>").groupBy("ids").agg((F.count("*") * n).alias("n"), (F.count("*") * p).alias("p"))

        both = kept(found, 1, 0).unionAll(kept(confirmed, 0, 1)).groupBy("ids").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        means = np.append(in_positives[use] / n_positives, 1.0)
        theta = fitted(staged.write(both, "patterns"), means, prior, n_all, n_positives, rounds=rounds, rate=rate, ridge=ridge)

    weights = np.zeros(len(names) + 1)
    if theta is not None:
        weights[:-1][place >= 0], weights[-1] = theta[place[place >= 0]], theta[-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = margins(weights, b.column("ids"))[0]
            s = np.zeros(len(z)) if theta is None else 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = found.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double").withColumn("score", F.round("score", 6))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
