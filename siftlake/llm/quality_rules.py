"""Quality rules (operator 2): weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation estimates, from the votes of
all documents and no labels, how often each rule is right when it votes, and the share of good documents; the posterior
probability of being good replaces "every rule must pass". The EM reads only the counts of distinct vote patterns, at
most 3 ** len(RULES) rows, which Spark counts over the whole table.

Defined cases: a null or empty text has zero counts and is a base failure; each row is measured by itself, so repeated
rows and ids agree; an empty table gives an empty result. A vote total of exactly even odds keeps the document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, checkpointed

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Very common words of English, German, French and Spanish. Fixed values.
STOP = tuple(w.encode() for w in "the of and to in is that it was for on are with as be at by this der die und den von zu das mit sich des auf ist im dem nicht ein eine le la les et des en un une du que pour dans qui sur au de el los del se las por con no su para al lo".split())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters", "n_stop", "n_ended")


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * n_distinct + ids[1:-1]
    if n_distinct > 2_000_000:  # three ids no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * n_distinct + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(code)] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text given as UTF-8."""
    if not text:
        return (0,) * len(MEASURES)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    count = lambda chars: int(by_byte[list(chars)].sum())
    words = text.split()  # bytes split at ASCII white space alone
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    times = np.bincount(ids, minlength=1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = count(range(65, 91))
    lead = count([*range(0xC3, 0xC4)])  # letters with marks are two bytes, the first 0xC3
    return (
        len(words), int(by_byte.sum() - by_byte[0x80:0xC0].sum()) - count(SPACES), count(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(ids, len(seen)), len(lines), int(by_byte[33]), upper, upper + count(range(97, 123)) + lead,
        sum(int(times[seen[w]]) for w in STOP if w in seen), sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines),
    )


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and MEASURES, a row per row."""

    def run(x: dict) -> dict:
        columns = zip(*map(measure, x["text"]), strict=True) if x["text"] else [[]] * len(MEASURES)
        return {"id": x["id"]} | dict(zip(MEASURES, map(list, columns), strict=True))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_batch(rows, f"id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{m} long" for m in MEASURES), run, binary=("text",)).withColumnRenamed("id", id_col)


def vote(value: Column, *, good: Column | None = None, bad: Column) -> Column:
    v = F.when(value.isNull(), 0).when(bad, -1)
    return (v.when(good, 1) if good is not None else v).otherwise(0)


def rules() -> dict[str, Column]:
    """Name and vote of each rule, over MEASURES."""
    per_word = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    per_line = lambda c: F.try_divide(F.col(c), F.col("n_lines"))
    symbols, bangs, repeats, stop = per_word("n_symbols"), per_word("n_bangs"), per_word("n_repeat_words"), per_word("n_stop")
    length, dup, ended = per_word("word_chars"), per_line("n_dup_lines"), per_line("n_ended")
    upper = F.try_divide(F.col("n_upper"), F.col("n_letters"))
    return {
        "symbols": vote(symbols, good=symbols < 0.02, bad=symbols > 0.1),
        "bangs": vote(bangs, good=bangs < 0.05, bad=bangs > 0.3),
        "upper": vote(upper, good=upper < 0.15, bad=upper > 0.4),
        "word_length": vote(length, good=length.between(3, 11), bad=(length < 2) | (length > 20)),
        "stop_words": vote(stop, good=stop > 0.08, bad=stop < 0.01),
        "dup_lines": vote(dup, good=dup < 0.1, bad=dup > 0.3),
        "repeats": vote(repeats, good=repeats < 0.1, bad=repeats > 0.45),
        "line_ends": vote(ended, good=ended > 0.6, bad=ended < 0.1),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[float], list[float]]:
    """EM over (votes, documents): the share of good documents, and each rule's accuracy on good and on bad documents.

    Abstaining says nothing; a vote cast is right with a probability of its own in either class. It starts from "one bad
    vote makes a document doubtful", and keeps a bad vote no likelier in the good class than in the bad one, which fixes
    which class is which. Counts are smoothed by one right and one wrong vote.
    """
    if not patterns:
        return 0.9, [], []
    k = len(patterns[0][0])
    votes, n = np.array([p for p, _ in patterns], float).reshape(-1, k), np.array([c for _, c in patterns], float)
    good, prior, on_good, on_bad = 0.97 * 0.25 ** (votes < 0).sum(1), 0.9, np.full(k, 0.9), np.full(k, 0.5)
    for _ in range(rounds):
        of_good, of_bad = n * good, n * (1 - good)
        before = np.concatenate([on_good, on_bad])
        on_good = np.clip((of_good @ (votes > 0) + 1) / (of_good @ (votes != 0) + 2), 0.5, 0.999)
        on_bad = np.clip((of_bad @ (votes < 0) + 1) / (of_bad @ (votes != 0) + 2), 1 - on_good, 0.99)
        prior = float(np.clip((of_good.sum() + 1) / (n.sum() + 2), 0.05, 0.95))
        good = posterior(votes, prior, on_good, on_bad)
        if np.abs(np.concatenate([on_good, on_bad]) - before).max(initial=0) < 1e-9:
            break
    return prior, on_good.tolist(), on_bad.tolist()


def posterior(votes: np.ndarray, prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    yes, no = np.log(on_good / (1 - on_bad)), np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + (votes > 0) @ yes + (votes < 0) @ no)))


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """Every row with its measures, base failure, posterior probability of being good, and verdict."""
    own = rules()
    rows = checkpointed(measured(docs, id_col=id_col, text_col=text_col).withColumn("votes", F.array(*own.values())))
    patterns = [(tuple(r["votes"]), r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]  # at most 3 ** 8
    prior, on_good, on_bad = fit(patterns)
    log_odds = F.lit(math.log(prior / (1 - prior)))
    for k, (g, b) in enumerate(zip(on_good, on_bad, strict=True)):
        v = F.col("votes")[k]
        log_odds = log_odds + F.when(v > 0, math.log(g / (1 - b))).when(v < 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = 1 / (1 + F.exp(-log_odds))
    return rows.select(
        id_col, *MEASURES[:5], failed.alias("base_failed"), (~failed & (p >= keep_from)).alias("kept"), p.alias("p_good"),
        F.struct(*(F.col("votes")[k].alias(name) for k, name in enumerate(own))).alias("votes"),
    )
