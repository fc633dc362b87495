"""Token counts (operator 5): count-only Viterbi.

An Aho-Corasick automaton over the unigram vocabulary lists all matches that end at each character of a word; dynamic
programming carries only the best score to there and its number of pieces. Ties follow the tokenizer: of equal scores the
piece that starts first stays, and a character without a piece of its own scores 10 below the least piece and counts its
UTF-8 bytes if the model falls back to bytes (1 if not). Scores are summed in single precision, as there, but within a
word: a tokenizer that sums over the whole text can round another way where two ways score all but the same.

A model file of BPE kind holds merge ranks as scores, and its own tokenizer joins pairs by rank instead of maximising
their sum. `rule="merges"` counts by that rule, as that tokenizer does.

Words repeat, so each Python worker keeps the counts of runs and words it has seen, at most `_KEPT` of each, then starts
afresh; that changes nothing but time.

Defined cases: a null or empty text counts 0; each row is counted by itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary as v
from .common import by_batch

_KEPT = 1_000_000
_workers: dict = {}


class Counter(dict):
    """Word -> pieces by the rule; a missing word is counted and kept."""

    def __init__(self, vocab: v.Vocabulary, rule: str = "viterbi"):
        import ahocorasick

        super().__init__()
        self.matches = ahocorasick.Automaton()
        for piece, _, score in vocab.pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.scores = {p: s for p, _, s in vocab.pieces}
        self.unknown, self.by_bytes = vocab.unknown_score, bool(vocab.bytes_from)
        #: Sums of whole numbers below 2 ** 24 are the same in any precision, so these need no rounding.
        self.whole = int((1 << 23) / -self.unknown) if self.unknown < 0 and all(float(s).is_integer() for s in (*self.scores.values(), self.unknown)) else 0
        self.count = {"viterbi": self.viterbi, "merges": self.merged}[rule]

    def cost(self, char: str) -> int:
        """Pieces of a character that has none of its own."""
        return len(char.encode()) if self.by_bytes else 1

    def viterbi(self, word: str) -> int:
        n = len(word)
        kind = float if n < self.whole else np.float32
        best, count, unknown = [kind(0)] * (n + 1), [0] * (n + 1), kind(self.unknown)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.matches.iter(word):
            ends[end].append(match)
        for end, found in enumerate(ends):
            top, pieces = None, 0
            for length, score in found:  # longest, that is earliest start, first
                total = best[end + 1 - length] + kind(score)
                if top is None or total > top:
                    top, pieces = total, count[end + 1 - length] + 1
            if word[end] not in self.scores:
                total = best[end] + unknown
                if top is None or total > top:
                    top, pieces = total, count[end] + self.cost(word[end])
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def merged(self, word: str) -> int:
        """Pieces by the BPE rule: the best-scored neighbouring pair joins first, of equal ones the leftmost."""
        parts, get = list(word), self.scores.get
        heap = [(-s, k) for k in range(len(parts) - 1) if (s := get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        while heap:
            s, k = heapq.heappop(heap)
            if parts[k] is None or (j := after[k]) >= len(parts) or get(parts[k] + parts[j]) != -s:
                continue  # one of the two has joined another meanwhile
            parts[k], parts[j] = parts[k] + parts[j], None
            after[k] = after[j]
            if after[k] < len(parts):
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < len(parts) and (s := get(parts[x] + parts[after[x]])) is not None:
                    heapq.heappush(heap, (-s, x))
        return sum(1 if p in self.scores else sum(map(self.cost, p)) for p in parts if p is not None)

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = found = self.count(word)
        return found


class Runs(dict):
    """Run of a text -> pieces of its words."""

    def __init__(self, vocab: v.Vocabulary, rule: str):
        super().__init__()
        self.cutter, self.words = v.Cutter(vocab), Counter(vocab, rule)

    def __missing__(self, run: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        words = self.cutter.cut(run)
        self[run] = found = self.words[run] if len(words) == 1 else sum(map(self.words.__getitem__, words))
        return found




def counted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = v.MODEL, rule: str = "viterbi") -> DataFrame:
    """(id, n_tokens) of every row."""
    vocab = v.load(model)
    if rule == "merges" and not vocab.merges:
        raise ValueError("the model holds no merges")
    key = uuid.uuid4().hex  # a worker outlives a query
    sent = docs.sparkSession.sparkContext.broadcast(vocab)  # the vocabulary, of a fixed size

    def run(x: dict) -> dict:
        if (counter := _workers.get(key)) is None:
            _workers.clear()
            counter = _workers[key] = Runs(sent.value, rule)
        return {"id": x["id"], "n_tokens": [sum(map(counter.__getitem__, counter.cutter.runs(t))) for t in x["text"]]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_batch(rows, f"id {dict(docs.dtypes)[id_col]}, n_tokens long", run).withColumnRenamed("id", id_col)
