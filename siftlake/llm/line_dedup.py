"""Line dedup (operator 4): pairwise alignment.

A document's runs are its shortest stretches of consecutive lines that reach `min_words` words, forward from each line and
back from each line; two documents that share a block of so many words share a run, and such runs cover the whole block.
Every later holder of a run is paired with its earliest holder, and the pair's lines are aligned by patience diff (lines
that are unique in both, the longest increasing run of them, and so on between these, and the longest common run where no
line is unique in both); the aligned blocks of `min_words` words or more are deleted from the later document.

Lines that stand in another order than in the earliest holder aren't aligned with it. So what is left of a shared run is counted:
of its occurrences in a document as many go as some earlier document has, those that alignment deleted included, the first ones
first. A passage that stands twice keeps one copy if every earlier document has it once, however many do; a moved passage goes. No
further pairs are made, and the counts of a run come from a grouping by run and number. A run's earliest holder loses nothing to it.

Documents are ordered by id, nulls last, then by a hash of the text.

Defined cases: a null text has no lines and stays null; rows that repeat both id and text are one document and get one
result each; lines within one document are never deduplicated against each other; texts of one line are aligned like any
other; an empty table gives an empty result; extra columns are ignored. A line is compared without its surrounding white space.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Staged, by_batch, mixed
from .hashing import powers


def longest_run(a: list[int], b: list[int], words: list[int]) -> tuple[int, int, int]:
    """(i, j, n): the run of n equal lines of a and b that has the most words, the earliest of several; n is 0 without one."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(b):
        places.setdefault(h, []).append(j)
    at = {h: np.array(js) for h, js in places.items()}
    total = np.concatenate([[0], np.cumsum(words)])
    size, best, most = np.zeros(len(b) + 1, np.int64), (0, 0, 0), -1
    for i, h in enumerate(a):
        old, size = size, np.zeros(len(b) + 1, np.int64)
        if (js := at.get(h)) is None:
            continue
        size[js + 1] = long = old[js] + 1
        weight = total[js + 1] - total[js + 1 - long]
        k = int(np.argmax(weight))
        if weight[k] > most:
            n, most = int(long[k]), int(weight[k])
            best = (i + 1 - n, int(js[k]) + 1 - n, n)
    return best


def aligned(a: list[int], b: list[int], words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Patience diff: index pairs of equal lines, rising in both.

    In a gap without lines that are unique in both, the common run of the most words (of b; lines, where no words are given)
    is aligned, and what lies before and behind it becomes a gap, until no run of `least` words is left.
    """
    words = words or [1] * len(b)
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        at_a, at_b = {}, {}
        for seen, rows, lo, hi in ((at_a, a, i, i2), (at_b, b, j, j2)):
            for k in range(lo, hi):
                seen[rows[k]] = -1 if rows[k] in seen else k
        both = [(k, at_b[h]) for h, k in at_a.items() if k >= 0 and at_b.get(h, -1) >= 0]
        tails, last, back = [], [], []  # longest increasing run of places in b
        for n, (_, q) in enumerate(both):
            at = bisect_left(tails, q)
            tails[at : at + 1], last[at : at + 1] = [q], [n]
            back.append(last[at - 1] if at else -1)
        run, n = [], last[-1] if last else -1
        while n >= 0:
            run.append(both[n])
            n = back[n]
        if not run:
            p, q, n = longest_run(a[i:i2], b[j:j2], words[j:j2])
            if n and sum(words[j + q : j + q + n]) >= least:
                run = [(i + p + k, j + q + k) for k in reversed(range(n))]
        edges = [(i - 1, j - 1), *run[::-1], (i2, j2)]
        if run:
            out.extend(run)
            todo.extend((p + 1, p2, q + 1, q2) for (p, q), (p2, q2) in zip(edges, edges[1:], strict=False))
    return sorted(out)


def deleted_lines(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of b, the later document, in aligned blocks of `least` words."""
    out, block = [], []
    for p, q in [*aligned(a, b, words, least), (-9, -9)]:
        if block and (p, q) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[y] for _, y in block) >= least:
                out.extend(y for _, y in block)
            block = []
        block.append((p, q))
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, lines[], words[]): hashes and word counts of every line of docs (doc, text)."""

    def run(x: dict) -> dict:
        out: dict = {"doc": x["doc"], "lines": [], "words": []}
        for text in x["text"]:
            lines = [line.strip() for line in (text or b"").split(b"\n")]
            out["lines"].append(np.array([xxh3_64_intdigest(line) for line in lines], np.uint64).view(np.int64))
            out["words"].append([len(line.split()) for line in lines])
        return out

    kind = docs.schema["doc"].dataType.simpleString()
    return by_batch(docs.select("doc", "text"), f"doc {kind}, lines array<long>, words array<int>", run, binary=("text",))


def runs_of(lines: list[int], words: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end): the shortest runs of `least` words, forward from each line and back from each line."""
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(np.array(words, np.int64))]).astype(np.int64)
    start = np.arange(n)
    ahead = np.searchsorted(total, total[:n] + max(least, 1), "left")
    end = np.arange(1, n + 1)
    behind = np.searchsorted(total, total[1:] - max(least, 1), "right") - 1
    start, end = np.concatenate([start[ahead <= n], behind[behind >= 0]]), np.concatenate([ahead[ahead <= n], end[behind >= 0]])
    start, end = np.unique(np.column_stack([start, end]), axis=0).T
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(np.array(lines, np.int64).view(np.uint64)) * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)).view(np.int64), start, end


def counted_out(lines: list[int], words: list[int], held: list[dict], gone: list[int] | None, least: int) -> list[int]:
    """Lines to delete besides `gone`: of each run in `held` (run, allowed) the first occurrences that are still there, until `allowed` of its occurrences are gone."""
    kept = np.ones(len(lines), np.int64)
    kept[gone or []] = 0
    h, start, end = runs_of(lines, words, least)
    left = np.concatenate([[0], np.cumsum(kept)])
    is_open, is_held = left[end] > left[start], np.isin(h, np.array([x["run"] for x in held], np.int64))
    if not (is_open & is_held).any():
        return []
    allowed, done, out = {x["run"]: x["allowed"] for x in held}, Counter(h[~is_open & is_held].tolist()), []
    for k in np.flatnonzero(is_open & is_held):  # by start, then end
        run, i, j = int(h[k]), start[k], end[k]
        open_lines = i + np.flatnonzero(kept[i:j])
        if len(open_lines) and done[run] >= allowed[run]:
            continue
        done[run] += 1
        kept[i:j] = 0
        out.extend(open_lines.tolist())
    return sorted(out)


def deletions(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, gone[]): the places of the lines to delete from docs (doc, text)."""
    staged, kind = Staged(docs.sparkSession, "lines"), docs.schema["doc"].dataType.simpleString()
    own = staged.write(lines_of(docs.filter("text is not null")).dropDuplicates(["doc"]), "lines")

    def cut(x: dict) -> dict:
        found = [np.unique(runs_of(a, w, min_words)[0], return_counts=True) for a, w in zip(x["lines"], x["words"], strict=True)]
        return {"doc": x["doc"], "runs": [[{"run": r, "n": n} for r, n in zip(*map(np.ndarray.tolist, f), strict=True)] for f in found]}

    each = staged.write(by_batch(own, f"doc {kind}, runs array<struct<run:long,n:int>>", cut).select("doc", F.inline("runs")), "runs")
    levels = each.groupBy("run", "n").agg(F.min("doc").alias("first"), F.count("*").alias("holders"))
    shared = levels.groupBy("run").agg(F.min("first").alias("owner"), F.sum("holders").alias("holders"), F.collect_list(F.struct("n", "first")).alias("levels")).filter("holders > 1").drop("holders")
    earlier = F.filter("levels", lambda x: x["first"] < F.col("doc"))
    links = each.join(shared, "run").filter("doc <> owner").select("doc", "run", "owner", F.array_max(F.transform(earlier, lambda x: F.least(x["n"], F.col("n")))).alias("allowed"))
    links = staged.write(links, "links")

    def align(x: dict) -> dict:
        return {"doc": x["doc"], "gone": [deleted_lines(a, b, w, min_words) for a, b, w in zip(x["first"], x["lines"], x["words"], strict=True)]}

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))

    pairs = links.select("owner", "doc").distinct()
    both = pairs.join(own, "doc").join(own.select(F.col("doc").alias("owner"), F.col("lines").alias("first")), "owner").select("doc", "lines", "words", "first")
    found = staged.write(merged(by_batch(both, f"doc {kind}, gone array<int>", align).filter(F.size("gone") > 0)), "found")

    def rest(x: dict) -> dict:
        return {"doc": x["doc"], "gone": [counted_out(*z, min_words) for z in zip(x["lines"], x["words"], x["held"], x["gone"], strict=True)]}

    held = links.groupBy("doc").agg(F.collect_list(F.struct("run", "allowed")).alias("held")).join(own, "doc").join(found, "doc", "left")
    left = by_batch(held.select("doc", "lines", "words", "held", "gone"), f"doc {kind}, gone array<int>", rest).filter(F.size("gone") > 0)
    return merged(found.unionByName(left))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """Every row with all its columns, its text without the deleted lines, and the struct `line_dedup` (n_lines, n_deleted, gone[]), which takes the place of a column of that name."""
    doc = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    keyed = docs.select(doc.alias("doc"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "line_dedup")).alias("row"))
    found = deletions(keyed.select("doc", F.col(f"row.{text_col}").alias("text")), min_words)
    joined = keyed.join(found, "doc", "left")

    def run(x: dict) -> dict:
        out: dict = {"row": x["row"], "line_dedup": []}
        for row, gone in zip(x["row"], x["gone"], strict=True):
            lines = (row[text_col] or "").split("\n") if row[text_col] is not None else []
            drop = set(gone or ())
            if drop:
                row[text_col] = "\n".join(line for k, line in enumerate(lines) if k not in drop)
            out["line_dedup"].append({"n_lines": len(lines), "n_deleted": len(drop), "gone": sorted(drop)})
        return out

    kind = joined.schema["row"].dataType.simpleString()
    out = by_batch(joined.select("row", "gone"), f"row {kind}, line_dedup struct<n_lines:long,n_deleted:long,gone:array<int>>", run)
    return out.select("row.*", "line_dedup")
