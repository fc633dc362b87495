"""Suffix-array dedup (operator 9): a logarithmic family of suffix-array indexes.

Every byte that lies in a `length`-byte string which starts anywhere else too is removed; strings are judged on the input.

Suffixes. Sorting every suffix of a large corpus moves many times its size, so the arrays are sparse and still exact:
among the starts of `key`-byte strings within a `length`-byte window, the one of least hash is the window's anchor. Equal
windows have equal anchors at equal offsets, so windows need comparing only under a shared anchor. An anchor's entry
holds the hash of its first `key` bytes (the order of the array) and of its hull, all that its windows cover.

Index family. Documents come in `batches`. A batch's entries are sorted into a suffix array, which is merge-scanned
(a sort-merge join on the order) against each level of the index for keys that both hold; then it becomes a level, and
levels of equal size merge, so a corpus of n batches has at most log2(n) + 1 levels and an entry is rewritten log2(n) times.

Verdict. A hull that stands twice is removed whole. Anchors whose key is repeated but whose hull isn't lie at the edges
of repeats: their windows are cut into chunks of 16, a chunk's core (common to its windows) and hull are compared the
same way, and only chunks whose core is repeated and hull isn't are compared window by window. All comparisons are of
64-bit hashes under a 64-bit hash of the anchor's key.

Defined cases: a null text is empty; texts under `length` bytes stay whole; rows that repeat a text, with whatever ids,
repeat its strings; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, by_batch, mixed
from .hashing import Rolling

CHUNK = 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Suffixes:
    """The anchors of one text of `length` bytes at least: for each its place, its windows' first and last start, its key's and its hull's hash."""

    def __init__(self, text: bytes, length: int, key: int):
        self.length, self.size, wide = length, len(text), length - key + 1
        self.roll, n, m = Rolling(text), len(text) - length + 1, len(text) - key + 1
        starts = np.arange(m)
        keys = self.roll.of(starts, starts + key)
        low = np.uint64(wide.bit_length())  # these bits hold the place in a block, so that the leftmost of equal hashes is the least
        held = np.full(-(-m // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        held[:m] = keys >> low << low
        held = held.reshape(-1, wide) | np.arange(wide, dtype=np.uint64)
        tail = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        head = np.minimum.accumulate(held, axis=1).ravel()[wide - 1 : wide - 1 + n]
        s, mask = np.arange(n), (np.uint64(1) << low) - np.uint64(1)
        own = (tail >> low) <= (head >> low)
        place = np.where(own, s // wide * wide + (tail & mask).astype(np.int64), (s + wide - 1) // wide * wide + (head & mask).astype(np.int64))
        turn = np.flatnonzero(np.diff(place)) + 1
        self.first, self.last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [n - 1]])
        self.at = place[self.first]
        self.key = keys[self.at]
        self.hull = mixed(self.roll.of(self.first, self.last + length) + (self.at - self.first).astype(np.uint64) * _A + (self.last - self.first).astype(np.uint64) * _B)

    def chunks(self, i: np.ndarray) -> dict[str, np.ndarray]:
        """Of anchors i: each chunk's number, core and hull hash; hull 0 where the text doesn't hold it all."""
        lo, hi = (self.at[i] - self.last[i]) // CHUNK, (self.at[i] - self.first[i]) // CHUNK
        n = hi - lo + 1
        who = np.repeat(i, n)
        c = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        near, far = self.at[who] - CHUNK * c, self.at[who] - CHUNK * c - CHUNK + 1  # the chunk's last and first start
        core = mixed(self.roll.of(near, far + self.length) + c.astype(np.uint64) * _A)
        whole = (far >= 0) & (near + self.length <= self.size)
        hull = np.zeros(len(c), np.uint64)
        hull[whole] = mixed(self.roll.of(far[whole], near[whole] + self.length) + c[whole].astype(np.uint64) * _B) | np.uint64(1)
        return {"who": who, "chunk": c, "core": core, "hull": hull}


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with the 128-bit key (t1, t2) of their text."""
    return docs.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("second"), "text"))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def entries(docs: DataFrame, length: int, key: int) -> DataFrame:
    """(t1, t2, key[], hull[], first[], until[]) of every row whose text has `length` bytes."""

    def run(x: dict) -> dict:
        found = [Suffixes(t, length, key) for t in x["text"]]
        return {"t1": x["t1"], "t2": x["t2"], "key": [signed(s.key) for s in found], "hull": [signed(s.hull) for s in found], "first": [s.first for s in found], "until": [s.last + length for s in found]}

    rows = keyed(docs.filter(F.octet_length("text") >= length)).select("t1", "t2", "text")
    return by_batch(rows, "t1 long, t2 long, key array<long>, hull array<long>, first array<int>, until array<int>", run, binary=("text",))


class IndexFamily:
    """Levels of sorted sparse suffix arrays (key, hull, n, t1) in the shared folder, and the keys that stand twice."""

    def __init__(self, staged: Staged):
        self.staged, self.levels, self.repeated, self.made = staged, [], [], 0

    def _sorted(self, rows: DataFrame) -> tuple[DataFrame, str]:
        self.made += 1
        name = f"level-{self.made}"
        return self.staged.write(rows.repartition("key").sortWithinPartitions("key", "hull"), name), name

    def add(self, batch: DataFrame) -> None:
        """Takes a batch (t1, key[], hull[]): sorts it, merge-scans it against each level, and merges levels of equal size."""
        new = batch.select("t1", F.inline(F.arrays_zip("key", "hull"))).groupBy("key", "hull").agg(F.count("*").alias("n"), F.min("t1").alias("t1"))
        new, name = self._sorted(new)
        hits = [new.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")]
        hits += [new.select("key").hint("merge").join(level.select("key").hint("merge"), "key", "left_semi") for _, level, _ in self.levels]
        found = hits[0]
        for more in hits[1:]:
            found = found.unionAll(more)
        self.repeated.append(self.staged.write(found.distinct(), f"repeated-{self.made}"))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, level, old = self.levels.pop()
            merged = new.unionAll(level).groupBy("key", "hull").agg(F.sum("n").alias("n"), F.min("t1").alias("t1"))
            spent = (name, old)
            new, name = self._sorted(merged)
            rank += 1
            for x in spent:
                self.staged.drop(x)
        self.levels.append((rank, new, name))

    def classes(self) -> DataFrame:
        """(key, hull, n, t1) of all entries under a key that stands twice."""
        keys, rows = self.repeated[0], self.levels[0][1]
        for more in self.repeated[1:]:
            keys = keys.unionAll(more)
        for _, more, _ in self.levels[1:]:
            rows = rows.unionAll(more)
        return rows.join(keys.distinct(), "key", "left_semi").groupBy("key", "hull").agg(F.sum("n").alias("n"), F.min("t1").alias("t1"))


def edge_chunks(texts: DataFrame, length: int, key: int) -> DataFrame:
    """(t1, t2, at, key, once, chunk, core, hull) for the wanted anchors of texts (t1, t2, text, want)."""

    def run(x: dict) -> dict:
        out: dict = {k: [] for k in ("t1", "t2", "at", "key", "once", "chunk", "core", "hull")}
        for t1, t2, text, want in zip(x["t1"], x["t2"], x["text"], x["want"], strict=True):
            s = Suffixes(text, length, key)
            once = {(w["key"], w["hull"]): w["n"] == 1 for w in want}
            flags = [once.get(p) for p in zip(signed(s.key).tolist(), signed(s.hull).tolist(), strict=True)]
            i = np.array([k for k, f in enumerate(flags) if f is not None], np.int64)
            c = s.chunks(i)
            out["t1"].append(t1)
            out["t2"].append(t2)
            for k, v in (("at", s.at[c["who"]]), ("key", s.key[c["who"]]), ("once", np.array([bool(f) for f in flags])[c["who"]]), ("chunk", c["chunk"]), ("core", c["core"]), ("hull", c["hull"])):
                out[k].append(signed(v))
        return out

    rows = by_batch(texts, "t1 long, t2 long, at array<int>, key array<long>, once array<boolean>, chunk array<int>, core array<long>, hull array<long>", run, binary=("text",))
    return rows.select("t1", "t2", F.inline(F.arrays_zip("at", "key", "once", "chunk", "core", "hull")))


def edge_windows(texts: DataFrame, length: int) -> DataFrame:
    """(t1, t2, key, once, start, window) for every window of the wanted chunks of texts (t1, t2, text, want)."""

    def run(x: dict) -> dict:
        out: dict = {k: [] for k in ("t1", "t2", "key", "once", "start", "window")}
        for t1, t2, text, want in zip(x["t1"], x["t2"], x["text"], x["want"], strict=True):
            at, chunk = (np.repeat(np.array([w[k] for w in want], np.int64), CHUNK) for k in ("at", "chunk"))
            off = chunk * CHUNK + np.tile(np.arange(CHUNK), len(want))
            start = at - off
            ok = (start >= 0) & (start + length <= len(text))
            key, once = (np.repeat(np.array([w[k] for w in want]), CHUNK)[ok] for k in ("key", "once"))
            start, off = start[ok], off[ok]
            window = mixed(Rolling(text).of(start, start + length) + off.astype(np.uint64) * _A)
            for k, v in (("t1", t1), ("t2", t2), ("key", key), ("once", once), ("start", start), ("window", signed(window))):
                out[k].append(v)
        return out

    rows = by_batch(texts, "t1 long, t2 long, key array<long>, once array<boolean>, start array<int>, window array<long>", run, binary=("text",))
    return rows.select("t1", "t2", F.inline(F.arrays_zip("key", "once", "start", "window")))


def covered(docs: DataFrame, length: int, key: int, batches: int) -> DataFrame:
    """(t1, t2, start, end): byte intervals of repeated strings of docs (text), with overlaps."""
    staged = Staged(docs.sparkSession, "suffixes")
    own = staged.write(entries(docs, length, key), "entries")
    family = IndexFamily(staged)
    for b in range(batches):
        family.add(own.filter(F.pmod("t1", F.lit(batches)) == b).select("t1", "key", "hull"))
    classes = staged.write(family.classes(), "classes")
    full = classes.filter("n > 1").select("key", "hull")
    spans = own.select("t1", "t2", F.inline(F.arrays_zip("key", "hull", "first", "until"))).join(full, ["key", "hull"], "left_semi")
    spans = staged.write(spans.select("t1", "t2", F.col("first").alias("start"), F.col("until").alias("end")).distinct(), "full")

    mixed_keys = classes.groupBy("key").agg(F.count("*").alias("hulls"), F.min("n").alias("least")).filter("hulls > 1 and least = 1").select("key")
    want = classes.join(mixed_keys, "key", "left_semi").groupBy("t1").agg(F.collect_list(F.struct("key", "hull", "n")).alias("want"))
    single = keyed(docs.filter(F.octet_length("text") >= length)).select("t1", "t2", "text").dropDuplicates(["t1", "t2"])
    texts = staged.write(single.join(want, "t1"), "texts")
    rows = staged.write(edge_chunks(texts, length, key), "chunks")
    cores = rows.groupBy("key", "core").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    live = staged.write(rows.join(cores, ["key", "core"], "left_semi"), "live")
    whole = live.filter("hull <> 0").groupBy("key", "hull").agg(F.count("*").alias("n")).filter("n > 1").select("key", "hull")
    sure = live.filter("once").join(whole, ["key", "hull"], "left_semi")
    begin = F.col("at") - CHUNK * F.col("chunk")
    sure_spans = sure.select("t1", "t2", (begin - CHUNK + 1).alias("start"), (begin + length).alias("end"))
    open_ = live.filter("once").join(whole, ["key", "hull"], "left_anti").select("key", "core").distinct()
    last = live.join(open_, ["key", "core"], "left_semi").groupBy("t1").agg(F.collect_list(F.struct("at", "chunk", "key", "once")).alias("want"))
    windows = staged.write(edge_windows(texts.drop("want").join(last, "t1"), length), "windows")
    twice = windows.groupBy("key", "window").agg(F.count("*").alias("n")).filter("n > 1").select("key", "window")
    edges = windows.filter("once").join(twice, ["key", "window"], "left_semi").select("t1", "t2", "start", (F.col("start") + length).alias("end"))
    return spans.unionByName(sure_spans).unionByName(edges)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, key: int = 64, batches: int = 4) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: the removed runs of bytes, apart and in order, and the bytes that remain."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = covered(docs, length, key, batches).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def run(x: dict) -> dict:
        out: dict = {"id": x["id"], "n_bytes": [], "spans": [], "kept": []}
        for text, found in zip(x["text"], x["found"], strict=True):
            text, spans = text or b"", []
            for s, e in sorted((f["start"], f["end"]) for f in found or ()):
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = max(e, spans[-1]["end"])
                else:
                    spans.append({"start": s, "end": e})
            edges = [0, *(v for s in spans for v in (s["start"], s["end"])), len(text)]
            out["n_bytes"].append(len(text))
            out["spans"].append(spans)
            out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return out

    rows = keyed(docs).join(found, ["t1", "t2"], "left").select("id", "text", "found")
    return by_batch(rows, f"id {dict(docs.dtypes)['id']}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", run, binary=("text",)).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
