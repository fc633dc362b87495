"""SentencePiece encoding and decoding (operator 1): a relational lattice.

Words (see `vocabulary`) repeat, so the lattice is built once for each distinct word: for every end in a word its
substrings of bounded length are exploded, longest first, equi-joined to the piece table (a broadcast of a fixed size), and
the matches - edges of the lattice - are grouped by word and folded by a higher-order aggregate that carries the best
score, its source and its piece for every position (Viterbi). How far back an end can reach is looked up by its last
`TAIL` characters, so that few substrings are made that are no pieces. Edges are folded by end, then start, and only a
better score replaces one, so ties go to the earliest start, as in the tokenizer; scores are summed in single precision, as
there, but within a word. A character that is no piece gets an edge 10 below the least piece, and becomes its bytes.

Words are dealt by a 128-bit key and keep their partition to the fold and on to the join with the chunks' words, so edges and
paths are never shuffled, and carry the key in the place of the word. Words over `LONG` characters are cut
into overlapping parts first, so that no row holds all substrings of one, and fold with links back in pages.

Documents get their ids in chunks of about CHUNK bytes of text along each partition of the input, which is read once: a
chunk is written as its distinct words and its documents as numbers of these, some PIECE bytes of text to a row. The words'
ids are sorted by chunk within each task before they are shuffled, a row for each chunk, and meet the documents in a
co-group. Whatever waits on disk for that is compressed.

Defined cases: a null text has null ids, an empty one none; each row is encoded by itself; an empty table gives an empty
result; extra columns are ignored. A space travels as U+2581, as in the tokenizer, so a literal U+2581 in a text is decoded
to a space; every other text comes back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as v
from .common import Staged, by_batch, configured, pa_schema

CHUNK = 16 << 20
PIECE = 1 << 20
#: So many bytes of answers are sorted by chunk at a time.
SORTED = 64 << 20
TAIL = 3
LONG = 64
PAGE = 256
LINKS = 64


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def viterbi(edges: Column) -> Column:
    """Pieces along the best path; edges (end, start, score, piece) cover every end from 1 on. -c - 1 stands for an unknown character of code point c.

    The fold carries the best edge into each position so far, the last one still open: an end's first edge is put behind
    it, a better one takes its place.
    """
    link = lambda score, start, piece: F.array(F.struct(score.alias("score"), start.alias("start"), piece.alias("piece")))

    def step(done: Column, e: Column) -> Column:
        total = F.get(done, e["start"])["score"] + e["score"]
        new = link(total, e["start"], e["piece"])
        return F.when(e["end"] == F.size(done), F.concat(done, new)).when(total > F.get(done, e["end"])["score"], F.concat(F.slice(done, 1, e["end"]), new)).otherwise(done)

    def walk(done: Column) -> Column:
        begin = F.struct((F.size(done) - 1).alias("at"), none("int").alias("ids"))

        def back(t: Column, _: Column) -> Column:
            last = F.get(done, t["at"])
            return F.when(t["at"] > 0, F.struct(last["start"].alias("at"), F.concat(F.array(last["piece"]), t["ids"]).alias("ids"))).otherwise(t)

        return F.aggregate(done, begin, back, lambda t: t["ids"])

    return F.aggregate(F.sort_array(edges), link(F.lit(0.0).cast("float"), F.lit(0), F.lit(0)), step, walk)


def paged_viterbi(edges: Column, longest: int) -> Column:
    """`viterbi` for long words, edges (end, start, piece, score).

    The fold carries the best scores of the last `longest` positions alone, and links back in pages of LINKS positions, so
    that a step copies a page at most and a word's cost grows with its length, not with its square.
    """
    link_type = "struct<source:int,piece:int>"
    first = F.struct(F.lit(0).alias("at"), F.array(F.lit(0.0).cast("float")).alias("best"), none(link_type).alias("page"), none(f"array<{link_type}>").alias("pages"))

    def state(at: Column, best: Column, page: Column, pages: Column) -> Column:
        return F.struct(at.alias("at"), best.alias("best"), page.alias("page"), pages.alias("pages"))

    def step(s: Column, e: Column) -> Column:
        at, best, page, pages = s["at"], s["best"], s["page"], s["pages"]
        total = F.get(best, e["start"] - at + F.size(best) - 1) + e["score"]
        link = F.array(F.struct(e["start"].alias("source"), e["piece"].alias("piece")))
        full, from_ = F.size(page) == LINKS, F.greatest(F.lit(1), F.size(best) - longest + 1)
        grown = state(at + 1, F.concat(F.slice(best, from_, longest), F.array(total)), F.when(full, link).otherwise(F.concat(page, link)), F.when(full, F.concat(pages, F.array(page))).otherwise(pages))
        swapped = state(at, F.concat(F.slice(best, 1, F.size(best) - 1), F.array(total)), F.concat(F.slice(page, 1, F.size(page) - 1), link), pages)
        return F.when(e["end"] > at, grown).when(total > F.element_at(best, -1), swapped).otherwise(s)

    def walk(s: Column) -> Column:
        def back(t: Column, x: Column) -> Column:
            link = F.get(F.get(x["pages"], F.floor((t["at"] - 1) / LINKS).cast("int")), (t["at"] - 1) % LINKS)
            full, own = F.size(t["page"]) == LINKS, F.array(link["piece"])
            more = F.struct(
                link["source"].alias("at"), F.when(full, own).otherwise(F.concat(own, t["page"])).alias("page"),
                F.when(full, F.concat(F.array(t["page"]), t["pages"])).otherwise(t["pages"]).alias("pages"),
            )
            return F.when(t["at"] == 0, t).otherwise(more)

        def walked(x: Column) -> Column:
            begin = F.struct(x["at"].alias("at"), none("int").alias("page"), none("array<int>").alias("pages"))
            return F.aggregate(F.sequence(F.lit(1), x["at"]), begin, lambda t, _: back(t, x), lambda t: F.flatten(F.concat(F.array(t["page"]), t["pages"])))

        kept = F.array(F.struct(s["at"].alias("at"), F.concat(s["pages"], F.array(s["page"])).alias("pages")))  # bound once for the walk
        return F.get(F.transform(kept, walked), 0)

    return F.aggregate(F.array_sort(edges), first, step, walk)


def utf8(code: Column) -> Column:
    """The bytes of a code point."""
    tail = lambda k: F.shiftright(code, 6 * k).bitwiseAND(63) + 128
    head = lambda k, mark: F.shiftright(code, 6 * k) + mark
    return (
        F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(head(1, 0xC0), tail(0))).when(code < 0x10000, F.array(head(2, 0xE0), tail(1), tail(0)))
        .otherwise(F.array(head(3, 0xF0), tail(2), tail(1), tail(0)))
    )


def spelt(path: Column, vocab: v.Vocabulary) -> Column:
    """Ids of a path: an unknown character becomes its bytes, whose ids follow each other, or the unknown piece."""
    unknown = (lambda x: F.transform(utf8(-x - 1), lambda b: b + vocab.bytes_from[0])) if vocab.bytes_from else (lambda x: F.array(F.lit(vocab.unknown)))
    return F.when(F.exists(path, lambda x: x < 0), F.flatten(F.transform(path, lambda x: F.when(x >= 0, F.array(x)).otherwise(unknown(x))))).otherwise(path)


def matches(parts: DataFrame, vocab: v.Vocabulary, *keys: str) -> DataFrame:
    """(keys, last, long, id, score) of the substrings of parts (keys, part, skip) that end after `skip` characters and are pieces, or are single characters; `last` is their end in the part."""
    spark = parts.sparkSession
    reach: dict[str, int] = {}
    for piece, _, _ in vocab.pieces:
        for k in range(1, min(TAIL, len(piece)) + 1):
            reach[piece[-k:]] = max(reach.get(piece[-k:], 0), len(piece))
    tails = spark.createDataFrame(list(reach.items()), "tail string, reach int")  # bounded by the vocabulary, as is the next
    table = spark.createDataFrame([(p, i, float(s)) for p, i, s in vocab.pieces], "piece string, id int, score float")
    ends = parts.select(*keys, "part", F.explode(F.sequence(F.col("skip") + 1, F.length("part"))).alias("last"))
    tail = F.substring("part", F.greatest(F.col("last") - TAIL, F.lit(0)) + 1, F.least(F.col("last"), F.lit(TAIL)))
    ends = ends.join(F.broadcast(tails), tail == F.col("tail"), "left")  # a tail of no piece leaves only what is shorter
    cut = ends.select(*keys, "part", "last", F.explode(F.sequence(F.least(F.coalesce("reach", F.lit(max(1, TAIL - 1))), F.col("last")), F.lit(1), F.lit(-1))).alias("long"))
    cut = cut.select(*keys, "last", "long", F.substring("part", F.col("last") - F.col("long") + 1, F.col("long")).alias("piece"))
    found = cut.join(F.broadcast(table), "piece", "left").filter("id is not null or long = 1")
    return found.select(*keys, "last", "long", F.coalesce("id", -F.ascii("piece") - 1).alias("id"), F.coalesce("score", F.lit(vocab.unknown_score).cast("float")).alias("score"))


def keyed(words: DataFrame) -> DataFrame:
    """Words with the 128-bit key that their edges travel under."""
    return words.withColumns({"w1": F.xxhash64("word"), "w2": F.xxhash64(F.lit("second"), "word")})


def short_paths(words: DataFrame, vocab: v.Vocabulary) -> DataFrame:
    """(w1, w2, ids) of distinct words (word) of LONG characters at most."""
    key = ["w1", "w2"]
    parts = keyed(words).repartition(*key).sortWithinPartitions(*key).select(*key, F.col("word").alias("part"), F.lit(0).alias("skip"))
    edge = F.struct(F.col("last").alias("end"), (F.col("last") - F.col("long")).alias("start"), "score", F.col("id").alias("piece"))
    path = matches(parts, vocab, *key).groupBy(*key).agg(F.collect_list(edge).alias("edges")).select(*key, viterbi(F.col("edges")).alias("path"))
    return path.select(*key, spelt(F.col("path"), vocab).alias("ids"))


def long_paths(words: DataFrame, vocab: v.Vocabulary) -> DataFrame:
    """(w1, w2, ids) of distinct words (word) over LONG characters."""
    key, back = ["w1", "w2"], vocab.longest - 1
    begins = keyed(words).select("*", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(PAGE))).alias("at"))
    skip = F.least(F.col("at"), F.lit(back))
    parts = begins.select(*key, "at", skip.alias("skip"), F.substring("word", F.col("at") - skip + 1, skip + PAGE).alias("part"))
    rows = matches(parts.select(*key, (F.col("at") - F.col("skip")).alias("base"), "skip", "part").repartition(*key), vocab, *key, "base")
    end = F.col("base") + F.col("last")
    edge = F.struct(end.alias("end"), (end - F.col("long")).alias("start"), F.col("id").alias("piece"), "score")
    path = rows.groupBy(*key).agg(F.collect_list(edge).alias("edges")).select(*key, paged_viterbi(F.col("edges"), vocab.longest).alias("path"))
    return path.select(*key, spelt(F.col("path"), vocab).alias("ids"))


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of about CHUNK bytes along a partition, with the chunk's number; a longer text is a chunk's last."""
    number, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        begin = 0
        for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            size += n or 0
            if size >= CHUNK or k + 1 == batch.num_rows:
                yield number, pa.concat_batches([batch.slice(begin, k + 1 - begin)]) if begin or k + 1 < batch.num_rows else batch
                begin = k + 1
                if size >= CHUNK:
                    number, size = number + 1, 0


class Numbers(dict):
    """Numbers from 0 up, in the order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def packed(x: np.ndarray) -> bytes:
    """Integers of 32 bits, their bytes apart by significance, compressed."""
    planes = np.ascontiguousarray(x.astype(np.int32, copy=False).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The `n` integers of `packed`."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def words_of(runs: list[str], cutter: v.Cutter) -> tuple[dict[str, int], list[int], list[int]]:
    """The numbers of the words of `runs` in the order of their first use; and for the runs one after the other, their words' numbers and how many these are."""
    numbers: dict[str, int] = {}
    flat, sizes = [], []
    for x in runs:
        own = cutter.cut(x)
        sizes.append(len(own))
        flat.extend([numbers.setdefault(w, len(numbers)) for w in own])
    return numbers, flat, sizes


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    last, parts = None, []
    for chunk, part in chunked(batches):
        if parts and chunk != last:
            yield last, parts
            parts = []
        last = chunk
        parts.append(part)
    if parts:
        yield last, parts


def chunk_table(rows: DataFrame, vocab: v.Vocabulary, digests: bool) -> DataFrame:
    """Rows (id, text) by chunk: a row (chunk, words) of its distinct words, then rows (chunk, id[], sizes, n, numbers, digests) of its documents, some PIECE bytes each.

    sizes: words of each document, -1 for a null text; numbers: places of these n words in the chunk's; digests: the SHA-256 of the texts that aren't null, if `digests`.
    """
    sent = rows.sparkSession.sparkContext.broadcast(vocab)
    schema = f"chunk long, words array<string>, id array<{dict(rows.dtypes)['id']}>, sizes binary, n int, numbers binary, digests binary"
    target = pa_schema(rows.sparkSession, schema)

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = v.Cutter(sent.value)
        for chunk, parts in by_chunk(batches):
            runs, held = Numbers(), []
            for part in parts:
                step = max(1, int(part.num_rows * PIECE / max(part.nbytes, 1)))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    texts = some.column(1).to_pylist()
                    own = [cutter.runs(t) for t in texts]
                    ends = np.cumsum([0, *map(len, own)])
                    used = np.fromiter(map(runs.__getitem__, chain.from_iterable(own)), np.int64, int(ends[-1]))
                    digest = b"".join(hashlib.sha256(t.encode()).digest() for t in texts if t is not None) if digests else None
                    held.append((some.column(0), np.array([t is None for t in texts]), ends, used, digest))
            words, flat, sizes = words_of(list(runs), cutter)
            flat, spans = np.array(flat, np.int32), spans_of(np.array(sizes, np.int64))
            uses = sum((np.bincount(gathered(flat, spans, used)[0], minlength=len(words)) for _, _, _, used, _ in held), np.zeros(len(words), np.int64))
            order, place = np.argsort(-uses, kind="stable"), np.zeros(len(words), np.int32)  # frequent words get small numbers, which compress
            place[order] = np.arange(len(words))
            flat, words = place[flat], list(words)
            yield row(chunk, [words[k] for k in order.tolist()], None, None, None, None, None)
            for ids, null, ends, used, digest in held:
                numbers, size = gathered(flat, spans, used)
                each = np.diff(np.concatenate([[0], np.cumsum(size)])[ends])
                yield row(chunk, None, ids.to_pylist(), packed(np.where(null, -1, each)), len(numbers), packed(numbers), digest)

    return rows.mapInArrow(run, schema)


def by_its_chunk(answers: DataFrame) -> DataFrame:
    """(chunk, rows, k, sizes, n, ids): rows (chunk, k, ids) of a task, those of a chunk in one row; k as steps."""
    schema = "chunk long, rows int, k binary, sizes binary, n int, ids binary"
    target = pa_schema(answers.sparkSession, schema)

    def told(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        chunk, k = table.column("chunk").to_numpy(), table.column("k").to_numpy()
        ids = pa.concat_arrays(table.column("ids").chunks)
        order = np.lexsort((k, chunk))
        chunk, k = chunk[order], k[order]
        flat, size = gathered(np.asarray(ids.flatten(), np.int32), spans_of(np.asarray(ids.value_lengths(), np.int64)), order)
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        at = np.concatenate([[0], np.cumsum(size)])
        out: dict[str, list] = {name: [] for name in target.names}
        for a, b in zip(edges, edges[1:], strict=False):
            own = flat[at[a] : at[b]]
            for name, x in zip(target.names, (int(chunk[a]), b - a, packed(np.diff(k[a:b], prepend=0)), packed(size[a:b]), len(own), packed(own)), strict=True):
                out[name].append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            own, size = [*own, batch], size + batch.nbytes
            if size >= SORTED:
                yield told(own)
                own, size = [], 0
        if any(batch.num_rows for batch in own):
            yield told(own)

    return answers.select("chunk", "k", "ids").mapInArrow(run, schema)


def gathered(flat: np.ndarray, spans: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[begin : begin + size] of spans[at] (begin, size), joined, and their sizes."""
    begin, size = spans[at, 0], spans[at, 1]
    where = np.arange(int(size.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else begin, size)
    return flat[where], size


def spans_of(sizes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.cumsum(sizes) - sizes, sizes]).astype(np.int64)


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = v.MODEL) -> DataFrame:
    """(id, ids) of every row."""
    return _encoded(docs, id_col, text_col, v.load(model), check=False).select(id_col, "ids")


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocab: v.Vocabulary, *, check: bool) -> DataFrame:
    """(id, ids), and if `check` (id, ids, decoded_sha256, same_text): the ids decoded again where they are made."""
    spark = docs.sparkSession
    staged = Staged(spark, "pieces")
    rows = chunk_table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocab, check)
    with configured(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):  # else the rows would be sorted by `kind`
        chunks = staged.write(rows.withColumn("kind", F.when(F.col("words").isNull(), "texts").otherwise("words")), "chunks", by="kind")
    held = chunks.filter("kind = 'words'")
    counted = staged.write(held.select(F.explode("words").alias("word")).distinct(), "words")
    wanted, is_short = keyed(held.select("chunk", F.posexplode("words").alias("k", "word"))), F.length("word") <= LONG
    met = [wanted.filter(some).select("chunk", "k", "w1", "w2").hint("merge").join(paths(counted.filter(some), vocab), ["w1", "w2"]) for some, paths in ((is_short, short_paths), (~is_short, long_paths))]
    # A word's edges come together, so they are grouped as they come; and a partition of words grows some hundredfold when it is cut, which its size doesn't tell.
    with configured(spark, {"spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        answers = staged.write(by_its_chunk(met[0].unionAll(met[1])), "answers")
    for name in ("words", "chunks/kind=words"):
        staged.drop(name)
    sent = spark.sparkContext.broadcast(Decoder(vocab) if check else None)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, ids array<int>" + (", decoded_sha256 string, same_text boolean" if check else "")
    target = pa_schema(spark, schema)

    def meet(key, texts: pa.Table, own: pa.Table) -> pa.Table:
        decode, flat, spans, base = sent.value, [], [], 0
        for rows, k, sizes, n, ids in zip(*(own.column(c).to_pylist() for c in ("rows", "k", "sizes", "n", "ids")), strict=True):
            span = spans_of(unpacked(sizes, rows).astype(np.int64)) + [[base, 0]]
            spans.append((np.cumsum(unpacked(k, rows).astype(np.int64)), span))
            flat.append(unpacked(ids, n))
            base += n
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        table = np.zeros((1 + max((int(k[-1]) for k, _ in spans), default=-1), 2), np.int64)
        for k, span in spans:
            table[k] = span
        out: list[pa.Table] = []
        for ids, sizes, n, numbers, digests in zip(*(texts.column(c) for c in ("id", "sizes", "n", "numbers", "digests")), strict=True):
            ids = ids.values
            words = unpacked(sizes.as_py(), len(ids))
            null = words < 0
            got, size = gathered(flat, table, unpacked(numbers.as_py(), n.as_py()))
            if len(size) and not size.min():
                raise ValueError("a word of a chunk has no ids")
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(np.maximum(words, 0))])]
            columns = [ids.cast(target.field("id").type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got, pa.int32()), mask=pa.array(null)).cast(target.field("ids").type)]
            if decode:
                shas, digests = [None if x else hashlib.sha256(t) for x, t in zip(null, decode.each(got, ends), strict=True)], digests.as_py()
                was = (np.cumsum(~null) - 1) * 32
                columns.append(pa.array([x and x.hexdigest() for x in shas], pa.string()))
                columns.append(pa.array([x is None or x.digest() == digests[at : at + 32] for x, at in zip(shas, was.tolist(), strict=True)], pa.bool_()))
            out.append(pa.Table.from_arrays(columns, schema=target))
        return pa.concat_tables(out) if out else target.empty_table()

    told = chunks.filter("kind = 'texts'").select("chunk", "id", "sizes", "n", "numbers", "digests")
    return told.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema).withColumnRenamed("id", id_col)


class Decoder:
    """Text of piece ids; ids outside the vocabulary raise."""

    def __init__(self, vocab: v.Vocabulary):
        byte_of = {i: b for b, i in vocab.bytes_from.items()}
        pieces = [bytes([byte_of[i]]) if i in byte_of else p.replace(v.SPACE, " ").encode() for i, p in enumerate(vocab.all_pieces)]
        self.pool, self.spans, self.prefix = np.frombuffer(b"".join(pieces), np.uint8), spans_of(np.array([len(p) for p in pieces], np.int64)), vocab.dummy_prefix

    def text(self, ids: np.ndarray) -> str:
        return next(self.each(ids, np.array([0, len(ids)]))).decode()

    def each(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The texts, as UTF-8, of the stretches of ids between `ends`."""
        if len(ids) and ids.min() < 0:
            raise IndexError("a piece id below 0")
        whole, size = gathered(self.pool, self.spans, ids)
        whole, at = whole.tobytes(), np.concatenate([[0], np.cumsum(size)])[ends].tolist()
        for a, b in zip(at, at[1:], strict=False):
            t = whole[a:b].decode("utf-8", "replace").encode()
            yield t[1:] if self.prefix and t[:1] == b" " else t


def decoded(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str = v.MODEL) -> DataFrame:
    """(id, text) of rows of piece ids; null ids give a null text, ids outside the vocabulary raise. A literal U+2581 comes back as a space."""
    decoder = Decoder(v.load(model))

    def run(x: dict) -> dict:
        return {"id": x["id"], "text": [None if ids is None else decoder.text(np.array(ids, np.int64)) for ids in x["ids"]]}

    kind = dict(rows.dtypes)[id_col]
    return by_batch(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), f"id {kind}, text string", run).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = v.MODEL) -> DataFrame:
    """(id, ids, decoded_sha256, same_text): every row encoded and decoded again; same_text is false where the text doesn't come back."""
    return _encoded(docs, id_col, text_col, v.load(model), check=True)
