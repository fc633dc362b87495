"""Quality classifier (operator 6): co-training.

Two views of a page: `text`, hashed words of its content, and `meta`, what is known of the page without reading it - its
source, language and length, and the layout of its characters and lines. A logistic classifier of each view is fitted on
labelled documents; over `rounds`, each view labels the unlabelled documents that it is most sure of for the other view,
which is then fitted again. Both are calibrated on labelled documents held out from training, the calibrated log-odds
are combined there, and all documents are scored where they lie.

Fitting uses at most `labelled` labelled and `unlabelled` other documents (those of least id hash), some thousand vectors
of a fixed width on the driver; everything else runs over all rows.

Defined cases: labels that are null or contradict each other on one id are left out; a null or empty text has a zero text
view and is scored by its metadata; null metadata is a value of its own; ids that repeat are scored row by row; without
labels of both kinds nothing can be fitted and every row scores 1; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .hashing import Rolling

WORDS, NAMES, CLASSES = 1024, 128, 9
SHAPES = CLASSES * CLASSES * CLASSES
META = NAMES + SHAPES + 6
_CLASS = np.full(256, 8, np.int64)  # letters beyond ASCII
_CLASS[:128] = 7
for _k, _chars in enumerate((b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"()-", b"!?")):
    _CLASS[list(_chars)] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum())
    return x / n if n else x


def text_view(text: bytes | None) -> np.ndarray:
    """Square roots of hashed word counts, of length 1."""
    if not text:
        return np.zeros(WORDS, np.float32)
    a = np.frombuffer(text.lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8)))
    words = Rolling(a).of(edge[::2], edge[1::2])
    return unit(np.sqrt(np.bincount((words >> np.uint64(40)).astype(np.int64) % WORDS, minlength=WORDS))).astype(np.float32)


def meta_view(text: bytes | None, *names: str | None) -> np.ndarray:
    """Hashed names (source, language), character-class trigrams of length 1, and scaled length and line figures."""
    out = np.zeros(META, np.float32)
    for k, name in enumerate(names):
        out[int(Rolling(f"{k}={name}".encode()).of(np.array([0]), np.array([len(f"{k}={name}".encode())]))[0] % np.uint64(NAMES))] = 0.2
    if text:
        c = _CLASS[np.frombuffer(text, np.uint8)]
        if len(c) > 2:
            out[NAMES : NAMES + SHAPES] = unit(np.sqrt(np.bincount(c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:], minlength=SHAPES)))
        lines, words = text.split(b"\n"), text.split()
        same = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(len(words), 1)
        out[NAMES + SHAPES :] = (np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, len(text) / max(len(lines), 1) / 1000, len(set(lines)) / len(lines), len(set(words)) / max(len(words), 1), same)
    return out


@dataclass
class Linear:
    w: np.ndarray
    b: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def logistic(x: np.ndarray, y: np.ndarray, *, start: Linear | None = None, l2: float = 1e-4, steps: int = 150, rate: float = 0.5) -> Linear:
    """Full-batch logistic regression with Adam; y may be soft. The two classes weigh the same."""
    w, b = (start.w.copy(), start.b) if start else (np.zeros(x.shape[1], np.float32), 0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = (y / share + (1 - y) / (1 - share)).astype(np.float32) / (2 * len(y))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        miss = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y).astype(np.float32) * weight
        g, gb = x.T @ miss + l2 * w, float(miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * (1 - t / (steps + 1))
        w, b = w - step * m / (np.sqrt(v) + 1e-8), b - step * mb / (vb**0.5 + 1e-8)
    return Linear(w.astype(np.float32), float(b))


def platt(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (of each column of odds, then the constant) of a plain logistic fit by Newton steps: calibration."""
    x, w = np.column_stack([np.atleast_2d(odds.T).T, np.ones(len(y))]), None
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class CoTrained:
    """Both views' classifiers, their calibrations and their combination."""

    text: Linear
    meta: Linear
    scale: np.ndarray  # (2, 2): slope and constant of each view
    mix: np.ndarray  # weights of the two calibrated log-odds, constant

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality by text, by metadata, and by both."""
        z = np.column_stack([self.text.odds(x_text) * self.scale[0, 0] + self.scale[0, 1], self.meta.odds(x_meta) * self.scale[1, 0] + self.scale[1, 1]])
        p = lambda o: 1 / (1 + np.exp(-np.clip(o, -30, 30)))
        return p(z[:, 0]), p(z[:, 1]), p(z @ self.mix[:2] + self.mix[2])


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray, *, rounds: int = 3, each: float = 0.1, held_out: float = 0.25) -> CoTrained:
    """xt, xm, y: labelled rows; ut, um: unlabelled ones. A round passes on the `each` share of unlabelled rows that a view is surest of, in its own shares of good and bad."""
    hold = np.zeros(len(y), bool)
    hold[:: round(1 / held_out)] = True
    train = ~hold
    extra = {"text": np.full(len(ut), np.nan), "meta": np.full(len(ut), np.nan)}  # pseudo-labels that a view has been given
    models: dict[str, Linear] = {}
    for r in range(rounds + 1):
        for view, x, u in (("text", xt, ut), ("meta", xm, um)):
            got = ~np.isnan(extra[view])
            models[view] = logistic(np.concatenate([x[train], u[got]]), np.concatenate([y[train], extra[view][got]]), start=models.get(view), steps=200 if r == 0 else 80)
        if r == rounds or not len(ut):
            break
        for view, other, u in (("text", "meta", ut), ("meta", "text", um)):
            odds = models[view].odds(u)
            free = np.isnan(extra[other])
            share, n = y[train].mean(), each * len(ut)
            top = np.argsort(-np.where(free, odds, -np.inf))[: int(n * share)]
            low = np.argsort(np.where(free, odds, np.inf))[: int(n * (1 - share))]
            extra[other][top[odds[top] > 1]] = 1.0
            extra[other][low[odds[low] < -1]] = 0.0
    scale = np.array([platt(models[v].odds(x[hold]), y[hold]) for v, x in (("text", xt), ("meta", xm))])
    z = np.column_stack([models["text"].odds(xt[hold]) * scale[0, 0] + scale[0, 1], models["meta"].odds(xm[hold]) * scale[1, 0] + scale[1, 1]])
    return CoTrained(models["text"], models["meta"], scale, platt(z, y[hold]))


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, name_cols: tuple[str, ...], labelled: int, unlabelled: int) -> CoTrained | None:
    """The model from bounded samples; None if the labels don't hold both kinds."""
    known = labels.filter("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2"))
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    turn = F.xxhash64("id")
    some = known.filter("y = y2").select("id", F.col("y").cast("double").alias("y")).join(ids, "id", "left_semi").orderBy(turn).limit(labelled)
    rest = ids.join(known, "id", "left_anti").orderBy(turn).limit(unlabelled).select("id", F.lit(None).cast("double").alias("y"))
    chosen = some.unionAll(rest).collect()  # bounded by the two limits
    y_of = {r["id"]: r["y"] for r in chosen}
    if not {0.0, 1.0} <= {r["y"] for r in chosen}:
        return None
    small = docs.sparkSession.createDataFrame([(i,) for i in y_of], f"id {dict(docs.dtypes)[id_col]}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(f"name_{k}") for k, c in enumerate(name_cols)))
    whole = F.struct(*(c for c in rows.columns if c != "id"))
    rows = rows.join(F.broadcast(small), "id").groupBy("id").agg(F.min_by(whole, F.xxhash64(whole)).alias("r")).select("id", "r.*")  # of rows that repeat an id the one of least hash

    def run(x: dict) -> dict:
        names = [x[k] for k in x if k.startswith("name_")]
        views = [tuple(zlib.compress(v.astype(np.float16).tobytes(), 1) for v in (text_view(t), meta_view(t, *n))) for t, *n in zip(x["text"], *names, strict=True)]
        return {"id": x["id"], "t": [v[0] for v in views], "m": [v[1] for v in views]}

    got = by_batch(rows, f"id {dict(docs.dtypes)[id_col]}, t binary, m binary", run, binary=("text",)).toArrow()
    ids = got["id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (y_of[ids[k]] is None, str(ids[k])))  # labelled rows first: both kinds are slices of one array
    xt, xm = (in_order(got[c], order, width) for c, width in (("t", WORDS), ("m", META)))
    del got
    pa.default_memory_pool().release_unused()
    y = np.array([y_of[ids[k]] for k in order if y_of[ids[k]] is not None])
    return cotrain(xt[: len(y)], xm[: len(y)], y, xt[len(y) :], xm[len(y) :])


def in_order(vectors, order: list[int], width: int) -> np.ndarray:
    """Compressed half-precision vectors of an Arrow column as the rows of one array, filled row by row so that no second copy is held."""
    out = np.empty((len(order), width), np.float32)
    for at, k in enumerate(order):
        out[at] = np.frombuffer(zlib.decompress(vectors[k].as_buffer()), np.float16)
    return out


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name_cols: tuple[str, ...] = ("source", "lang"), label_id: str = "doc_id", label_col: str = "quality", labelled: int = 6000, unlabelled: int = 6000, keep_from: float = 0.5) -> DataFrame:
    """Every row with all its columns and the struct `quality` (p_text, p_meta, p_good, kept), which takes the place of a column of that name."""
    spark = docs.sparkSession
    model = fitted(docs, labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("y")), id_col=id_col, text_col=text_col, name_cols=name_cols, labelled=labelled, unlabelled=unlabelled)
    sent = spark.sparkContext.broadcast(model)  # two vectors of a fixed width

    def run(x: dict) -> dict:
        n = len(x["row"])
        if sent.value is None or not n:
            p = [np.ones(n)] * 3
        else:
            texts = [None if r[text_col] is None else r[text_col].encode() for r in x["row"]]
            p = sent.value.score(np.stack([text_view(t) for t in texts]), np.stack([meta_view(t, *(None if r[c] is None else str(r[c]) for c in name_cols)) for t, r in zip(texts, x["row"], strict=True)]))
        return {"row": x["row"], "quality": [{"p_text": float(a), "p_meta": float(b), "p_good": float(c), "kept": bool(c >= keep_from)} for a, b, c in zip(*p, strict=True)]}

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "quality")).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return by_batch(rows, f"row {kind}, quality struct<p_text:double,p_meta:double,p_good:double,kept:boolean>", run).select("row.*", "quality")
