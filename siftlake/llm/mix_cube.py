"""Mixing sources to target weights (operator 3): cube-method balanced sampling.

A source's target over its size gives each of its documents an inclusion rate; the whole part is copies that every
document gets, and the fraction is an inclusion probability that the cube method turns into 0 or 1. The flight moves
three fractional documents at a time along the null space of two constraints, tokens and document count, so that both
totals stay where they were and at least one of the three lands. It runs in buckets of about `bucket` documents; what a
bucket can't land (two documents at most) flies on with the rest of other buckets, a level up, until a source has one
bucket. The last documents, the smallest ones, land to the nearest token total.

Draws are hashes of seed, level, bucket and step, so reruns agree. Units are ordered by size and a hash of the id.

Defined cases: a null or empty text has size 0 and is mixed by count; a null source is a source, last in the order; rows
that repeat an id are separate documents; a source of no words has target 0 and takes nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, n_words

WEIGHTS = (5.0, 2.0, 1.0)
EPS = 1e-9


def targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of rows (source, size): the least water level that spends `share` of all sizes by weight, none above `most` times its source.

    A source is full when the level reaches its cap over its weight; sources sorted by that ratio fill in turn, so the
    level follows from running sums over the table of sources (a row per source, in one task).
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(most)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int"))).withColumn("cap", cap)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spend = F.sum("source_size").over(everything) * F.lit(share)
    level = (spend - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(full), F.lit(0.0)))
    # a source is full if the level without those before it is above its cap; the first that isn't sets the level for the rest
    by = by.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    at = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    return by.select("source", "source_size", F.coalesce(F.least(F.col("cap"), at["level"] * F.col("w")), F.col("cap")).alias("target"))


def draw(*key: object) -> float:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, key)).encode(), digest_size=8).digest(), "big") / 2**64


def flight(sizes: list[float], pis: list[float], key: str) -> list[float]:
    """Inclusion probabilities after the flight: 0 or 1 but for two at most, tokens and count balanced."""
    out = list(pis)
    active: list[int] = []
    for step, unit in enumerate(i for i, p in enumerate(pis) if EPS < p < 1 - EPS):
        active.append(unit)
        if len(active) < 3:
            continue
        a, b, c = (sizes[i] for i in active)
        u = (b - c, c - a, a - b)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - out[i]) / d if d > 0 else out[i] / -d for i, d in zip(active, u, strict=True) if d)
        down = min(out[i] / d if d > 0 else (1 - out[i]) / -d for i, d in zip(active, u, strict=True) if d)
        way = up if draw(key, step) < down / (up + down) else -down  # keeps each expected probability
        for i, d in zip(active, u, strict=True):
            out[i] += way * d
            out[i] = 0.0 if out[i] < EPS else 1.0 if out[i] > 1 - EPS else out[i]
        active = [i for i in active if EPS < out[i] < 1 - EPS]
    return out


def landing(sizes: list[float], pis: list[float], key: str) -> list[float]:
    """The choice of 0 or 1 for the last few units whose tokens come nearest the expected ones; ties go to a drawn choice."""
    left = [i for i, p in enumerate(pis) if EPS < p < 1 - EPS]
    want = sum(sizes[i] * pis[i] for i in left)
    best = min(range(2 ** len(left)), key=lambda m: (round(abs(sum(sizes[i] for k, i in enumerate(left) if m >> k & 1) - want), 6), draw(key, "land", m)))
    out = list(pis)
    for k, i in enumerate(left):
        out[i] = float(best >> k & 1)
    return out


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, bucket: int = 256, seed: int = 42) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row."""
    sizes = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")))
    goal = checkpointed(targets(sizes.select("source", "size"), share=share, most=most, weights=weights).join(sizes.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("docs")), F.expr("source <=> s")).drop("s"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    spread = F.abs(F.hash("id", "size", F.lit(seed)).cast("long"))
    rows = sizes.join(goal.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s").select(
        "id", "source", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("pi"),
        F.pmod(spread, F.ceil(F.col("docs") / bucket)).cast("long").alias("bucket"), F.ceil(F.col("docs") / bucket).cast("long").alias("buckets"),
        F.xxhash64("id", F.lit(seed)).alias("turn"),
    )
    kind = rows.schema

    def fly(level: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "turn"], ascending=[False, True], kind="stable")
            key = f"{seed}|{level}|{group['source'].iloc[0]}|{group['bucket'].iloc[0]}"
            sizes = group["size"].astype(float).tolist()
            pis = flight(sizes, group["pi"].tolist(), key)
            if int(group["buckets"].iloc[0]) == 1:
                pis = landing(sizes, pis, key)
            return group.assign(pi=pis)

        return run

    level, landed, most_buckets = 0, [], goal.agg(F.max(F.ceil(F.col("docs") / bucket))).first()[0] or 1
    while True:
        flown = checkpointed(rows.groupBy("source", "bucket").applyInPandas(fly(level), kind))
        if most_buckets == 1:
            landed.append(flown)
            break
        still = F.col("pi").between(EPS, 1 - EPS)
        landed.append(flown.filter(~still))
        rows = flown.filter(still).withColumn("buckets", F.ceil(F.col("buckets") / (bucket // 2))).withColumn("bucket", F.pmod("bucket", "buckets"))
        level, most_buckets = level + 1, -(-most_buckets // (bucket // 2))
    out = landed[0]
    for more in landed[1:]:
        out = out.unionAll(more)
    copies = F.col("whole") + F.col("pi").cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.col("source").alias(source_col))
