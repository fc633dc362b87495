"""States of experiment runs over a stream of their events.

Events are (run, seq, kind, config, artifact): kind is start, resume, artifact, complete, fail or interrupt, seq orders the events of
a run, config is the hash of what the run was started with, artifact names a file that an `artifact` event reports. The config of a
run's first start is the run's own: events with another config are refused, as a resume of a changed experiment is. The status is
that of the last event that isn't refused, and COMPLETED only while all required artifacts are reported, FAILED otherwise; a run
without a start is PENDING.

What is kept of a run is, for each config, the first start, the last event and the artifacts seen. Merging is a minimum, a maximum
and a union, so repeated and late events in any order and any batches give what one batch over all events gives.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row
from pyspark.sql.window import Window

#: What a completed run must have, and the statuses by kind of the last event.
ARTIFACTS = ("config", "history", "metrics", "confusion", "best", "latest", "summary")
STATUS = {"start": "RUNNING", "resume": "RUNNING", "complete": "COMPLETED", "fail": "FAILED", "interrupt": "INTERRUPTED"}

EVENT = "run string, seq long, kind string, config string, artifact string"
STATE = "run string, status string, config string, last_seq long, artifacts int, refused int"
_KEPT = "configs array<struct<config string, first_start long, last_seq long, last_kind string, artifacts array<string>>>"


def batch_states(events: DataFrame, required: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """(STATE) of every run with an event: the rules over a whole table. Events without run, seq or kind count nowhere; a null config is ''."""
    own = events.filter("run is not null and seq is not null and kind is not null").withColumn("config", F.coalesce("config", F.lit("")))
    acts = F.col("kind") != "artifact"
    each = own.groupBy("run", "config").agg(
        F.min(F.when(F.col("kind") == "start", F.col("seq"))).alias("first_start"), F.max(F.when(acts, F.struct("seq", "kind"))).alias("last"),
        F.count_distinct(F.when(~acts & F.col("artifact").isin(*required), F.col("artifact"))).alias("artifacts"),
    )
    order = Window.partitionBy("run").orderBy(F.col("first_start").asc_nulls_last(), "config")  # a row a config
    first = each.select("*", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("run")).alias("configs")).filter("k = 1")
    return first.select("run", *_judged(F, len(required)))


def _judged(f, n: int) -> list:
    """Status, config, last_seq, artifacts and refused of the columns first_start, last, artifacts, configs."""
    known, kind = f.col("first_start").isNotNull(), f.col("last.kind")
    named = f.create_map(*(f.lit(x) for pair in STATUS.items() for x in pair))
    status = f.when(~known, "PENDING").when((kind == "complete") & (f.col("artifacts") < n), "FAILED").otherwise(f.coalesce(f.try_element_at(named, kind), f.lit("RUNNING")))
    on = lambda c: f.when(known, c)
    return [
        status.alias("status"), on(f.col("config")).alias("config"), on(f.col("last.seq")).alias("last_seq"), f.when(known, f.col("artifacts")).otherwise(0).cast("int").alias("artifacts"),
        (f.col("configs") - known.cast("int")).cast("int").alias("refused"),
    ]


class Runs(StatefulProcessor):
    """The state of one run: what is kept of the events of each config, one value that is read and written once a batch."""

    def __init__(self, required: tuple[str, ...]):
        self.required = required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh: dict[str, list[Row]] = {}
        for r in rows:
            fresh.setdefault(r["config"] or "", []).append(r)
        held = self.seen.get()
        seen = {} if held is None else {c[0]: tuple(c[1:]) for c in held[0]}
        for config, events in fresh.items():
            start, seq, kind, files = seen.get(config, (None, None, None, []))
            starts = [e["seq"] for e in events if e["kind"] == "start"] + ([] if start is None else [start])
            acts = [(e["seq"], e["kind"]) for e in events if e["kind"] != "artifact"] + ([] if seq is None else [(seq, kind)])
            files = sorted({*files, *(e["artifact"] for e in events if e["kind"] == "artifact" and e["artifact"] in self.required)})
            seen[config] = (min(starts, default=None), *max(acts, default=(None, None)), files)
        self.seen.update(([(config, *kept) for config, kept in seen.items()],))
        kept = list(seen.items())
        config, (start, seq, kind, files) = min(kept, key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))
        if start is None:
            yield Row(run=key[0], status="PENDING", config=None, last_seq=None, artifacts=0, refused=len(kept))
            return
        status = "FAILED" if kind == "complete" and len(files) < len(self.required) else STATUS.get(kind, "RUNNING")
        yield Row(run=key[0], status=status, config=config, last_seq=seq, artifacts=len(files), refused=len(kept) - 1)

    def close(self) -> None:
        pass


def run_states(events: DataFrame, required: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """(STATE) updates of a stream of events: of each batch, the runs that it has events of."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = events.filter("run is not null and seq is not null and kind is not null").select("run", "seq", "kind", "config", "artifact")
    return own.groupBy("run").transformWithState(statefulProcessor=Runs(required), outputStructType=STATE, outputMode="Update", timeMode="None")


def write_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes updates as they come, a folder a batch; a batch that is run again after a loss replaces its folder, so that each update stands once. Stops when what is there is read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """(STATE): the newest update of every run in a folder of updates."""
    rows = spark.read.schema(f"{STATE}, batch long").parquet(path)
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    return rows.groupBy("run").agg(F.max_by(F.struct(*names[1:]), "batch").alias("now")).select("run", "now.*")
