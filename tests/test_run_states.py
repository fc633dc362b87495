"""Run states from a stream equal the batch rules, whatever the order, batches, repeats and restarts."""

from __future__ import annotations

import random

import pytest

from siftlake.streaming import run_states as rs


def fold(events):
    """The rules by hand: sorted events of a run."""
    events = [(seq, kind, config or "", artifact) for _, seq, kind, config, artifact in events]
    configs = {e[2] for e in events}
    starts = sorted((s, c) for s, k, c, _ in events if k == "start")
    if not starts:
        return "PENDING", None, None, 0, len(configs)
    config = starts[0][1]
    files = {a for _, k, c, a in events if k == "artifact" and c == config and a in rs.ARTIFACTS}
    seq, kind = max((s, k) for s, k, c, _ in events if c == config and k != "artifact")
    status = {"start": "RUNNING", "resume": "RUNNING", "complete": "COMPLETED", "fail": "FAILED", "interrupt": "INTERRUPTED"}[kind]
    return "FAILED" if status == "COMPLETED" and len(files) < 7 else status, config, seq, len(files), len(configs) - 1


@pytest.fixture(scope="module")
def events():
    rng = random.Random(11)
    out = []
    for run in range(30):
        config = f"c{run % 4}"
        steps = [("start", None)] + [("artifact", a) for a in rs.ARTIFACTS[: rng.choice([7, 7, 5])]] + [(rng.choice(["interrupt", "fail", "complete", "complete"]), None)]
        if rng.random() < 0.5:
            steps += [("resume", None), (rng.choice(["complete", "fail"]), None)]
        if run % 7 == 3:
            steps = steps[:3]
        if run % 9 == 0:
            steps = steps[1:]
        for seq, (kind, artifact) in enumerate(steps):
            out.append((f"r{run}", seq, kind, config if kind != "resume" or rng.random() < 0.7 else "other", artifact))
    out += [("r1", 50, "artifact", "c1", "unknown"), ("r2", 51, "resume", None, None), (None, 1, "start", "c", None), ("r3", None, "start", "c", None), ("r4", 60, None, "c", None)]
    return out


def test_stream_equals_batch_after_restarts(spark, tmp_path, events):
    known = [e for e in events if e[0] and e[1] is not None and e[2]]
    want = sorted((r, *fold([e for e in known if e[0] == r])) for r in {e[0] for e in known})
    batch = rs.batch_states(spark.createDataFrame(events + events[:40], rs.EVENT))
    assert sorted(map(tuple, batch.collect())) == want and {w[1] for w in want} == {"PENDING", "RUNNING", "COMPLETED", "FAILED", "INTERRUPTED"}
    rng = random.Random(2)
    mixed = rng.sample(events, len(events))
    parts = [mixed[:60], mixed[60:150] + mixed[:20], mixed[150:] + mixed[100:130]]  # late, and repeated across batches
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, rs.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rs.EVENT).parquet(source)
        query = rs.write_states(rs.run_states(stream), out, check)  # a restart for each part
        query.awaitTermination()
        got = sorted(map(tuple, rs.current_states(spark, out).collect()))
        seen = [e for p in parts[: k + 1] for e in p]
        assert got == sorted(map(tuple, rs.batch_states(spark.createDataFrame(seen, rs.EVENT)).collect()))
    assert got == want


def test_empty(spark):
    assert rs.batch_states(spark.createDataFrame([], rs.EVENT)).count() == 0


def test_a_batch_reads_and_writes_a_runs_state_once():
    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, new):
            self.calls += 1
            self.held = new

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return state

    state, runs = Value(), rs.Runs(rs.ARTIFACTS)
    runs.init(Handle())
    events = lambda first: [{"seq": k, "kind": "start" if k % 5 == 0 else "resume", "config": f"c{k % 4}", "artifact": None} for k in range(first, first + 40)]
    out = [list(runs.handleInputRows(("r",), iter(events(first)), None)) for first in (40, 0)]
    assert state.calls == 4 and [(o[0]["status"], o[0]["config"], o[0]["last_seq"], o[0]["refused"]) for o in out] == [("RUNNING", "c0", 76, 3), ("RUNNING", "c0", 76, 3)]
