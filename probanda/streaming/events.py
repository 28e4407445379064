"""Fan-out of the event log and live stage status."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import stage_status_of_flags
from .sink import batch_sink, use_rocksdb


def fan_out(
    events: DataFrame, subscribers: dict[str, list[str]], out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Each subscriber gets the events of the names it asked for, below out/subscriber."""

    def branches(batch: DataFrame) -> dict[str, DataFrame]:
        return {f"{out}/{who}": batch.where(F.col("name").isin(names)) for who, names in subscribers.items()}

    return batch_sink(events, checkpoint, branches, trigger=trigger)


class StageFlags(StatefulProcessor):
    """State per trace: what has been seen of each of its stages, and when last.  A stage is
    forgotten ``keep_ms`` after its last event.  An event that comes later finds nothing and
    is taken for a new run: it changes the status to what it alone tells.

    A trace has few stages: one value is read and written for all of them, since each call to
    the store costs a task more than the rows do."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "stages array<string>, flags array<int>, at array<long>", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self.seen.get()
        kept = {stage: (flags, at) for stage, flags, at in zip(*before) if at + self.keep_ms > now} if before else {}
        fresh: dict[str | None, int] = {}
        for row in rows:
            fresh[row.stage] = fresh.get(row.stage, 0) | row.flags
        for stage, flags in fresh.items():
            kept[stage] = kept.get(stage, (0, 0))[0] | flags, now
        self.seen.update((list(kept), [flags for flags, _ in kept.values()], [at for _, at in kept.values()]))
        for stage in fresh:
            yield Row(trace_id=key[0], stage=stage, **{name: kept[stage][0] >> n & 1 for n, name in enumerate(FLAGS)})

    def close(self) -> None:
        pass


FLAGS = ["failure", "stage_end", "stage_start"]
KEEP_SECONDS = 86_400.0


def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per trace and stage of a batch, its kinds of events as bits."""
    for batch in batches:
        kind = batch.column("event_type")
        bits = [pc.equal(kind, name).fill_null(False).cast(pa.int32()) for name in FLAGS]
        table = pa.table([batch.column("trace_id"), batch.column("stage"), *bits], ["trace_id", "stage", *FLAGS])
        found = table.group_by(["trace_id", "stage"]).aggregate([(name, "max") for name in FLAGS])
        flags = found[f"{FLAGS[0]}_max"]
        for n, name in enumerate(FLAGS[1:], 1):
            flags = pc.add(flags, pc.multiply(found[f"{name}_max"], pa.scalar(1 << n, pa.int32())))
        yield from pa.table([found["trace_id"], found["stage"], flags], ["trace_id", "stage", "flags"]).to_batches()


def live_stage_status(
    events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, keep_seconds: float = KEEP_SECONDS
) -> StreamingQuery:
    """Status of every stage seen so far; each micro-batch writes the changed ones.

    State is one small row per trace, on disk; what it tells of a stage ends ``keep_seconds``
    after the stage's last event.  Events are put together before they are shuffled.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select("trace_id", "stage", "event_type").mapInArrow(flagged, "trace_id string, stage string, flags int")
    seen = rows.groupBy("trace_id").transformWithState(
        statefulProcessor=StageFlags(int(keep_seconds * 1000)),
        outputStructType="trace_id string, stage string, " + ", ".join(f"{f} int" for f in FLAGS),
        outputMode="update",
        timeMode="ProcessingTime",
    )
    status = seen.select("trace_id", "stage", stage_status_of_flags().alias("status"))
    return batch_sink(status, checkpoint, lambda batch: {out: batch}, mode="update", trigger=trigger)


def latest_status(changes: DataFrame) -> DataFrame:
    """Current status from the changes, read with their batch number."""
    return changes.groupBy("trace_id", "stage").agg(F.max_by("status", "batch").alias("status"))
