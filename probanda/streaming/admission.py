"""The request limiter as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..operators.limits import MICROS, Limiter
from .sink import use_rocksdb

REQUESTS = "request_id long, identity string, at_us long, seq long"


class AdmissionProcessor(StatefulProcessor):
    """State per identity: the admitted times still inside the window, at most ``limit``."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = Limiter(self.limit, self.window_us, [r[0] for r in self.admitted.get()])
        batch = pd.concat(list(rows)).sort_values(["at_us", "seq"], kind="stable")
        verdicts = [limiter.decide(at) for at in batch["at_us"].tolist()]
        self.admitted.put([(at,) for at in limiter.admitted])
        yield batch[["request_id", "identity", "at_us", "seq"]].assign(admitted=verdicts)

    def close(self) -> None:
        pass


def admission_stream(
    requests: DataFrame, limit: int = V.RATE_LIMIT, window_seconds: float = V.RATE_WINDOW_SECONDS
) -> DataFrame:
    """requests(request_id, identity, at_us, seq) with ``admitted``.

    Batches must arrive in time order per identity; inside a batch rows are ordered
    here.  What one identity brings in one micro-batch is held in memory, so bound the
    batch at the source (maxFilesPerTrigger, maxBytesPerTrigger, maxOffsetsPerTrigger).
    """
    use_rocksdb(requests.sparkSession)
    return requests.groupBy("identity").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(limit, int(window_seconds * MICROS)),
        outputStructType=REQUESTS + ", admitted boolean",
        outputMode="append",
        timeMode="None",
    )
