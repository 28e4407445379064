"""Token streams to whole, checked responses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.validate import delivered_chat, verdicts
from .sink import batch_sink, use_rocksdb

TOKENS = "turn_id string, seq long, text string, is_last boolean"
PATIENCE_SECONDS = 3600.0
PAGE = 256  # pieces that are stored together


class TokenAssembler(StatefulProcessor):
    """State per unfinished turn: its pieces in pages of PAGE places, of which only those that
    get new pieces are written, and how many pieces there are.  A turn is finished when its
    last piece and every one before it have arrived, in whatever order; a turn to which
    nothing was added for ``patience_ms`` is closed unfinished.  What comes for a closed turn
    within that time is passed over.

    Each call to the store costs a task more than the rows do: pages keep their number apart
    from the number of pieces, and one timer is moved on only when it fires."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", "seqs array<long>, texts array<string>")
        self.progress = handle.getValueState("progress", "n long, last long, timer long, at long")
        self.closed = handle.getValueState("closed", "finished boolean", self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.closed.exists():
            return
        n, last, timer, _ = self.progress.get() or (0, -1, 0, 0)
        pages: dict[int, dict[int, str]] = {}
        changed: set[int] = set()
        for row in rows:
            at = row.seq // PAGE
            if at not in pages:
                pages[at] = self.stored(at) if n else {}
            if row.seq not in pages[at]:
                pages[at][row.seq] = row.text
                changed.add(at)
                n += 1
            last = row.seq if row.is_last else last
        if last >= 0 and n > last:
            yield self.close_turn(key, pages, last, timer)
            return
        for at in changed:
            self.pages.updateValue((at,), (list(pages[at]), list(pages[at].values())))
        now = timerValues.getCurrentProcessingTimeInMs()
        if not timer:
            timer = now + self.patience_ms
            self.handle.registerTimer(timer)
        self.progress.update((n, last, timer, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, last, _, at = self.progress.get()
        due = at + self.patience_ms
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
            self.progress.update((n, last, due, at))
        else:
            yield self.close_turn(key, {}, None, 0)

    def stored(self, page: int) -> dict[int, str]:
        if not self.pages.containsKey((page,)):
            return {}
        return dict(zip(*self.pages.getValue((page,))))

    def close_turn(self, key, pages: dict[int, dict[int, str]], last: int | None, timer: int) -> Row:
        """The whole text; of an unfinished turn what came without a gap."""
        have: dict[int, str] = {}
        for _, stored in self.pages.iterator():
            have.update(zip(*stored))
        for page in pages.values():
            have.update(page)
        end = last + 1 if last is not None else next(i for i in range(len(have) + 1) if i not in have)
        if timer:
            self.handle.deleteTimer(timer)
        self.pages.clear()
        self.progress.clear()
        self.closed.update((last is not None,))
        text = "".join(have[seq] for seq in range(end))
        return Row(turn_id=key[0], response_text=text, finished=last is not None)

    def close(self) -> None:
        pass


def assemble_tokens(tokens: DataFrame, patience_seconds: float = PATIENCE_SECONDS) -> DataFrame:
    """tokens(turn_id, seq, text, is_last), seq from 0, to (turn_id, response_text,
    finished)."""
    use_rocksdb(tokens.sparkSession)
    return tokens.groupBy("turn_id").transformWithState(
        statefulProcessor=TokenAssembler(int(patience_seconds * 1000)),
        outputStructType="turn_id string, response_text string, finished boolean",
        outputMode="append",
        timeMode="ProcessingTime",
    )


def deliver_streamed(
    responses: DataFrame,
    reasons: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    unfinished: str | None = None,
) -> StreamingQuery:
    """Check each finished response against its evidence and write the verdict.  Text
    that failed was already shown; it is marked undelivered, not taken back.  Turns closed
    unfinished are written to ``unfinished`` where that is given."""

    def branches(batch: DataFrame) -> dict[str, DataFrame]:
        whole = batch.where("finished").drop("finished")
        written = {out: delivered_chat(verdicts(whole.withColumnRenamed("turn_id", "query_id"), reasons))}
        if unfinished:
            written[unfinished] = batch.where("not finished").drop("finished")
        return written

    return batch_sink(responses, checkpoint, branches, trigger=trigger)
