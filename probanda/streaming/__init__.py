"""Structured Streaming forms of the batch operators.

Every query writes one folder per micro-batch and overwrites it when the batch is run
again after a failure, so a restart from the checkpoint leaves each row once.
"""

from .admission import admission_stream
from .events import fan_out, live_stage_status, latest_status
from .ingest import ingest_stream, read_committed, stream_table, stream_uploads
from .sink import batch_sink, read_batches, use_rocksdb
from .tokens import assemble_tokens, deliver_streamed

__all__ = [
    "admission_stream", "assemble_tokens", "batch_sink", "deliver_streamed", "fan_out",
    "ingest_stream", "latest_status", "live_stage_status", "read_batches", "read_committed", "stream_table",
    "stream_uploads", "use_rocksdb",
]
