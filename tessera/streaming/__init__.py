"""Structured Streaming forms of the event operators.

Sources are file streams with declared schemas; results go to parquet under
the shared checkpoint folder (never the driver's memory), and a finished
stream is read back as a batch DataFrame.
"""

from tessera.streaming.sources import event_stream, file_stream
from tessera.streaming.sinks import latest_by_key, run_append, run_changelog
from tessera.streaming.snapshots import SnapshotTable, upsert_sink
from tessera.streaming.late import late_rows, split_late, window_counts
from tessera.streaming.operators import (
    running_totals, sliding, stream_dedupe, stream_interval_join, stream_sessions,
    tumbling,
)

__all__ = [
    "SnapshotTable", "event_stream", "file_stream", "latest_by_key", "run_append", "run_changelog", "upsert_sink",
    "late_rows", "running_totals", "sliding", "split_late", "stream_dedupe", "stream_interval_join",
    "stream_sessions", "tumbling", "window_counts",
]
