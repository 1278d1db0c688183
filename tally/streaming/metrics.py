"""Confusion counters over a stream of scored rows (Structured Streaming).

The reference has no streaming; this applies the batch M1 aggregate
incrementally. Rows arriving in micro-batches update per-group tp/fp/fn/tn in
the state store (complete output mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tally.operators.metrics import confusion


def streaming_confusion(stream: DataFrame, keys: list[str], score: str = "score", label: str = "y",
                        threshold: float = 0.5, op: str = ">="):
    """A streaming DataFrame of running confusion counts per group."""
    return confusion(stream, keys, score, label, threshold, op)


def start_memory_sink(counts: DataFrame, name: str, checkpoint: str):
    """Write the running counts to an in-memory table (tests / notebooks)."""
    return (counts.writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).start())
