"""Streaming screening and streaming history KPIs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tussis.operators.history import kpis
from tussis.sources.versions import VersionedTable, ddl
from tussis.streaming.common import write_batches


def screen(recordings: DataFrame, gate: Callable, score: Callable, fuse: Callable, keep: Sequence[str]) -> DataFrame:
    """Gate, score and fuse each arriving recording.

    Blocked recordings leave before any feature work and get a row with the gate's status and issues and no assessment;
    ``score`` and ``fuse`` carry these two (``gate_status``, ``gate_issues``) and ``keep``, which names the recording. Only projections, filters and a union, so the same function
    serves a batch and a stream.
    """
    gated = gate(recordings).withColumns({"gate_status": F.col("status"), "gate_issues": F.array_join("issues", "; ")})
    assessed = fuse(score(gated.where("NOT coalesce(blocking, true)")))
    blocked = gated.where("coalesce(blocking, true)").select(*keep, "gate_status", "gate_issues")
    return assessed.unionByName(blocked, allowMissingColumns=True)


def history_kpi_stream(assessments: DataFrame, path: str) -> DataStreamWriter:
    """Running KPIs; every micro-batch is a new version of the table, switched in one step."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        shown = VersionedTable(batch.sparkSession, path)
        shown.replace(batch)
        shown.expire()

    return kpis(assessments).writeStream.outputMode("complete").foreachBatch(publish)


def append_versions(assessments: DataFrame, path: str, compact_at: int = 32) -> DataStreamWriter:
    """Append arriving assessments to a versioned table: a part a micro-batch, joined once there are many."""
    schema = ddl(assessments)

    def add(batch: DataFrame, batch_id: int) -> None:
        store = VersionedTable(batch.sparkSession, path)
        store.append(batch, f"batch-{batch_id}")
        store.compact(schema, compact_at)

    return assessments.writeStream.outputMode("append").foreachBatch(add)


def append_stream(assessments: DataFrame, path: str) -> DataStreamWriter:
    """Append arriving assessments, one folder per micro-batch."""
    return write_batches(assessments, path, "append")
