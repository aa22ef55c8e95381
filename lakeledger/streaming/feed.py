"""Structured Streaming into and out of tables."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.table import LakeTable


def append_stream(stream: DataFrame, table: LakeTable, checkpoint: str, app_id: str, **options):
    """Starts a query that appends each micro-batch once: a batch whose id the history already has is skipped."""
    def put(batch: DataFrame, batch_id: int) -> None:
        here = type(table)(table.spark, table.root, table.log)
        if here.exists() and any(h.get("appId") == app_id and h.get("batchId", -1) >= batch_id for h in here.history()):
            return
        here.write(batch, custom_metadata={"appId": app_id, "batchId": batch_id}, **options)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def added_since(table: LakeTable, version: int) -> DataFrame:
    """The rows of files that were added after ``version`` and are still live."""
    from ..plans.scan import scan

    old = table.at_version(version).snapshot.adds
    return scan(table.spark, table.snapshot, table.root.url, {p: a for p, a in table.snapshot.adds.items() if p not in old})
