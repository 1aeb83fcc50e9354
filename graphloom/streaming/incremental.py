"""Evaluation records that arrive over time: exactly-once batch files, so that an interrupted run resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of records as one Parquet folder a micro-batch: a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
