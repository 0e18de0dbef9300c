"""An extension: threads parsed as they arrive, one journal line per document, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadloom.operators.segment import messages


def start(stream: DataFrame, folder: str, checkpoint: str):
    """Parse each micro-batch of (doc_id, line_no, plain), whole documents at a time, and append its messages as Parquet. A repeated batch replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        messages(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
