"""The correction log as a stream: decisions dropped into a folder are appended as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_corrections

DECISIONS = "record_id string, source string, decision string, corrected_match_id string, components array<string>, score double"


def review_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DECISIONS).json(folder)


def batch_writer(log: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to the log as a commit named by the stream's checkpoint and the batch, so that a batch that is replayed replaces itself."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        append_corrections(batch.where("record_id is not null and decision in ('accept', 'reject')"), log, f"{stream}-{number}")

    return write


def log_reviews(decisions: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is appended with its time, once; malformed rows are left out."""
    return decisions.writeStream.foreachBatch(batch_writer(log, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
