"""Row-level gates over a stream of detections: an extension, since the batch operators define the results.

The gates look at one detection at a time and need no state. Suppression needs a
frame's boxes together, so that it runs on micro-batches which hold whole frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomline.operators import cascade


def gated(detections: DataFrame, image: tuple[float, float] | None) -> DataFrame:
    """A streaming DataFrame of detections with the first gate each meets (null: on to suppression)."""
    return cascade.gate(detections, image)


def write_verdicts(detections: DataFrame, image: tuple[float, float] | None, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's verdicts to Parquet; a batch that is repeated after a failure replaces its own folder."""

    def batch(rows: DataFrame, epoch: int) -> None:
        cascade.cascade(rows, image, keys).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return detections.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
