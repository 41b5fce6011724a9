"""Scoring a stream: prediction keeps nothing between rows, so a stored model maps over a stream as over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Model, predict


def score_stream(stream: DataFrame, model: Model, path: str, checkpoint: str, keep: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes keep and prediction as Parquet; a restarted query goes on where it stopped."""
    out = predict(stream, model, keep).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
