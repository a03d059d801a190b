"""Arriving frames: operators that look at one frame at a time run on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace import schema
from kinetrace.operators import frames, superposition


def stream_frames(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the frame tables that arrive in a folder as Parquet."""
    return spark.readStream.schema(schema.FRAMES).parquet(folder)


def stream_rmsd(stream: DataFrame, atoms: DataFrame, reference: DataFrame, out: str, checkpoint: str):
    """Append (system_id, frame_id, rmsd) of each arriving frame to a Parquet folder; returns the query."""

    def step(batch: DataFrame, number: int) -> None:
        coords = frames.weighted(frames.long_coords(batch), atoms)
        superposition.rmsd(coords, reference).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
