"""Tables from trajectory files: Spark reads the bytes, so any file system that Spark knows will do.

A file is one task. Long trajectories are best kept as several files, or read once and written as
Parquet: `load_trajectory(...).write.partitionBy("system_id").parquet(...)`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace import schema
from kinetrace.functions.selection import select
from kinetrace.sources import formats


def _reader(path: str, readers: dict):
    extension = os.path.splitext(path)[1].lower()
    if extension not in readers:
        raise ValueError(f"no reader for {extension!r}; known: {', '.join(sorted(readers))}")
    return readers[extension]


def load_topology(spark: SparkSession, path: str, system_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of a topology file."""
    read = _reader(path, formats.TOPOLOGIES)
    atoms, bonds = read(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return spark.createDataFrame([(system_id, *a) for a in atoms], schema.ATOMS), spark.createDataFrame([(system_id, *b) for b in bonds], schema.BONDS)


def load_trajectory(spark: SparkSession, path: str, n_atoms: int, system_id: int = 0) -> DataFrame:
    """The frames of a trajectory file, one wide row each."""
    read = _reader(path, formats.TRAJECTORIES)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                rows = []
                for number, time, box, xyz in read(bytes(content), n_atoms):
                    rows.append((system_id, number, time, None if box is None else box.ravel().tolist(), xyz.ravel().astype("float32").tolist()))
                    if len(rows) * n_atoms >= 200_000:
                        yield pd.DataFrame(rows, columns=["system_id", "frame_id", "time_ps", "box", "xyz"])
                        rows = []
                yield pd.DataFrame(rows, columns=["system_id", "frame_id", "time_ps", "box", "xyz"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema.FRAMES)


def load_xy(spark: SparkSession, path: str, system: str = "0") -> DataFrame:
    rows = formats.xy_table(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode())
    return spark.createDataFrame([(system, x, y) for x, y in rows], "system string, x double, y double")


class Universe:
    """A topology and the frames that go with it."""

    def __init__(self, atoms: DataFrame, bonds: DataFrame, frames: DataFrame):
        self.atoms, self.bonds, self.frames = atoms, bonds, frames
        first = frames.select(F.size("xyz").alias("n")).limit(1).collect()
        if first and first[0]["n"] != 3 * atoms.count():
            raise ValueError("the topology and the trajectory have different numbers of atoms")

    @classmethod
    def load(cls, spark: SparkSession, topology: str, trajectory: str) -> Universe:
        atoms, bonds = load_topology(spark, topology)
        return cls(atoms, bonds, load_trajectory(spark, trajectory, atoms.count()))

    def select_atoms(self, query: str) -> DataFrame:
        return select(self.atoms, query)
