"""Cartesian PCA, scree, extreme structures, k-means and representative frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["system_id", "frame_id"]


def covariance(frames: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(frames, mean, covariance with divisor n - 1) of the vectors xyz.

    Partitions are summed up next to the data; what comes to the driver is one matrix of the
    selected coordinates a partition, whatever the number of frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, None, None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float)
            if not len(x):
                continue
            m, centre = len(x), x.mean(axis=0)
            s = (x - centre).T @ (x - centre)
            if mean is None:
                n, mean, scatter = m, centre, s
            else:  # pairwise update of mean and scatter
                d = centre - mean
                scatter = scatter + s + np.outer(d, d) * (n * m / (n + m))
                mean, n = mean + d * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([scatter.tobytes()])], names=["n", "mean", "scatter"])

    n, mean, scatter = 0, None, None
    for r in frames.select("xyz").mapInArrow(run, "n long, mean binary, scatter binary").collect():
        m, centre = r["n"], np.frombuffer(r["mean"])
        s = np.frombuffer(r["scatter"]).reshape(len(centre), -1)
        if mean is None:
            n, mean, scatter = m, centre, s
        else:
            d = centre - mean
            scatter = scatter + s + np.outer(d, d) * (n * m / (n + m))
            mean, n = mean + d * (m / (n + m)), n + m
    if mean is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    return n, mean, scatter / max(n - 1, 1)


class PCA:
    """mean (1 x 3n), eigenvalues (descending), components (k x 3n; the largest loading is positive)."""

    def __init__(self, frames: DataFrame, n_components: int = 10):
        self.frames = frames
        self.n, self.mean, matrix = covariance(frames)
        self.total = float(np.trace(matrix))
        k = max(0, min(n_components, len(self.mean), self.n - 1 if self.n > 1 else 1))
        values, vectors = np.linalg.eigh(matrix) if len(matrix) else (np.zeros(0), np.zeros((0, 0)))
        self.eigenvalues = np.maximum(0, values[::-1][:k])
        components = vectors[:, ::-1][:, :k].T
        largest = np.abs(components).argmax(axis=1) if k else np.zeros(0, int)
        self.components = components * np.sign(components[np.arange(k), largest])[:, None] if k else components

    def scree(self) -> DataFrame:
        """pc (from 1), eigenvalue, fraction of the kept variance, its running sum, fraction of all."""
        spark, kept = self.frames.sparkSession, float(self.eigenvalues.sum())
        rows = [(i + 1, float(v), float(v / kept) if kept > 0 else 0.0, float(v / self.total) if self.total > 0 else 0.0) for i, v in enumerate(self.eigenvalues)]
        df = spark.createDataFrame(rows, "pc int, eigenvalue double, fraction double, total_fraction double")
        return df.withColumn("cumulative", F.sum("fraction").over(Window.orderBy("pc")))

    def project(self) -> DataFrame:
        """(system_id, frame_id, pc, value)."""
        mean, components = F.array(*[F.lit(float(x)) for x in self.mean]), self.components
        centred = F.transform(F.arrays_zip(F.col("xyz").alias("a"), mean.alias("b")), lambda p: p["a"] - p["b"])
        out = self.frames.select(*KEY, centred.alias("c"))
        dots = [F.struct(F.lit(i + 1).alias("pc"), F.aggregate(F.arrays_zip(F.col("c").alias("a"), F.array(*[F.lit(float(x)) for x in row]).alias("b")), F.lit(0.0), lambda s, p: s + p["a"] * p["b"]).alias("value")) for i, row in enumerate(components)]
        return out.select(*KEY, F.explode(F.array(*dots)).alias("p")).select(*KEY, "p.pc", "p.value")

    def extreme_frames(self, pc: int = 1, amplitude: float = 2.0, n: int = 11) -> DataFrame:
        """Structures mean + t * mode for n values of t between -amplitude and amplitude deviations."""
        sigma = float(np.sqrt(self.eigenvalues[pc - 1]))
        rows = [(step, j // 3, "xyz"[j % 3], float(self.mean[j] + t * self.components[pc - 1, j])) for step, t in enumerate(np.linspace(-amplitude * sigma, amplitude * sigma, n)) for j in range(len(self.mean))]
        return self.frames.sparkSession.createDataFrame(rows, "step int, atom int, axis string, value double")


def kmeans(points: DataFrame, k: int = 5, seed: int = 0, max_iter: int = 10) -> tuple[DataFrame, DataFrame]:
    """(labels: frame with cluster, centres: cluster with centre) of points (frame key, features array)."""
    vectors = points.withColumn("_v", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=0.0, featuresCol="_v", predictionCol="cluster").fit(vectors)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return model.transform(vectors).drop("_v"), points.sparkSession.createDataFrame(centres, "cluster int, centre array<double>")


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with the nearest centre (ties: the smaller number) and the squared distance d2."""
    rows = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("_all"))
    # k centres are one small row
    each = F.transform("_all", lambda c: F.struct(F.aggregate(F.arrays_zip(F.col("features").alias("a"), c["centre"].alias("b")), F.lit(0.0), lambda s, p: s + (p["a"] - p["b"]) * (p["a"] - p["b"])).alias("d2"), c["cluster"].alias("cluster")))
    best = points.crossJoin(F.broadcast(rows)).withColumn("_best", F.array_min(each))
    return best.select(*points.columns, F.col("_best.cluster").alias("cluster"), F.col("_best.d2").alias("d2"))


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = 10) -> DataFrame:
    """Centres after `rounds` exact steps from given ones; an empty cluster keeps its centre."""
    dims = centres.select(F.size("centre")).first()[0]
    for _ in range(rounds):
        mean = F.array(*[F.avg(F.element_at("features", d + 1)) for d in range(dims)])
        moved = assign(points, centres).groupBy("cluster").agg(mean.alias("moved"))
        rows = centres.join(moved, "cluster", "left").select("cluster", F.coalesce("moved", "centre").alias("centre")).collect()  # k rows
        centres = points.sparkSession.createDataFrame([(r["cluster"], r["centre"]) for r in rows], "cluster int, centre array<double>")
    return centres


def representatives(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """cluster, frame_id of the member nearest to the centre (ties: the earliest; -1: no member)."""
    best = assigned.groupBy("cluster").agg(F.min(F.struct("d2", "frame_id")).alias("b"))
    return centres.select("cluster").join(best, "cluster", "left").select("cluster", F.coalesce("b.frame_id", F.lit(-1)).alias("frame_id"))
