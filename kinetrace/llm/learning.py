"""Parts that the learned operators share: the held-out fold, bounded samples, logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.common import Scratch, stable_hash


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant first) by Newton steps with a ridge; row i counts n[i] times."""
    n = np.ones(len(x)) if n is None else n
    mean = np.average(x, axis=0, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n))
    scale[scale == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (n * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from learning: CRC-32 of the id as text, modulo 5, is 0 (null counts as '')."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5) == 0


def hash_share(doc_id: str, bound: int, rows: int) -> Column:
    """True for about `bound` of `rows` rows, chosen by a hash of the id."""
    return stable_hash(11, doc_id) <= share_limit(bound, rows)


def share_limit(bound: int, rows: int) -> int:
    """The greatest hash of the chosen rows."""
    return int(min(1.0, bound / max(1, rows)) * (1 << 20)) * (1 << 43) - 1


def training_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, scratch: Scratch, name: str) -> DataFrame:
    """(text, y) of at most about `bound` labelled rows outside the held-out fold, chosen by a hash."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    marks = marks.where(~held_out())
    marks = marks.where(hash_share("doc_id", bound, marks.count())).select(F.col("doc_id").alias("_label_id"), "y")
    texts = documents.select(F.col("doc_id").alias("_id"), "text")
    return scratch.keep(texts.join(marks, F.col("_id") == F.col("_label_id")).select(F.coalesce("text", F.lit("")).alias("text"), "y"), name)
