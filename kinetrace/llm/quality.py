"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Each labeller reads simple counts of a text and votes low (0), high (1) or abstains (2). The
labellers overlap and disagree; expectation-maximisation over the counts of all vote patterns
estimates their accuracies and the share of good texts, without any true label, and gives each
pattern a posterior. The posteriors are the training labels of a linear scorer over hashed word and
word-shape features: one pass over all documents sums its weights, another one sums scores and
posteriors in BINS bins of the score, to which the calibration is fitted. Nothing is sampled, and
whatever the number of documents, the driver holds patterns (at most 3 ** labellers),
2 ** FEATURE_BITS weights and BINS bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.common import U64, PrefixHash, Scratch, Words, text_chunks
from kinetrace.llm.learning import fit_logistic

FEATURE_BITS, PIECES = 16, 16
ROUNDS = 200
#: Bins of equal width between the least and the greatest weight, for the calibration.
BINS = 1 << 14
LOW, HIGH, ABSTAIN = 0, 1, 2

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_LOWER[0x80:] = True  # bytes of other letters
_LETTER = _UPPER | _LOWER
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE)
#: Plain punctuation of running text (fixed values).
_PLAIN = np.isin(np.arange(256), [ord(c) for c in ".,;:!?'\"()-"])
#: Byte classes of word shapes: capital, small, digit; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_UPPER], _SHAPE[_LOWER], _SHAPE[_DIGIT] = ord("A"), ord("a"), ord("0")

LABELLERS = ("odd_symbols", "capitals", "bare_symbols", "short_words", "repeated_words", "stutter", "sentences", "runs", "length")


def votes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The votes of LABELLERS (columns) for each row of a chunk."""
    words = Words(raw, offsets, ~_SPACE)
    n = words.counts
    at_least = np.maximum(1, n)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[words.bounds])

    upper = _UPPER[raw]
    letters = np.maximum(1, of_bytes(_LETTER[raw]))
    visible = np.maximum(1, of_bytes(~_SPACE[raw]))
    letter_sums = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    has_letter = letter_sums[words.ends] > letter_sums[words.starts] if len(words.starts) else np.zeros(0, bool)
    last = raw[np.maximum(0, words.ends - 1)] if len(raw) else np.zeros(0, np.uint8)
    again = np.zeros(len(raw), dtype=bool)
    again[1:] = (raw[1:] == raw[:-1]) & _SYMBOL[raw[1:]]
    order = np.lexsort((words.hashes, words.row))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (words.hashes[order][1:] == words.hashes[order][:-1]) & (words.row[order][1:] == words.row[order][:-1])
    stutter = np.zeros(len(words.starts), dtype=bool)
    stutter[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.row[1:] == words.row[:-1])
    shares = (
        (of_bytes((_SYMBOL & ~_PLAIN)[raw]) / visible, 0.02, 0.005, False),
        (of_bytes(upper) / letters, 0.30, 0.10, False),
        (of_words(~has_letter) / at_least, 0.10, 0.02, False),
        (of_words(has_letter & (words.ends - words.starts <= 3)) / at_least, 0.10, 0.20, True),
        (of_words(same) / at_least, 0.85, 0.60, False),
        (of_words(stutter) / at_least, 0.10, 0.02, False),
        (of_words((last == ord(".")) | (last == ord("?"))) / at_least, 0.02, 0.05, True),
        (of_bytes(again) / at_least, 0.10, 0.02, False),
        (n, 5, 20, True),
    )
    out = np.full((len(n), len(shares)), ABSTAIN, dtype=np.int64)
    for c, (value, low, high, more_is_better) in enumerate(shares):
        out[(value < low) if more_is_better else (value > low), c] = LOW
        out[(value >= high) if more_is_better else (value <= high), c] = HIGH
    out[n == 0] = ABSTAIN
    out[n == 0, -1] = LOW
    return out


def codes(v: np.ndarray) -> np.ndarray:
    """A vote pattern as one number in base 3."""
    return v @ (3 ** np.arange(v.shape[1]))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of `high` for each pattern, accuracies [labeller, true label, vote], share of high)."""
    v = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    columns = np.arange(v.shape[1])
    # to begin with, a text is as good as no labeller calls it low
    posterior = np.where((v == LOW).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((counts @ posterior) / counts.sum(), 1e-6, 1 - 1e-6))
        chance = np.empty((v.shape[1], 2, 3))
        for y, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            for vote in range(3):
                chance[:, y, vote] = (weight @ (v == vote) + 0.01) / (weight.sum() + 0.03)
        scores = np.stack([np.log(chance[columns, y, v]).sum(axis=1) for y in (0, 1)], axis=1) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], -500, 500)))
        done, posterior = np.abs(new - posterior).max() < 1e-9, new
        if done:
            break
    return posterior, chance, prior


def hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and of each word's shape."""
    words = Words(raw, offsets, ~_SPACE)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = _SHAPE[raw]
    h = PrefixHash(shape, 2)
    head = h.ranges(words.starts, np.minimum(words.ends, words.starts + 2))
    tail = PrefixHash(shape, 3).ranges(np.maximum(words.starts, words.ends - 3), words.ends)
    features = np.concatenate([words.hashes, head + U64(2) * tail])
    return np.concatenate([words.row, words.row]), (features >> U64(64 - FEATURE_BITS)).astype(np.int64)


class QualityModel:
    def __init__(self, posterior: dict[int, float], weights: np.ndarray, calibration: tuple[float, float]):
        self.posterior, self.weights, self.calibration = posterior, weights, calibration

    def raw_scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = hashed(raw, offsets)
        n = len(offsets) - 1
        return np.bincount(row, weights=self.weights[feature], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * self.raw_scores(raw, offsets), -30, 30)))


def fit(documents: DataFrame) -> QualityModel:
    """Learn from all texts of documents; no labels are read."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch.column(0)):
                total += np.bincount(codes(votes(raw, offsets)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    rows = texts.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    known = np.array([r["pattern"] for r in rows], dtype=np.int64)
    posterior, _, _ = expectation_maximisation(known, np.array([r["n"] for r in rows], dtype=float)) if len(known) else (known, None, 0)
    table = dict(zip(known.tolist(), np.asarray(posterior, dtype=float).tolist(), strict=True))
    shared = spark.sparkContext.broadcast(table)

    def targets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.array([shared.value.get(c, 0.5) for c in codes(votes(raw, offsets)).tolist()])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << FEATURE_BITS))
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch.column(0)):
                p = targets(raw, offsets)
                row, feature = hashed(raw, offsets)
                share = 1.0 / np.maximum(1, np.bincount(row, minlength=len(p)))  # every text weighs the same
                for y, weight in ((0, 1 - p), (1, p)):
                    total[y] += np.bincount(feature, weights=(weight * share)[row], minlength=1 << FEATURE_BITS)
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(total, PIECES, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out[piece] = out.get(piece, 0) + np.frombuffer(zlib.decompress(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["piece", "sums"])

    total = np.zeros((2, 1 << FEATURE_BITS))
    width = (1 << FEATURE_BITS) // PIECES
    for r in scratch.keep(texts.select("text").mapInArrow(sums, "piece int, sums binary"), "sums").repartition("piece").mapInArrow(merge, "piece int, sums binary").collect():
        total[:, r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(r["sums"]).reshape(2, width)
    scratch.drop("sums")
    mass = total.sum(axis=1, keepdims=True)
    prior = 0.1 / (1 << FEATURE_BITS) * np.maximum(1.0, mass)
    weights = np.log((total[1] + prior[1]) / (mass[1] + 1e-9 + prior[1] * (1 << FEATURE_BITS))) - np.log((total[0] + prior[0]) / (mass[0] + 1e-9 + prior[0] * (1 << FEATURE_BITS)))
    model = QualityModel(table, weights, (0.0, 1.0))
    shared_model = spark.sparkContext.broadcast(model)

    least, width = float(weights.min()), max(float(np.ptp(weights)), 1e-9) / BINS

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch.column(0)):
                x = shared_model.value.raw_scores(raw, offsets)
                place = np.clip((x - least) / width, 0, BINS - 1).astype(np.int64)
                for k, values in enumerate((None, x, targets(raw, offsets))):
                    total[k] += np.bincount(place, weights=values, minlength=BINS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["bin", "n", "x", "p"])

    bins = texts.select("text").mapInArrow(calibrate, "bin long, n double, x double, p double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in "nxp"]).orderBy("bin").collect()
    if bins:
        n, x, p = (np.array([r[c] for r in bins]) for c in "nxp")
        mean, scale, w = fit_logistic((x / n)[:, None], p / n, n=n)
        model.calibration = (float(w[0] - w[1] * mean[0] / scale[0]), float(w[1] / scale[0]))
    return model


def score(documents: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with weak_posterior, score (0 to 1, higher: better) and predicted.

    Null and empty texts get the posterior of their only vote (too short) and the score of a text
    without features; repeated rows get equal results; columns of these names are replaced.
    """
    ours = ("weak_posterior", "score", "predicted")
    keep = [c for c in keep if c not in ours]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    df = documents.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, scores = [np.zeros(0)], [np.zeros(0)]
            for _, _, raw, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
                weak.append(np.array([shared.value.posterior.get(c, 0.5) for c in codes(votes(raw, offsets)).tolist()]))
                scores.append(shared.value.scores(raw, offsets))
            p, s = np.concatenate(weak), np.concatenate(scores)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, *ours])

    fields = [f for f in df.schema.fields if f.name in keep]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("weak_posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def digest(documents: DataFrame) -> DataFrame:
    return score(documents, fit(documents), ["doc_id"])
