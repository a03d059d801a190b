"""Language identification by bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its frequent character 3- and 4-grams; the filters share their
hash functions and are stored bit-sliced: cell i holds a bitmask with one bit for each language, in
as many words of 64 bits as the languages need. One look-up (the AND of HASHES cells) returns all languages that contain an n-gram. A text's count
for a language is the number of its n-grams with that bit; with the filter's false-positive rate p
(its fill to the power HASHES) the share of true members is estimated as (count / n - p) / (1 - p).
The language with the greatest estimate wins.

The filters' size depends on the languages alone, not on the documents: MAX_GRAMS n-grams a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.common import IS_LETTER, U64, Scratch, code_points, mix64, stable_hash, text_chunks
from kinetrace.llm.learning import held_out, share_limit

CELL_BITS, HASHES = 20, 2
#: Bounds of the fit: training rows read (one a language at least), n-grams a language.
SAMPLE_ROWS, MAX_GRAMS = 20_000, 50_000
#: An n-gram belongs to a language in which it is at least this share as frequent as in its best one.
MEMBER_SHARE = 0.2
_SPACE = 0x20


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all 3- and 4-grams, and whether each row has a letter.

    Characters that aren't letters count as one space each; a gram has letters inside and may have
    a space at either end. Grams never cross rows, but a row's ends count as spaces.
    """
    cp, rows_at = code_points(raw, offsets)
    n_rows = len(rows_at) - 1
    lengths = np.diff(rows_at)
    letter = IS_LETTER[cp]
    has_letter = np.diff(np.concatenate([[0], np.cumsum(letter)])[rows_at]) > 0
    # two spaces between rows, so that no gram with letters inside crosses
    stream = np.full(len(cp) + 2 * n_rows + 2, _SPACE, dtype=np.uint32)
    shift = np.repeat(2 * np.arange(n_rows) + 2, lengths)
    stream[np.arange(len(cp)) + shift] = np.where(letter, cp, _SPACE)
    inner = stream != _SPACE
    row_of = np.searchsorted(rows_at + 2 * np.arange(n_rows + 1), np.arange(len(stream)) - 2, side="right") - 1
    wide = stream.astype(U64)
    rows, hashes = [], []
    for n in (3, 4):
        m = len(stream) - n + 1
        ok = inner[1 : m + 1].copy()
        for j in range(2, n - 1):
            ok &= inner[j : j + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, dtype=U64)
        for j in range(n):
            h = (h << U64(15)) + h + wide[at + j]
        rows.append(np.clip(row_of[at + 1], 0, max(0, n_rows - 1)))
        hashes.append(mix64(h))
    return np.concatenate(rows), np.concatenate(hashes), has_letter


def _cells(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> U64(k * CELL_BITS)) & U64((1 << CELL_BITS) - 1)).astype(np.int64)


class LanguageFilters:
    def __init__(self, members: dict[str, np.ndarray], weights: dict[str, int]):
        """members: the n-gram hashes of each language; weights: its training rows."""
        self.names = sorted(members)
        self.cells = np.zeros((-(-len(members) // 64), 1 << CELL_BITS), dtype=U64)
        self.false_rate = np.zeros(len(self.names))
        for l, name in enumerate(self.names):
            for k in range(HASHES):
                self.cells[l // 64, np.unique(_cells(members[name], k))] |= U64(1 << l % 64)
            fill = ((self.cells[l // 64] >> U64(l % 64)) & U64(1)).mean()
            self.false_rate[l] = fill**HASHES
        self.default = max(range(len(self.names)), key=lambda l: (weights.get(self.names[l], 0), -l)) if self.names else 0

    def estimate(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of each row of a chunk."""
        n_rows = len(offsets) - 1
        row, h, has_letter = grams(raw, offsets)
        if not self.names:
            return np.full(n_rows, -1), np.zeros(n_rows)
        n = np.maximum(1, np.bincount(row, minlength=n_rows))
        share = np.empty((n_rows, len(self.names)))
        for l, p in enumerate(self.false_rate):
            if l % 64 == 0:
                mask = self.cells[l // 64, _cells(h, 0)]
                for k in range(1, HASHES):
                    mask &= self.cells[l // 64, _cells(h, k)]
            count = np.bincount(row, weights=((mask >> U64(l % 64)) & U64(1)).astype(np.float64), minlength=n_rows)
            share[:, l] = np.maximum(0.0, (count / n - p) / (1 - p))
        total = share.sum(axis=1)
        best = np.where(total > 0, share.argmax(axis=1), self.default)
        score = np.where(total > 0, share.max(axis=1) / np.where(total > 0, total, 1), 1 / len(self.names))
        return np.where(has_letter, best, -1), np.where(has_letter, score, 0.0)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition; the sample that feeds it is bounded."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        names = sorted(set(langs))
        code = np.searchsorted(np.array(names, dtype=object), langs) if names else langs
        found: dict[int, list] = {}
        for lo, hi, raw, offsets in text_chunks(batch.column(0)):
            row, h, _ = grams(raw, offsets)
            of = code[lo:hi][row]
            for l in np.unique(of).tolist():
                found.setdefault(l, []).append(np.unique(h[of == l], return_counts=True))
        for l, parts in found.items():
            h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([names[l]] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Filters of all languages from about sample_rows rows with one outside the held-out fold.

    The driver holds a count and up to MAX_GRAMS n-grams of each language.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # as many rows of each language as of any other, where there are enough
    each = max(1, sample_rows // max(1, len(sizes)))
    table = spark.createDataFrame([(lang, share_limit(each, n)) for lang, n in sizes.items()], "lang string, upto long")  # one row a language
    chosen = rows.join(F.broadcast(table), "lang").where(stable_hash(11, "doc_id") <= F.col("upto"))
    counts = scratch.keep(chosen.select("text", "lang").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    members = rates.join(best, "gram").where((F.col("n") > 1) & (F.col("rate") >= MEMBER_SHARE * F.col("best")))
    top = members.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).where(F.col("place") <= MAX_GRAMS)
    out: dict[str, list[int]] = {lang: [] for lang in sizes}
    for r in top.select("lang", "gram").collect():
        out[r["lang"]].append(r["gram"])
    scratch.drop("grams")
    return LanguageFilters({k: np.array(v, dtype=np.int64).view(U64) for k, v in out.items()}, sizes)


def identify(documents: DataFrame, filters: LanguageFilters, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with lang_pred and score (0 to 1).

    `und` and 0 for null texts and texts without a letter. Texts whose letters form no n-gram of
    any language get the most frequent language; ties go to the first language by name. Repeated
    rows get equal results; columns lang_pred and score are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    df = documents.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.names, "und"], dtype=object)
        for batch in batches:
            langs, scores = [], []
            for _, _, raw, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
                best, score = shared.value.estimate(raw, offsets)
                langs.append(names[best])
                scores.append(score)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            langs, scores = (np.concatenate(x) if x else np.zeros(0) for x in (langs, scores))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = [f for f in df.schema.fields if f.name in keep]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def digest(documents: DataFrame) -> DataFrame:
    found = identify(documents, fit(documents), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
