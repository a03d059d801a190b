"""Benchmark decontamination: broadcast n-gram windows, scan every text, verify, remove.

A word is a run of digits, letters a-z (A-Z lower-cased) or any non-ASCII characters. A window is
13 consecutive words of a benchmark item; an item of 1 to 12 words is one window. Document words
inside any occurrence of a window are hit. A document is contaminated when at least a twentieth
of its words is hit.

Windows are found by a 64-bit rolling hash against a broadcast set and then verified byte by
byte, so a hash collision never counts. The broadcast holds at most BLOCK_BYTES of benchmark text
(one item more at most); a larger benchmark is scanned in blocks, one pass each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.common import U64, Words, lower_ascii, text_chunks

WINDOW = 13
#: Benchmark text per broadcast, in bytes; a pass over the documents for each block.
BLOCK_BYTES = 32 << 20
MIN_SHARE = 20  # contaminated from 1/20 of the words

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Stream:
    """The words of a chunk joined by zero bytes, so that a window is one slice of bytes."""

    def __init__(self, data: np.ndarray, words: Words):
        lengths = words.ends - words.starts
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])
        stream = np.zeros(int(self.at[-1]), dtype=np.uint8)
        inside = _IS_WORD[data]
        stream[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[inside]
        self.bytes = stream.tobytes()

    def window(self, i: int, n: int) -> bytes:
        return self.bytes[self.at[i] : self.at[i + n] - 1]


class WindowSet:
    """Windows of one block of items: for each length the sorted hashes; the items by exact bytes."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.items: dict[bytes, tuple] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            for _, _, raw, offsets in text_chunks(pa.array([text or ""])):
                data = lower_ascii(raw)
                words = Words(data, offsets, _IS_WORD)
                n = min(window, len(words.starts))
                if not n:
                    continue
                at, h = words.ngrams(n)
                hashes.setdefault(n, []).append(h)
                stream = _Stream(data, words)
                for i in at.tolist():
                    key = stream.window(i, n)
                    have = self.items.get(key, ())
                    if item_id not in have:
                        self.items[key] = (*have, item_id)
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in hashes.items()}
        self.maps = {}
        for n, h in self.hashes.items():
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(h & U64((1 << 22) - 1)).astype(np.int64)] = True
            self.maps[n] = np.packbits(bits)

    def candidates(self, n: int, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        low = (h & U64((1 << 22) - 1)).astype(np.int64)
        maybe = np.flatnonzero((self.maps[n][low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1)
        known = self.hashes[n]
        place = np.searchsorted(known, h[maybe])
        place[place == len(known)] = 0
        return at[maybe[known[place] == h[maybe]]]


def _scan_chunk(raw: np.ndarray, offsets: np.ndarray, windows: WindowSet, old_spans: list, old_items: list) -> list[tuple]:
    data = lower_ascii(raw)
    words = Words(data, offsets, _IS_WORD)
    n_rows = len(offsets) - 1
    change = np.zeros(len(words.starts) + 1, dtype=np.int64)
    items: dict[int, set] = {r: set(x) for r, x in enumerate(old_items) if x}
    for r, spans in enumerate(old_spans):
        for span in spans or ():
            lo, hi = np.searchsorted(words.starts, [span["start"] + offsets[r], span["end"] + offsets[r]])
            change[lo] += 1
            change[hi] -= 1
    stream = None
    for n in windows.hashes:
        found = windows.candidates(n, *words.ngrams(n))
        if len(found) and stream is None:
            stream = _Stream(data, words)
        for i in found.tolist():
            ids = windows.items.get(stream.window(i, n))
            if ids is not None:
                change[i] += 1
                change[i + n] -= 1
                items.setdefault(int(words.row[i]), set()).update(ids)
    hit = np.cumsum(change[:-1]) > 0
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.bounds])
    # runs of hit words, cut at rows, as byte ranges of the row's text
    spans: dict[int, list] = {}
    if hit.any():
        fresh = hit.copy()
        fresh[1:] &= ~(hit[:-1] & (words.row[1:] == words.row[:-1]))
        final = hit.copy()
        final[:-1] &= ~(hit[1:] & (words.row[1:] == words.row[:-1]))
        for a, b in zip(np.flatnonzero(fresh).tolist(), np.flatnonzero(final).tolist(), strict=True):
            r = int(words.row[a])
            spans.setdefault(r, []).append({"start": int(words.starts[a] - offsets[r]), "end": int(words.ends[b] - offsets[r])})
    key = lambda x: "" if x is None else str(x)
    return [(int(words.counts[r]), int(n_hit[r]), sorted(items.get(r, ()), key=key), spans.get(r, [])) for r in range(n_rows)]


def _pass(df: DataFrame, windows: WindowSet, keep: list[str], first: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(windows)
    fields = [f for f in df.schema.fields if f.name in keep]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(batch.schema.get_field_index("text")), []
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("spans", "item_ids")] if not first else None
            for lo, hi, raw, offsets in text_chunks(texts):
                old = [x[lo:hi] for x in before] if before else [[], []]
                rows += _scan_chunk(raw, offsets, shared.value, *old)
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], _SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.name for f in RESULT)])

    return df.mapInArrow(run, T.StructType([*fields, *RESULT]))


def scan(documents: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of every document with n_words, n_hit, item_ids, spans and contaminated.

    spans are byte ranges of the text that hold hit words. Null and empty texts have no words and
    are not contaminated; null items have no windows; repeated rows are judged alike; an empty
    benchmark hits nothing. Columns of documents that bear a result's name are replaced.
    """
    ours = {f.name for f in RESULT} | {"contaminated"}
    keep = [c for c in keep if c not in ours]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    df = documents.select(*dict.fromkeys([*keep, "text"]))
    for b in range(n_blocks):
        part = items.where(block == b) if n_blocks > 1 else items
        windows = WindowSet([(r["item_id"], r["text"]) for r in part.collect()])
        last = b == n_blocks - 1
        df = _pass(df, windows, keep if last else [*dict.fromkeys([*keep, "text"])], first=not b)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """documents without contaminated rows, or (remove="spans") with the hit words cut out of every text.

    The columns are those of documents. In a text, each span goes with nothing put in its place.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    names = documents.columns
    inner = documents.toDF(*[f"_c{i}" if c != "text" else c for i, c in enumerate(names)])
    marked = scan(inner, benchmark, inner.columns)
    if remove == "documents":
        marked = marked.where(~F.col("contaminated"))
    else:
        marked = marked.withColumn("text", _cutter()("text", "spans"))
    return marked.select(*inner.columns).toDF(*names)


def _cutter() -> Callable:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            if text is None or cuts is None or not len(cuts):
                out.append(text)
                continue
            raw, at, parts = text.encode(), 0, []
            for span in cuts:
                parts.append(raw[at : span["start"]])
                at = span["end"]
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return cut


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(documents, benchmark, ["doc_id"])
    ids = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM docs, lengths, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS t(i)),
hits AS (SELECT DISTINCT p.rid, p.n, p.i FROM places p SEMI JOIN windows v ON p.n = v.n AND p.win = v.win),
hit_words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY rid),
hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT p.rid, CAST(v.item_id AS VARCHAR) AS item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win)
  GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""
