"""Removal of repeated long strings by a logarithmic family of sparse suffix arrays.

Each byte that lies in a WINDOW-byte string which also starts anywhere else (in any text, the same
one included) is removed. Exact:

1. Texts are taken once each; a text of WINDOW bytes or more that occurs twice goes wholly.
2. Every window has an anchor: the position of the least 8-gram hash (leftmost on ties) among its
   first WINDOW - PREFIX + 1. Equal windows have their anchors at equal offsets, so only suffixes
   that start at anchors (one in about 30 bytes) are indexed. The windows of an anchor are a run of
   starts lo .. hi.
3. The texts come in batches. A batch's anchored suffixes are sorted into a suffix array (by the
   fingerprint of their first PREFIX bytes; only equality of prefixes is asked for, so any order of
   prefixes does). It is merge-scanned against every level of the index: suffixes that agree in
   PREFIX bytes with one of their own batch or of a level are matches. Then it joins the index,
   and levels of equal size merge, as the carries of a binary counter.
4. Matches are narrowed to windows: a match whose whole stretch lo .. hi + WINDOW occurs twice is
   settled at once. Where matches of one prefix differ in their stretches, each window of every
   different stretch (taken once) is looked up by a 96-bit fingerprint.

The arrays are cut into buckets by fingerprint, and a bucket is the unit of work: NB grows with
the input, so a bucket's size does not. A task sends one entry for each fingerprint at most (its
further occurrences are matches by themselves), so a passage in a third of all texts costs one
entry a task and bucket. Removal happens on whole texts, in chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.common import U64, PrefixHash, Scratch, guarded, text_chunks

WINDOW, PREFIX = 200, 140
BATCHES = 4
#: Text bytes for each bucket (about a thirtieth as many suffixes), and the least number of buckets.
BUCKET_BYTES, MIN_BUCKETS = 64 << 20, 16
#: Entries that a task gathers before it sends them.
RUN_ENTRIES = 1 << 20

PIECE = "kind int, batch int, bucket int, level int, n int, keys binary, refs binary, id long, lo int, hi int"
_NAMES = ["kind", "batch", "bucket", "level", "n", "keys", "refs", "id", "lo", "hi"]
MATCH, ENTRIES = 0, 1


def _gram_order(data: np.ndarray) -> np.ndarray:
    """Hash of the 8 bytes at each position above the position itself: the least is the anchor."""
    n = len(data)
    grams = np.ndarray((n,), dtype="<u8", buffer=data.tobytes() + b"\0" * 8, strides=(1,))
    order = ((grams * U64(0x9E3779B97F4A7C15)) ^ (grams >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return (order & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi) of the anchors of a chunk, in order; positions are of the chunk."""
    n, width = len(data), WINDOW - PREFIX + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none
    order = _gram_order(data)
    blocks = -(-(n + width) // width)
    padded = np.full(blocks * width, U64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = order
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    if not len(starts):
        return none, none, none
    anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(starts)) - 1
    return anchor[at], starts[at], starts[last]


class _Entries:
    """Fingerprints with the text and the window starts that they stand for."""

    fields = (("key", np.uint64), ("check", np.uint32), ("id", np.int64), ("lo", np.int32), ("hi", np.int32))

    def __init__(self, *columns: np.ndarray):
        self.columns = columns

    @classmethod
    def concat(cls, parts: list[_Entries]) -> _Entries:
        return cls(*(np.concatenate([p.columns[i] for p in parts]) if parts else np.zeros(0, t) for i, (_, t) in enumerate(cls.fields)))

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, at: np.ndarray) -> _Entries:
        return _Entries(*(c[at] for c in self.columns))

    def sorted(self) -> _Entries:
        key, check = self.columns[:2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if len(key) and check.any() and (key[1:] == key[:-1]).any():
            order = order[np.lexsort((check[order], key))]
        return self.take(order)

    def same_as_before(self) -> np.ndarray:
        """For sorted entries: whether each has the fingerprint of the one before it."""
        key, check = self.columns[:2]
        same = np.zeros(len(key), dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        return same

    def packed(self) -> tuple[int, bytes, bytes]:
        """Fingerprints don't compress; of the rest, steps between neighbours do."""
        key, check, *rest = self.columns
        steps = b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in rest)
        return len(key), key.tobytes() + (check.tobytes() if check.any() else b""), zlib.compress(steps, 1)

    @classmethod
    def unpacked(cls, n: int, keys: bytes, refs: bytes) -> _Entries:
        key = np.frombuffer(keys, np.uint64, n)
        check = np.frombuffer(keys, np.uint32, n, 8 * n) if len(keys) > 8 * n else np.zeros(n, np.uint32)
        raw, at, rest = zlib.decompress(refs), 0, []
        for _, t in cls.fields[2:]:
            size = n * np.dtype(t).itemsize
            rest.append(np.cumsum(np.frombuffer(raw[at : at + size], t), dtype=t))
            at += size
        return cls(key, check, *rest)


def _batch(kind: int, rows: list[tuple], matches: _Entries | None = None) -> pa.RecordBatch:
    """A record batch of PIECE: either packed rows (batch, bucket, level, n, keys, refs) or matches."""
    if matches is not None:
        n = len(matches)
        ints, binary = pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
        arrays = [pa.array(np.full(n, MATCH, np.int32)), pa.array(np.zeros(n, np.int32)), ints, ints, ints, binary, binary, *(pa.array(c) for c in matches.columns[2:])]
    else:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        n = len(rows)
        arrays = [pa.array(np.full(n, kind, np.int32)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _pieces(found: list[_Entries], batch: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task sends: one entry for each fingerprint in its bucket; repeats within are matches."""
    entries = _Entries.concat(found)
    if not len(entries):
        return
    ordered = entries.sorted()
    again = ordered.same_as_before()
    repeated = again.copy()
    repeated[:-1] |= again[1:]
    if repeated.any():
        yield _batch(MATCH, [], ordered.take(np.flatnonzero(repeated)))
    single = ordered.take(np.flatnonzero(~again))
    bucket = ((single.columns[0] >> U64(32)) % U64(buckets)).astype(np.int64)
    # by bucket, then in the order of the texts, where references compress
    order = np.lexsort((single.columns[3], single.columns[2], bucket))
    single, bucket = single.take(order), bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(batch, b, -1, *single.take(slice(cuts[b], cuts[b + 1])).packed()) for b in range(buckets) if cuts[b] < cuts[b + 1]]
    yield _batch(ENTRIES, rows)


def _send(texts: DataFrame, make: Callable, batches: int, buckets: int) -> DataFrame:
    """Pieces of the entries that make(data, offsets, ids, first row, end row, batch) finds."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[_Entries]] = {b: [] for b in range(batches)}
        sizes = dict.fromkeys(held, 0)
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in text_chunks(part.column(1)):
                entries = make(raw, offsets, ids[lo:hi], part.slice(lo, hi - lo))
                of = (entries.columns[2] % batches) if batches > 1 else np.zeros(len(entries), np.int64)
                for b in range(batches):
                    mine = entries.take(np.flatnonzero(of == b)) if batches > 1 else entries
                    if len(mine):
                        held[b].append(mine)
                        sizes[b] += len(mine)
                        if sizes[b] >= RUN_ENTRIES:
                            yield from _pieces(held[b], b, buckets)
                            held[b], sizes[b] = [], 0
        for b in range(batches):
            yield from _pieces(held[b], b, buckets)

    return texts.mapInArrow(run, PIECE)


def _anchor_entries(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, _) -> _Entries:
    anchor, lo, hi = anchored(raw, offsets)
    row = np.searchsorted(offsets, lo, side="right") - 1
    key = PrefixHash(raw).ranges(anchor, anchor + PREFIX) if len(anchor) else np.zeros(0, U64)
    return _Entries(key, np.zeros(len(key), np.uint32), ids[row], (lo - offsets[row]).astype(np.int32), (hi - offsets[row]).astype(np.int32))


def _spread(part: pa.RecordBatch, column: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of the packed window runs of each row, in positions of the chunk."""
    packed = part.column(part.schema.get_field_index(column)).to_pylist()
    runs = [np.frombuffer(x, np.int32).reshape(-1, 2) if x else np.zeros((0, 2), np.int32) for x in packed]
    row = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    flat = np.concatenate(runs).astype(np.int64) if runs else np.zeros((0, 2), np.int64)
    return row, flat[:, 0] + offsets[row], flat[:, 1] + offsets[row]


def _stretches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each match: the fingerprints of its anchor's prefix and of its stretch, and its place."""
    for part in parts:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        for first, end, raw, offsets in text_chunks(part.column(1)):
            row, lo, hi = _spread(part.slice(first, end - first), "runs", offsets)
            if not len(row):
                continue
            order = np.append(_gram_order(raw), U64(0))
            least = np.minimum.reduceat(order, np.stack([lo, hi + WINDOW - PREFIX + 1], axis=1).ravel())[::2]
            anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
            one, two = PrefixHash(raw), PrefixHash(raw, 1)
            hashes = [one.ranges(anchor, anchor + PREFIX), one.ranges(lo, hi + WINDOW), two.ranges(lo, hi + WINDOW)]
            places = [ids[first:end][row], (lo - offsets[row]).astype(np.int32), (hi - offsets[row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), *(pa.array(x) for x in places)], names=["prefix", "s1", "s2", "id", "lo", "hi"])


def _window_entries(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, part: pa.RecordBatch) -> _Entries:
    row, lo, hi = _spread(part, "runs", offsets)
    times = hi - lo + 1
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    at, row = np.repeat(lo, times) + step, np.repeat(row, times)
    if not len(at):
        return _Entries.concat([])
    place = (at - offsets[row]).astype(np.int32)
    check = (PrefixHash(raw, 1).ranges(at, at + WINDOW) >> U64(32)).astype(np.uint32)
    return _Entries(PrefixHash(raw).ranges(at, at + WINDOW), check, ids[row], place, place)


def _merge_scan(carries: int, last: bool) -> Callable:
    """The step of a bucket: sort the new suffixes, scan them against each level, merge levels.

    carries: how many levels the new array is merged with. last: no further batch will come.
    """

    def step(table: pa.Table) -> pa.Table:
        out = []
        new, levels = [], {}
        for level, n, keys, refs in zip(*(table.column(c).to_pylist() for c in ("level", "n", "keys", "refs")), strict=True):
            entries = _Entries.unpacked(n, keys, refs)
            new.append(entries) if level < 0 else levels.setdefault(level, []).append(entries)
        bucket = table.column("bucket")[0].as_py()
        array = _Entries.concat(new).sorted()
        again = array.same_as_before()
        match = again.copy()
        match[:-1] |= again[1:]
        for level in sorted(levels):
            levels[level] = older = _Entries.concat(levels[level])
            hit_new, hit_old = _scan(array, older)
            match |= hit_new
            out.append(_batch(MATCH, [], older.take(np.flatnonzero(hit_old))))
        out.append(_batch(MATCH, [], array.take(np.flatnonzero(match))))
        if not last:
            merged = array.take(np.flatnonzero(~again))
            for level in range(carries):
                if level in levels:
                    both = _Entries.concat([levels[level], merged]).sorted()
                    merged = both.take(np.flatnonzero(~both.same_as_before()))
            out.append(_batch(ENTRIES, [(0, bucket, carries, *merged.packed())]))
        return pa.Table.from_batches(out)

    return step


def _scan(array: _Entries, older: _Entries) -> tuple[np.ndarray, np.ndarray]:
    """Which of two sorted arrays' entries occur in the other; older has no repeats."""
    hit_new, hit_old = np.zeros(len(array), dtype=bool), np.zeros(len(older), dtype=bool)
    if len(array) and len(older):
        key, check = older.columns[:2]
        lo, hi = np.searchsorted(key, array.columns[0], "left"), np.searchsorted(key, array.columns[0], "right")
        for k in range(int((hi - lo).max())):
            at = np.flatnonzero(lo + k < hi)
            same = at[check[lo[at] + k] == array.columns[1][at]]
            hit_new[same] = True
            hit_old[lo[same] + k] = True
    return hit_new, hit_old


class RepeatIndex:
    """The index family: levels of merged suffix arrays, one table for each, and the matches so far."""

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []
        self.n = 0

    def insert(self, pieces: DataFrame, last: bool = False) -> None:
        """Merge-scan one batch's pieces against all levels; then merge levels of equal size."""
        carries = 0
        while (self.n >> carries) & 1:
            carries += 1
        rows = pieces.select("bucket", "level", "n", "keys", "refs")
        for table in self.levels.values():
            rows = rows.unionByName(table.select("bucket", "level", "n", "keys", "refs"))
        done = self.scratch.keep(rows.groupBy("bucket").applyInArrow(_merge_scan(carries, last), PIECE), f"{self.name}_{self.n}")
        self.matches.append(done.where(F.col("kind") == MATCH).select("id", "lo", "hi"))
        for level in range(carries):
            self.levels.pop(level, None)
        self.levels[carries] = done.where(F.col("kind") == ENTRIES)
        self.n += 1


def _repeats(scratch: Scratch, texts: DataFrame, make: Callable, batches: int, buckets: int, name: str) -> DataFrame:
    """(id, lo, hi) of the entries whose fingerprint occurs twice; a row may come more than once."""
    path = f"{scratch.root}/{name}_sent"
    _send(texts, make, batches, buckets).write.partitionBy("kind", "batch").parquet(path)
    scratch.release()
    sent = scratch.spark.read.schema(PIECE).parquet(path)
    index = RepeatIndex(scratch, name)
    for b in range(batches):
        index.insert(sent.where((F.col("kind") == ENTRIES) & (F.col("batch") == b)), last=b == batches - 1)
    out = sent.where(F.col("kind") == MATCH).select("id", "lo", "hi")
    for m in index.matches:
        out = out.unionByName(m)
    return out


def _pack(runs: DataFrame) -> DataFrame:
    """(id, runs): the window runs of each text, joined where they touch, as packed integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for values in batch.column(1):
                v = np.unique(np.asarray(values.values.to_numpy(), dtype=np.int64))
                packed.append(np.stack([v >> 32, v & 0xFFFFFFFF], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "runs"])

    code = F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")
    return runs.groupBy("id").agg(F.collect_set(code).alias("v")).mapInArrow(pack, "id long, runs binary")


def _covered(runs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows starting in the runs (lo, hi) cover."""
    if not len(runs):
        return []
    lo, hi = runs[:, 0].astype(np.int64), runs[:, 1].astype(np.int64) + WINDOW
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return list(zip(lo[at].tolist(), hi[np.append(at[1:], len(lo)) - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        texts, runs = batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist()
        for text, packed in zip(texts, runs, strict=True):
            cover = _covered(np.frombuffer(packed, np.int32).reshape(-1, 2))
            raw, at, digest = text.as_buffer(), 0, hashlib.sha256()
            view = memoryview(raw)
            for a, b in cover:
                digest.update(view[at:a])
                at = b
            digest.update(view[at:])
            spans.append([{"start": a, "end": b} for a, b in cover])
            kept.append(digest.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.string())], names=["h1", "h2", "spans", "kept_sha256"])


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def repeated_spans(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, spans, kept_sha256) of each text that loses bytes; h1 and h2 are text_keys()."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    long_texts = documents.select(_text().alias("text")).where(F.octet_length("text") >= WINDOW)
    texts = long_texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = scratch.keep(texts.select(F.monotonically_increasing_id().alias("id"), *text_keys(), "copies", "text"), "texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    narrow = texts.select("id", "text")
    found = scratch.keep(_pack(_repeats(scratch, narrow, _anchor_entries, batches, buckets, "suffixes")), "matches")
    scratch.drop("suffixes_sent", *(f"suffixes_{b}" for b in range(batches)))
    with_runs = lambda runs: narrow.join(runs, "id").select("id", "text", "runs")
    stretch = scratch.keep(with_runs(found).mapInArrow(_stretches, "prefix long, s1 long, s2 long, id long, lo int, hi int"), "stretches")
    distinct = stretch.groupBy("prefix", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "lo", "hi")).alias("place"))
    distinct = scratch.keep(distinct, "distinct")
    settled = stretch.join(distinct.where("n > 1").select("prefix", "s1", "s2"), ["prefix", "s1", "s2"]).select("id", "lo", "hi")
    settled = scratch.keep(_pack(settled), "settled")
    mixed = distinct.groupBy("prefix").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("prefix")
    unsure = scratch.keep(_pack(distinct.join(mixed, "prefix").select("place.*")), "unsure")
    scratch.drop("stretches", "distinct")
    windows = scratch.keep(_pack(_repeats(scratch, with_runs(unsure), _window_entries, 1, buckets, "windows")), "windows_found")
    scratch.drop("windows_sent", "windows_0")
    runs = settled.unionByName(windows).groupBy("id").agg(F.concat_ws("", F.collect_list(F.hex("runs"))).alias("runs")).select("id", F.unhex("runs").alias("runs"))
    parts = texts.where("copies = 1").join(runs, "id").select("h1", "h2", "text", "runs").mapInArrow(_cut, "h1 long, h2 long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    copies = texts.where("copies > 1").select("h1", "h2", whole.alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return scratch.keep(parts.unionByName(copies), "spans")


def text_keys() -> list[Column]:
    return [F.xxhash64(_text()).alias("h1"), F.xxhash64(F.lit(1), _text()).alias("h2")]


def remove_repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """documents with spans (removed byte ranges) and kept (the remaining bytes, joined).

    A cut may split a character, so kept is binary. Null counts as empty; texts under WINDOW bytes
    lose nothing; all of repeated rows lose everything. Columns spans and kept are replaced.
    """
    docs, inner, names = guarded(documents, ["text"], ("spans", "kept"))
    docs = docs.select("*", *text_keys())
    found = repeated_spans(documents, batches).select("h1", "h2", "spans")
    joined = docs.join(found, ["h1", "h2"], "left").drop("h1", "h2")
    raw = F.encode(_text(), "UTF-8")
    n = F.octet_length(raw)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(n.cast("long")))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.hex(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))))
    kept = F.when(F.col("spans").isNull(), raw).otherwise(F.unhex(F.array_join(parts, "")))
    return joined.select(*inner, "spans", kept.alias("kept")).toDF(*names, "spans", "kept")


def digest(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    found = repeated_spans(documents, batches)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    found = found.select("h1", "h2", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    rows = documents.select("doc_id", *text_keys(), F.octet_length(_text()).cast("long").alias("n_bytes"), F.sha2(_text(), 256).alias("_whole"))
    joined = rows.join(found, ["h1", "h2"], "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))


#: For tables of distinct doc_ids. Texts are cut into overlapping pieces: a substring is found by counting from the front.
ORACLE = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, base, substr(x, 2 * base + 1, 798) AS piece FROM (SELECT *, unnest(range(0, n - 199, 200)) AS base FROM bytes WHERE n >= 200)
), starts AS (
  SELECT doc_id, base, piece, unnest(range(least(200, n - 199 - base))) AS i FROM pieces
), windows AS (
  SELECT doc_id, base + i AS i, md5(substr(piece, 2 * i + 1, 400)) AS m FROM starts
), hits AS (
  SELECT doc_id, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opens FROM hits
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, hi - lo AS removed, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since, hi FROM spans
), cut AS (
  SELECT b.doc_id, sum(removed) AS removed, count(*) AS spans, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept, max(hi) AS last
  FROM gaps g JOIN bytes b ON b.doc_id = g.doc_id GROUP BY b.doc_id
)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN b.x ELSE c.kept || substr(b.x, 2 * c.last + 1) END)) AS kept_sha256
FROM bytes b LEFT JOIN cut c ON c.doc_id = b.doc_id
"""
