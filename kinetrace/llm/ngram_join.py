"""Jaccard self-join on word 5-grams (similarity 0.8 or more) by adaptive multi-match prefixes.

Texts with equal shingle sets are one class; everything after the first pass is about classes.
Under one global order of shingles (rare first), two sets of similarity t share at least l of the
first n - ceil(t n) + l shingles of each (their l-prefixes). Each document takes the l from 1 to
MAX_MATCHES whose prefix costs least: postings met on the way, plus verifications, which grow
less likely when l shared shingles are asked for. A pair is a candidate when it shares as many
prefix shingles as the smaller l of the two, and when the prefix shingles that it doesn't share
are no more than sets of this similarity and these sizes may differ by. Candidates are verified
on their whole sets.

The order comes from a count sketch of all shingles: fixed size, merged from all documents, the
only table broadcast whole. Any order gives the same links; a good one gives fewer candidates.

Groups of near copies never become all pairs. Each class is first compared with the one hub with
which it shares most postings; found links merge components, and only postings that still hold
different components go on. Where a shingle still holds many components, each class meets a few
random neighbours among the classes of two of its shingles, in blocks of bounded size; the rounds go
on while they merge many components. A group in which a tenth of the pairs are links is one
component after a few rounds, with work in proportion to its members. What remains is joined across
components, never within one, and only on shingles early enough in both prefixes for sets of these
two sizes; so no link that could merge two components is missed. All of these are joins and counts on tables in the shared folder; a hot
shingle is a skewed join that can be split, not a group in one task.

Classes are told apart by 128 bits: should two of them share the 64 bits of their key, all is keyed
anew under another seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.common import U64, Scratch, Words, lower_ascii, mix64, text_chunks
from kinetrace.llm.components import connected_components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity of at least 4/5
MAX_MATCHES = 4
SKETCH_BITS, PIECES = 20, 64
HUB_PASSES = 1
#: Shingles that still hold this many components are mixed by rounds of random neighbours, which end
#: when one merges less than this share of the components that it met, or after so many.
HOT_COMPONENTS, ROUND_YIELD, ROUNDS = 12, 0.2, 12
#: Classes of one shingle met in one place, and the neighbours that each is compared with there.
BLOCK_CLASSES, NEIGHBOURS = 64, 16
#: Share of a prefix that a class has in common with its hub when they are compared.
HUB_SHARE = 0.4
#: Classes whose texts are looked up by a broadcast of their keys (16 bytes each); more: a shuffle.
BROADCAST_CLASSES = 500_000
#: Relative costs of a posting met, of a verification and of an indexed shingle.
COST_SCAN, COST_VERIFY, COST_TOKEN = 1.0, 20.0, 2.0

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row and hash, and the set sizes."""
    words = Words(lower_ascii(raw), offsets, _IS_WORD)
    at, h = words.ngrams(SHINGLE)
    rows, hashes = [words.row[at]], [h]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            at, h = words.ngrams(n)
            place = np.searchsorted(at, words.bounds[short])
            rows.append(short)
            hashes.append(h[place])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=len(offsets) - 1)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def class_keys(h: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of each row's set of shingles; another family of keys for each seed."""
    return _sums(mix64(h ^ U64(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)), sizes)


def _fingerprints(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the partition's sketch in pieces."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    names = ["doc_id", "tkey", "n", "k1", "k2", "piece", "counts"]
    for batch in batches:
        n, k1, k2 = [], [], []
        for _, _, raw, offsets in text_chunks(batch.column(2)):
            _, h, sizes = shingle_sets(raw, offsets)
            sketch += np.bincount((h >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            n.append(sizes)
            k1.append(class_keys(h, sizes, 2 * seed))
            k2.append(class_keys(h, sizes, 2 * seed + 1))
        rows = len(batch)
        if rows:
            cols = [np.concatenate(x).view(np.int64) for x in (n, k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in cols), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, PIECES)]
    empty = pa.nulls(PIECES, pa.int64())
    yield pa.RecordBatch.from_arrays([empty] * 5 + [pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _merge_sketch(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in pieces:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            totals[piece] = totals.get(piece, 0) + np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["piece", "counts"])


def merged_sketch(pieces: DataFrame) -> np.ndarray:
    """Occurrences of the shingles of each cell, over all documents."""
    rows = pieces.repartition("piece").mapInArrow(_merge_sketch, "piece int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    width = (1 << SKETCH_BITS) // PIECES
    for r in rows:
        out[r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint64)
    return np.minimum(out, (1 << 23) - 1).astype(np.uint32)


def prefixes(row: np.ndarray, h: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in global order (by row; by the cell's count, then by hash), prefix length and matches asked of each row."""
    freq = counts[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((h, freq, row))
    h, freq = h[order], freq[order]
    excess = np.maximum(0, freq - int(counts.mean() + 2 * np.sqrt(counts.mean())))
    met = np.concatenate([[0], np.cumsum(excess)])
    start = np.cumsum(sizes) - sizes
    need = -(-NUMERATOR * sizes // DENOMINATOR)
    best = np.full(len(sizes), np.inf)
    length, matches = np.zeros_like(sizes), np.ones_like(sizes)
    for l in range(1, MAX_MATCHES + 1):
        p = np.minimum(sizes, sizes - need + l)
        postings = met[start + p] - met[start]
        cost = postings * (COST_SCAN + COST_VERIFY / l) + COST_TOKEN * p
        better = (cost < best) & ((need >= l) | (l == 1))
        best, length, matches = np.where(better, cost, best), np.where(better, p, length), np.where(better, l, matches)
    return h, length, matches


def _prefix_rows(documents: DataFrame, counts: np.ndarray, seed: int) -> DataFrame:
    """(k1, tkey, n, l, p, prefix) of each class of a chunk."""
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch.column(1)):
                row, h, sizes = shingle_sets(raw, offsets)
                k1 = class_keys(h, sizes, 2 * seed).view(np.int64)
                ordered, length, matches = prefixes(row, h, sizes, shared.value)
                start = np.cumsum(sizes) - sizes
                _, first = np.unique(k1, return_index=True)
                first = first[sizes[first] > 0]
                binary = [ordered[start[r] : start[r] + length[r]].tobytes() for r in first.tolist()]
                ints = [pa.array(x[first].astype(np.int32)) for x in (sizes, matches, length)]
                yield pa.RecordBatch.from_arrays([pa.array(k1[first]), batch.column(0).slice(lo, hi - lo).take(pa.array(first)), *ints, pa.array(binary, pa.binary())], names=["k1", "tkey", "n", "l", "p", "prefix"])

    return documents.select("tkey", "text").mapInArrow(run, "k1 long, tkey long, n int, l int, p int, prefix binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, k1, n, pos): pos is the shingle's place in the class's prefix, from 1."""
    for batch in batches:
        step = 1000
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            tokens = [np.frombuffer(x, dtype=np.int64) for x in part.column(2).to_pylist()]
            times = [len(x) for x in tokens]
            cols = [pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), times)) for i in range(2)]
            pos = np.concatenate([np.arange(1, t + 1, dtype=np.int32) for t in times])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *cols, pa.array(pos)], names=["token", "k1", "n", "pos"])


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose whole sets have the similarity asked for."""
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        b_keys = batch.column(1).to_pylist()
        b_texts = batch.column(3)
        for lo, hi, raw, offsets in text_chunks(batch.column(2), 1 << 18):
            _, h, sizes = shingle_sets(raw, offsets)
            ends = np.cumsum(sizes)
            for r in range(lo, hi):
                a = h[ends[r - lo] - sizes[r - lo] : ends[r - lo]]
                if last[0] != b_keys[r]:
                    (_, _, braw, boff), = text_chunks(b_texts.slice(r, 1))
                    last = (b_keys[r], shingle_sets(braw, boff)[1])
                b = last[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both) and both > 0)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("k1").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("k1").alias("b"), F.col("text").alias("tb"))
    full = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(_verify_rows, "u long, v long")


class NearDuplicates:
    """The join's tables: rows (doc_id, tkey, n, k1) and roots (k1, root) of linked classes."""

    def __init__(self, documents: DataFrame):
        self.scratch = Scratch(documents.sparkSession)
        keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
        for seed in count():
            first = self.scratch.keep(keyed.mapInArrow(partial(_fingerprints, seed=seed), "doc_id long, tkey long, n long, k1 long, k2 long, piece int, counts binary"), f"first_{seed}")
            rows = first.where("piece is null").select("doc_id", "tkey", "n", "k1", "k2")
            if not rows.groupBy("k1").agg(F.min("k2").alias("x"), F.max("k2").alias("y")).where("x != y").limit(1).count():
                break
        self.rows, self.keyed, self.seed = rows.drop("k2"), keyed, seed
        counts = merged_sketch(first.where("piece is not null").select("piece", "counts"))
        self.roots = self._link(counts)

    def _link(self, counts: np.ndarray) -> DataFrame:
        """(k1, root) of the classes that are linked with another one."""
        keep = self.scratch.keep
        columns = [F.first(c).alias(c) for c in ("n", "l", "p", "prefix")]
        self.classes = classes = keep(_prefix_rows(self.keyed, counts, self.seed).groupBy("k1").agg(F.min("tkey").alias("tkey"), *columns), "classes")
        postings = classes.select("k1", "n", "prefix").mapInArrow(_postings, "token long, k1 long, n int, pos int")
        # written by itself, so that the counts of single shingles are gone before postings are shuffled
        repeated = keep(postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
        live = keep(postings.join(repeated, "token").withColumn("comp", F.col("k1")).withColumn("k", F.col("c")), "live_0")
        self.scratch.drop("repeated")
        roots, linked = None, 0
        for step in range(HUB_PASSES + ROUNDS):
            if step < HUB_PASSES:
                candidates, met = _hub_pairs(live, classes.select("k1", "p"), step), None
            else:
                crowded = live.where(F.col("k") >= HOT_COMPONENTS)
                met = crowded.agg(F.approx_count_distinct("comp")).first()[0]
                if not met:
                    break
                candidates = _neighbour_pairs(crowded, step)
            roots = self._merge(candidates, roots, step)
            before, linked = linked, roots.where("k1 != root").count() if roots is not None else 0
            if linked > before:
                live = keep(_still_mixed(live, roots), f"live_{step + 1}")
                self.scratch.drop(f"live_{step}")
            if linked - before < ROUND_YIELD * (met or 1):
                break
        return self._merge(self._candidates(live), roots, HUB_PASSES + ROUNDS)

    def _candidates(self, live: DataFrame) -> DataFrame:
        """All candidates across components, by the whole prefixes of the pairs that met."""
        met = self.scratch.keep(_cross_pairs(live), "met")
        need = self.classes.join(_classes_of(met, met.count()), "k1", "left_semi")
        side = lambda x: need.select(F.col("k1").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "l", "prefix")])
        full = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "la", "lb", "prefixa", "prefixb")
        return full.mapInArrow(_prefix_matches, "a long, b long")

    def _merge(self, candidates: DataFrame, roots: DataFrame | None, step: int) -> DataFrame | None:
        """Verify candidates: the roots of all classes linked so far."""
        pairs = self.scratch.keep(candidates, f"pairs_{step}")
        number = pairs.count()
        if not number:
            return roots
        keys = self.classes.select("k1", "tkey").join(_classes_of(pairs, number), "k1", "left_semi")
        if 2 * number <= BROADCAST_CLASSES:
            keys = F.broadcast(keys)
        texts = self.scratch.keep(self.keyed.select("tkey", "text").join(keys, "tkey").dropDuplicates(["k1"]).select("k1", "text"), f"texts_{step}")
        links = self.scratch.keep(_verify(pairs, texts), f"links_{step}")
        self.scratch.drop(f"pairs_{step}", f"texts_{step}")
        if roots is not None:
            links = links.union(roots.where("k1 != root").select("k1", "root"))
        return self.scratch.keep(connected_components(links, self.scratch, f"cc_{step}").withColumnRenamed("node", "k1"), f"roots_{step}")

    def digest(self) -> DataFrame:
        """doc_id, n_shingles, component_id, and root (which names the component of rows without id)."""
        least = self.rows.where("n > 0").groupBy("k1").agg(F.min("doc_id").alias("least"))
        roots = least.select("k1", F.col("k1").alias("root")).limit(0) if self.roots is None else self.roots
        placed = least.join(roots, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
        whole = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        of_class = placed.select("k1", "root").join(whole, "root")
        out = self.rows.join(of_class, "k1", "left")
        empty = F.col("n") == 0
        return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~empty, F.col("root")).alias("root"))


def _hub_pairs(live: DataFrame, ends: DataFrame, step: int) -> DataFrame:
    """One pair at most for each class: with the hub that most of its postings name, if they are many.

    The hub of a posting is its least class under a hash that changes by step.
    """
    order = F.xxhash64(F.lit(step), "k1")
    hubs = live.groupBy("token").agg(F.min(F.struct(order.alias("o"), F.col("k1"), F.col("n"), F.col("comp"))).alias("hub"))
    met = live.join(hubs, "token").where((F.col("comp") != F.col("hub.comp")) & _sizes_fit(F.col("n"), F.col("hub.n")))
    counted = met.groupBy(F.col("k1").alias("a"), F.col("hub.k1").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = counted.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", F.col("best.b").alias("b"), F.col("best.c").alias("c"))
    return best.join(ends.select(F.col("k1").alias("a"), "p"), "a").where(F.col("c") >= HUB_SHARE * F.col("p")).select("a", "b")


def _sizes_fit(n: Column, m: Column) -> Column:
    return DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)


def _still_mixed(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings of the shingles that still hold several components: c classes, about k components."""
    placed = live.drop("c", "k", "comp").join(roots, "k1", "left").withColumn("comp", F.coalesce("root", "k1")).drop("root")
    counted = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c"), F.approx_count_distinct("comp", 0.2).alias("k"))
    return placed.join(counted.where("x != y").drop("x", "y"), "token").select("token", "k1", "n", "pos", "c", "comp", "k")


def _neighbour_pairs(crowded: DataFrame, turn: int) -> DataFrame:
    """Each class with a few others, of other components, that share one of two of its shingles.

    The two shingles are the class's least under two hashes, so near copies often choose the same.
    The classes of a shingle (c of them hold it) stand in an order that changes by turn, cut into
    blocks; each is paired with the next few in its block.
    """
    least = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "token").alias("o"), "token", "c")).alias(f"s{seed}")
    chosen = crowded.groupBy("k1").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), least(2 * turn), least(2 * turn + 1))
    places = chosen.select("k1", "n", "comp", F.explode(F.array_distinct(F.array(f"s{2 * turn}", f"s{2 * turn + 1}"))).alias("s"))
    order = F.xxhash64(F.lit(-1 - turn), "k1")
    block = F.floor((order.cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("s.c") / F.lit(BLOCK_CLASSES)))
    listed = places.groupBy(F.col("s.token").alias("token"), block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "k1", "n", "comp"))).alias("row")).where(F.size("row") > 1)
    one = listed.select("row", F.posexplode("row").alias("at", "x"))
    both = one.select("x", F.explode(F.slice("row", F.col("at") + 2, F.lit(NEIGHBOURS))).alias("y")).where((F.col("x.comp") != F.col("y.comp")) & _sizes_fit(F.col("x.n"), F.col("y.n")))
    return both.select(F.least("x.k1", "y.k1").alias("a"), F.greatest("x.k1", "y.k1").alias("b")).distinct()


def _cross_pairs(live: DataFrame) -> DataFrame:
    """The pairs across components that share a shingle early enough in both prefixes.

    Sets of sizes n_a and n_b that link share at least o = 4/9 (n_a + n_b) shingles, so the first
    that they share stands among the first n - o + 1 of each.
    """
    early = live.where(F.col("pos") <= F.col("n") - F.expr(f"({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR}") + 1)
    early = early.withColumn("room", (NUMERATOR + DENOMINATOR) * (F.lit(1) - F.col("pos")) + DENOMINATOR * F.col("n"))
    # posa is early enough for b where 4 n_b is at most a's room; a component has the bounds of its classes
    bounds = [F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room")]
    comps = early.groupBy("token", "comp").agg(*bounds)
    of = lambda df, x: df.select("token", *[F.col(c).alias(f"{c[0] if c == 'comp' else c}{x}") for c in df.columns if c != "token"])
    may_meet = (NUMERATOR * F.col("lowb") <= F.col("rooma")) & (NUMERATOR * F.col("lowa") <= F.col("roomb")) & (DENOMINATOR * F.col("higha") >= NUMERATOR * F.col("lowb")) & (DENOMINATOR * F.col("highb") >= NUMERATOR * F.col("lowa"))
    across = of(comps, "a").join(of(comps, "b"), "token").where((F.col("ca") < F.col("cb")) & may_meet)
    side = lambda x: early.select("token", F.col("comp").alias(f"c{x}"), F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("room").alias(f"r{x}"))
    some = (NUMERATOR * F.col("lowb") <= F.col("ra")) & (NUMERATOR * F.col("na") <= F.col("roomb")) & (DENOMINATOR * F.col("na") >= NUMERATOR * F.col("lowb")) & (DENOMINATOR * F.col("highb") >= NUMERATOR * F.col("na"))
    one = across.join(side("a"), ["token", "ca"]).where(some).select("token", "cb", "a", "na", "ra")
    met = one.join(side("b"), ["token", "cb"]).where(_sizes_fit(F.col("na"), F.col("nb")) & (NUMERATOR * F.col("nb") <= F.col("ra")) & (NUMERATOR * F.col("na") <= F.col("rb")))
    return met.select("a", "b").distinct()


def _prefix_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that share as many prefix shingles as the smaller l of the two, and that leave no
    more shingles unshared before the last of them than linked sets of these sizes can."""
    for batch in batches:
        a, b, na, nb, la, lb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        spare = -(-NUMERATOR * (na.astype(np.int64) + nb) // (NUMERATOR + DENOMINATOR))
        keep = np.zeros(len(batch), dtype=bool)
        for r, (x, y) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
            both, i, j = np.intersect1d(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64), assume_unique=True, return_indices=True)
            c = len(both)
            keep[r] = c >= min(la[r], lb[r]) and i.max() + 1 - c <= na[r] - spare[r] and j.max() + 1 - c <= nb[r] - spare[r]
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _classes_of(pairs: DataFrame, number: int) -> DataFrame:
    """The keys of the classes of so many pairs (a, b), to be broadcast if they are few."""
    keys = pairs.select(F.col("a").alias("k1")).union(pairs.select("b"))
    return F.broadcast(keys) if 2 * number <= BROADCAST_CLASSES else keys


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents.

    component_id is the least doc_id reachable by links. Null and empty texts have no shingles
    and stand alone (component_id is their own doc_id); texts under five words are one shingle;
    repeated rows share a component; a row without doc_id gets the least id of its component
    (null if no row of it has one). An empty table gives an empty table.
    """
    return NearDuplicates(documents).digest().select("doc_id", "n_shingles", "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with the least doc_id (one of them, if repeated).

    Documents without shingles all stay. Columns and their order are kept.
    """
    names = documents.columns
    inner = documents.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)])
    digest = NearDuplicates(documents.select("doc_id", "text")).digest()
    stay = digest.where("n_shingles > 0 and doc_id <=> component_id").groupBy("root").agg(F.min(F.struct("doc_id", "tkey")).alias("row"))
    stay = stay.select(F.col("row.doc_id").alias("_id"), F.col("row.tkey").alias("_key"), F.lit(True).alias("_stays"))
    lone = digest.where("n_shingles = 0").select("tkey").distinct().select(F.col("tkey").alias("_key"))
    marked = inner.withColumn("_tkey", text_key())
    kept = marked.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tkey") == F.col("_key"))).drop("_id", "_key", "_stays").dropDuplicates(["doc_id", "_tkey"])
    alone = marked.join(lone, F.col("_tkey") == F.col("_key"), "left_semi")
    return kept.unionByName(alone).select(*inner.columns).toDF(*names)


#: For tables of distinct doc_ids; a chain of links is followed to its end.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT doc_id, n, shingle FROM (SELECT *, min(doc_id) OVER w AS x, max(doc_id) OVER w AS y FROM shingles WINDOW w AS (PARTITION BY shingle)) WHERE x != y
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shared a JOIN shared b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
