"""Toxicity: a lexicon trie met by Levenshtein automata, hits scored in their context window.

A lexicon of words and stems is learned from labelled training rows. All words within the allowed
edit distance of a term (1 for whole words from FUZZY_FROM characters, else 0) are recognised by
automata of up to AUTOMATON_TERMS terms: the intersection of the terms' Levenshtein automata with the
lexicon trie, made deterministic once on the driver. Every word of every text runs through them, all
words of a chunk at a time, and most leave after a few letters. Words near a term that clean training rows use
are exceptions and don't count. A hit counts by its term's log-odds, less when misspelled, and
still less between quotation marks within CONTEXT characters: quotation, not abuse; hits close to
each other add up. A logistic model over these sums gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.common import CODE_POINTS, Scratch, code_points, text_chunks, word_bounds
from kinetrace.llm.learning import fit_logistic, held_out, training_sample

#: Labelled rows that the model is fitted on; terms of one automaton (a larger lexicon has several).
SAMPLE_ROWS, AUTOMATON_TERMS = 20_000, 96
MIN_SUPPORT, MIN_ODDS = 6, 8.0
FUZZY_FROM, CONTEXT, NEAR_WORDS = 5, 60, 12
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)

#: Quotation marks (fixed values).
_QUOTES = np.isin(np.arange(CODE_POINTS), [ord(c) for c in "\"“”„«»‹›"])

#: What a misspelled hit and a quoted hit count of an exact, unquoted one.
MISSPELLED, QUOTED = 0.7, 0.25

FEATURES = ("abuse", "quotation", "top", "cluster", "terms", "per_word", "log_words")


class Automaton:
    """Deterministic automaton of all words within a term's distance.

    terms: (text, is_stem, weight). A stem matches at the start of a word, a word only whole;
    only words are met misspelled. exceptions: misspellings that are words of their own.
    State 0 is dead, state 1 the start. whole[s] and stem[s] give the best term (index + 1) and
    its distance when a word ends in s, or when it passes s.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], exceptions: frozenset = frozenset()):
        self.terms, self.exceptions = terms, exceptions
        letters = sorted({c for t, _, _ in terms for c in t})
        self.classes = np.zeros(CODE_POINTS, dtype=np.int16)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 1
        children: list[dict[str, int]] = [{}]
        accepts: dict[int, int] = {}
        allowed = [0]
        for t, (text, is_stem, _) in enumerate(terms):
            node, k = 0, self.distance(text, is_stem)
            allowed[0] = max(allowed[0], k)
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    allowed.append(0)
                node = children[node][c]
                allowed[node] = max(allowed[node], k)
            accepts[node] = t

        def closed(items: dict[int, int]) -> frozenset:
            """With skipped letters of a term; an item is (trie node, edits so far)."""
            todo = list(items.items())
            while todo:
                node, e = todo.pop()
                for child in children[node].values():
                    if e + 1 <= allowed[child] and e + 1 < items.get(child, 99):
                        items[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(items.items())

        start = closed({0: 0})
        ids, todo, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
        while todo:
            state = todo.pop(0)
            line = []
            for c in ["", *letters]:
                items: dict[int, int] = {}
                for node, e in state:
                    if e < allowed[node] and e + 1 < items.get(node, 99):  # a letter too many
                        items[node] = e + 1
                    for x, child in children[node].items():
                        cost = e + (x != c)
                        if cost <= allowed[child] and cost < items.get(child, 99):
                            items[child] = cost
                nxt = closed(items)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                line.append(ids[nxt])
            rows.append(line)
        self.next = np.array(rows, dtype=np.int32)
        self.whole, self.stem = np.zeros((len(ids), 2), np.int32), np.zeros((len(ids), 2), np.int32)
        for state, s in ids.items():
            for to, stems_only in ((self.whole, False), (self.stem, True)):
                found = [(e, -terms[accepts[n]][2], accepts[n]) for n, e in state if n in accepts and e <= self.distance(*terms[accepts[n]][:2]) and (terms[accepts[n]][1] or not stems_only)]
                if found:
                    e, _, t = min(found)
                    to[s] = (t + 1, e)

    @staticmethod
    def distance(text: str, is_stem: bool) -> int:
        return int(len(text) >= FUZZY_FROM and not is_stem)

    def run(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index, term, distance) of the words that match; the nearest, then heaviest term."""
        best = np.zeros(len(starts), np.int32)
        dist = np.full(len(starts), 9, np.int32)
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), 0

        def take(words: np.ndarray, found: np.ndarray) -> None:
            better = (found[:, 0] > 0) & (found[:, 1] <= dist[words])
            best[words[better]], dist[words[better]] = found[better, 0], found[better, 1]

        while len(alive):
            done = ends[alive] - starts[alive] == at
            if done.any():
                take(alive[done], self.whole[state[done]])
                alive, state = alive[~done], state[~done]
            state = self.next[state, self.classes[cp[starts[alive] + at]]]
            live = state > 0
            alive, state, at = alive[live], state[live], at + 1
            take(alive, self.stem[state])
        if self.exceptions:
            for w in np.flatnonzero((best > 0) & (dist > 0)).tolist():
                if spelled(cp[starts[w] : ends[w]]) in self.exceptions:
                    best[w] = 0
        hit = np.flatnonzero(best)
        return hit, best[hit] - 1, dist[hit]


class Lexicon:
    """The automata of all terms: what any of them finds, the nearest and then the heaviest term."""

    def __init__(self, terms: list[tuple[str, bool, float]], exceptions: frozenset = frozenset()):
        self.terms = terms
        self.parts = [(lo, Automaton(terms[lo : lo + AUTOMATON_TERMS], exceptions)) for lo in range(0, len(terms), AUTOMATON_TERMS)]

    def run(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index, term, distance) of the words that match, in order."""
        z = np.zeros(0, np.int64)
        found = [(z, z, z)] + [(w, t + lo, d) for lo, part in self.parts for w, t, d in [part.run(cp, starts, ends)]]
        word, term, dist = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((term, -np.array([w for _, _, w in self.terms] or [0.0])[term], dist, word))
        word, term, dist = word[order], term[order], dist[order]
        first = np.ones(len(word), dtype=bool)
        first[1:] = word[1:] != word[:-1]
        return word[first], term[first], dist[first]


def spelled(cp: np.ndarray) -> str:
    return cp.tobytes().decode("utf-32-le", "replace")


def features(raw: np.ndarray, offsets: np.ndarray, automaton: Lexicon) -> np.ndarray:
    """One line of FEATURES for each row of a chunk."""
    cp, rows_at = code_points(raw, offsets)
    starts, ends, bounds = word_bounds(cp, rows_at)
    n_rows = len(offsets) - 1
    n_words = np.diff(bounds)
    out = np.zeros((n_rows, len(FEATURES)))
    out[:, 6] = np.log1p(n_words)
    word, term, dist = automaton.run(cp, starts, ends)
    if not len(word):
        return out
    row = np.searchsorted(bounds, word, side="right") - 1
    share = np.where(dist > 0, MISSPELLED, 1.0)
    weight = np.array([w for _, _, w in automaton.terms])[term] * share
    marks = np.concatenate([[0], np.cumsum(_QUOTES[cp])])
    lo, hi = np.maximum(starts[word] - CONTEXT, rows_at[row]), np.minimum(ends[word] + CONTEXT, rows_at[row + 1])
    # quoted: the marks before the hit leave one open, one stands near before it and one near after
    quoted = ((marks[starts[word]] - marks[rows_at[row]]) % 2 == 1) & (marks[starts[word]] > marks[lo]) & (marks[hi] > marks[ends[word]])
    np.add.at(out[:, 0], row[~quoted], weight[~quoted])
    np.add.at(out[:, 1], row[quoted], weight[quoted])
    weight = np.where(quoted, QUOTED, 1.0) * weight
    np.maximum.at(out[:, 2], row, weight)
    # what the hit and those within NEAR_WORDS words before it add up to
    total = np.concatenate([[0], np.cumsum(weight)])
    first = np.searchsorted(word, np.maximum(word - NEAR_WORDS, bounds[row]))
    np.maximum.at(out[:, 3], row, total[1:] - total[first])
    pairs, at = np.unique(np.stack([row, term]), axis=1, return_index=True)
    np.add.at(out[:, 4], pairs[0], (share * np.where(quoted, QUOTED, 1.0))[at])
    out[:, 5] = 100 * out[:, 0] / np.maximum(1, n_words)
    out[:, :2] = np.log1p(out[:, :2])
    return out


def _candidates(text: str) -> set[str]:
    """Words ('=word') and stems ('word-start') of one text."""
    cp, rows_at = code_points(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]))
    starts, ends, _ = word_bounds(cp, rows_at)
    flat = cp.tobytes().decode("utf-32-le", "replace")
    out = set()
    for word in {flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}:
        if len(word) >= 3:
            out.add("=" + word)
            out.update(word[:k] for k in STEM_LENGTHS if k < len(word))
    return out


def _count_terms(sample: DataFrame, known: frozenset | None) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for part in parts:
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                terms = _candidates(text)
                (toxic if y else clean).update(terms if known is None else terms & known)
        terms = sorted({*toxic, *clean})
        counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (toxic, clean)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], names=["term", "toxic", "clean"])

    return sample.select("text", "y").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms (text, is_stem, log-odds) that tell toxic rows from clean ones.

    What a chosen stem covers adds nothing, but for whole words long enough to be met misspelled.
    """
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return []
    common = _count_terms(sample.where("y = 1"), None).where(F.col("toxic") >= MIN_SUPPORT)
    known = frozenset(r["term"] for r in common.select("term").collect())
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in _count_terms(sample, known).collect()}
    ranked = []
    for term, (toxic, clean) in counts.items():
        odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if odds >= math.log(MIN_ODDS):
            ranked.append((toxic * odds, term, odds))
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    starts: set[str] = set()  # of all chosen terms
    # of terms that tell as much, whole words come first: they can be met misspelled
    for _, term, odds in sorted(ranked, key=lambda x: (-x[0], not x[1].startswith("="), -len(x[1]), x[1])):
        whole = term.startswith("=")
        text = term.lstrip("=")
        covered = any(text[:k] in stems for k in range(1, len(text) + 1))
        if whole and (not covered or Automaton.distance(text, False)):
            words[text] = odds
        elif not whole and not covered and text not in starts:  # a shorter stem than a chosen term says the same
            stems[text] = odds
        else:
            continue
        starts.update(text[:k] for k in range(1, len(text) + 1))
    return sorted([(t, False, odds) for t, odds in words.items()] + [(t, True, odds) for t, odds in stems.items()])


def learn_exceptions(sample: DataFrame, terms: list[tuple[str, bool, float]]) -> frozenset:
    """Words near a term, but not equal to one, that clean training rows use."""
    shared = sample.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch.column(0)):
                cp, rows_at = code_points(raw, offsets)
                starts, ends, _ = word_bounds(cp, rows_at)
                word, _, dist = shared.value.run(cp, starts, ends)
                found.update(spelled(cp[starts[w] : ends[w]]) for w in word[dist > 0].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    words = sample.where("y = 0").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in words.select("word").collect())


class ToxicityModel:
    def __init__(self, terms: list[tuple[str, bool, float]], exceptions: frozenset, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.automaton = Lexicon(terms, exceptions)
        self.mean, self.scale, self.weights = mean, scale, weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn lexicon and weights from at most about sample_rows labelled rows outside the held-out fold.

    Without labelled rows, or with one class only, the lexicon is empty and every score is the
    share of toxic labels (0.0 without any).
    """
    scratch = Scratch(documents.sparkSession)
    sample = training_sample(documents, labels, "toxic", sample_rows, scratch, "toxicity_sample")
    terms = learn_lexicon(sample)
    exceptions = learn_exceptions(sample, terms)
    shared = sample.sparkSession.sparkContext.broadcast(Lexicon(terms, exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch.column(0)):
                x = features(raw, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo)], names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(run, "x array<double>, y int").collect()
    scratch.drop("toxicity_sample")
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        zero = np.zeros(len(FEATURES))
        return ToxicityModel(terms, exceptions, zero, np.ones(len(FEATURES)), np.concatenate([[math.log(share / (1 - share))], zero]))
    return ToxicityModel(terms, exceptions, *fit_logistic(np.array([r["x"] for r in rows]), y))


def score(documents: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with score (0 to 1) and predicted (1 from 0.5).

    Whole texts are read, in chunks. Null and empty texts get the score of a text without hits
    and words; repeated rows get equal scores; columns score and predicted are replaced.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    df = documents.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.probability(features(raw, offsets, shared.value.automaton)) for _, _, raw, offsets in text_chunks(batch.column(batch.schema.get_field_index("text")))]
            p = np.concatenate(parts) if parts else np.zeros(0)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = [f for f in df.schema.fields if f.name in keep]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, fit(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rows predicted toxic; columns and their order are kept."""
    names = documents.columns
    inner = documents.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)])
    scored = score(inner, fit(inner, labels), inner.columns)
    return scored.where("predicted = 0").select(*inner.columns).toDF(*names)
