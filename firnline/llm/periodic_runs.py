"""Periodic runs of words, found with a run-length grammar that recompression builds.

The words of some documents, each followed by a fence that occurs once, are one sequence of symbols. Recompression
shortens it in rounds: block compression replaces every stretch of one symbol by a symbol for (symbol, length),
then pair compression splits the alphabet in two classes and replaces each pair of neighbours of first and second
class. The rounds end when each document is one symbol; fences are never replaced. Where a symbol begins depends on
its neighbours alone, so equal stretches are cut alike but for their ends, and the longest common extension of two
places takes one comparison on each level: upwards while both places begin a symbol and the symbols agree, then
down again to the word that differs. All queries of a batch climb and descend together, as arrays.

A run of period q has at least 4q words, so one of the places 0, 2q, 4q, ... lies in its first 2q words and agrees
with the place q words on. These places (a harmonic number of them for all q) are the candidates; extensions to
the right and to the left give the whole run. Rows are independent: nothing is shuffled, a task holds the grammar of
about four megabytes of text (or of one longer document).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from firnline.llm.texts import mixed, ship, text_batches

#: A run repeats its period so often at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Extensions asked for at once.
QUERIES = 1 << 20


class Level:
    """One sequence of the grammar, and how the next shorter one follows from it."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        #: of the next level: where each symbol begins here (one entry more), and the symbol that each place belongs to
        self.starts = self.parent = None
        self.blocks = False

    def shortened(self, begins: np.ndarray, blocks: bool) -> np.ndarray:
        """Note the next level's symbols by a mask of their first places; returns these places."""
        first = np.flatnonzero(begins)
        self.starts = np.append(first, len(begins))
        self.parent = np.cumsum(begins) - 1
        self.blocks = blocks
        return first

    def to_edge(self, at: np.ndarray, way: int) -> np.ndarray:
        """Places from at to the end of its symbol of the next level, at included; to its beginning if way is -1."""
        mine = self.parent[at]
        return self.starts[mine + 1] - at if way > 0 else at - self.starts[mine] + 1

    def is_edge(self, at: np.ndarray, way: int) -> np.ndarray:
        """Whether a symbol of the next level begins at these places; ends there if way is -1."""
        mine = self.parent[at]
        return self.starts[mine] == at if way > 0 else self.starts[mine + 1] - 1 == at


class Grammar:
    """Longest common extensions in a sequence of symbols; those from fence on occur once each, one before and one after every part."""

    def __init__(self, symbols: np.ndarray, fence: int):
        own = symbols.astype(np.int64)
        fences, new, seed = own >= fence, int(own.max(initial=0)) + 1, 0
        self.levels = [Level(own)]
        while not (fences[1:] | fences[:-1]).all():  # a document of several symbols is left
            # blocks
            begins = np.append(True, own[1:] != own[:-1])
            if not begins.all():
                first = self.levels[-1].shortened(begins, True)
                sizes = np.diff(self.levels[-1].starts)
                own, fences = own[first], fences[first]
                many = np.flatnonzero(sizes > 1)
                kinds, names = np.unique(own[many] << 32 | sizes[many], return_inverse=True)
                own[many] = new + names
                new += len(kinds)
                self.levels.append(Level(own))
            # pairs
            seed += 1
            side = (mixed(own.astype(np.uint64) + np.uint64(seed << 32)) >> np.uint64(40) & np.uint64(1)).astype(bool)
            right, left = side[1:] & ~side[:-1], ~side[1:] & side[:-1]
            free = ~(fences[1:] | fences[:-1])
            right, left = right & free, left & free
            pairs = np.flatnonzero(right if right.sum() >= left.sum() else left)
            if not len(pairs):
                continue
            begins = np.ones(len(own), bool)
            begins[pairs + 1] = False
            kinds, names = np.unique(own[pairs] << 32 | own[pairs + 1], return_inverse=True)
            own, old = own.copy(), own
            own[pairs] = new + names
            new += len(kinds)
            first = self.levels[-1].shortened(begins, False)
            own, fences = own[first], fences[first]
            del old
            self.levels.append(Level(own))

    def extension(self, left: np.ndarray, right: np.ndarray, way: int = 1) -> np.ndarray:
        """How many symbols agree from left and right on, going right (way 1) or left (way -1)."""
        x, y, top = left.copy(), right.copy(), np.full(len(left), len(self.levels) - 1)
        climbing = np.arange(len(left))
        for h, level in enumerate(self.levels[:-1]):
            a, b = x[climbing], y[climbing]
            same = level.symbols[a] == level.symbols[b]
            top[climbing[~same]] = h
            climbing, a, b = climbing[same], a[same], b[same]
            inside = ~(level.is_edge(a, way) & level.is_edge(b, way))
            step = np.minimum(level.to_edge(a, way), level.to_edge(b, way)) if level.blocks else np.ones(len(a), np.int64)
            step = np.where(inside, step, 0) * way
            a, b = a + step, b + step
            ready = level.is_edge(a, way) & level.is_edge(b, way)
            x[climbing], y[climbing] = np.where(ready, level.parent[a], a), np.where(ready, level.parent[b], b)
            top[climbing[~ready]] = h  # one stretch of a block went on, so these symbols differ
            climbing = climbing[ready]
        last = self.levels[-1].symbols
        while len(climbing):  # here each document is one symbol between two fences
            climbing = climbing[last[x[climbing]] == last[y[climbing]]]
            x[climbing] += way
            y[climbing] += way
        for h in range(len(self.levels) - 2, -1, -1):
            level, falling = self.levels[h], np.flatnonzero(top > h)
            ends = level.starts if way > 0 else level.starts[1:] - 1
            a, b = ends[x[falling]], ends[y[falling]]
            same = level.symbols[a] == level.symbols[b]
            step = np.minimum(level.to_edge(a, way), level.to_edge(b, way)) if level.blocks else np.ones(len(a), np.int64)
            step = np.where(same, step, 0) * way
            x[falling], y[falling] = a + step, b + step
        return (x - left) * way


def candidates(symbols: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the harmonic grid that agree with the place a period on, with the period, in arrays of bounded length."""
    places, periods, held = [], [], 0
    for q in range(1, longest // TIMES + 1):
        # an end of the grid lies 2q before the end: a run that is longer holds it
        grid = np.flatnonzero(symbols[:-2 * q:2 * q] == symbols[q:len(symbols) - q:2 * q]) * (2 * q)
        if len(grid):
            grid = grid[(symbols[grid + 1] == symbols[grid + q + 1]) & (symbols[grid + q] == symbols[grid + 2 * q])]
        places.append(grid)
        periods.append(np.full(len(grid), q))
        held += len(grid)
        if held >= QUERIES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs(parts: list[np.ndarray]) -> list[np.ndarray]:
    """start, length, period of every run of each part (an array of numbers), by start, then period."""
    fence = max((int(p.max(initial=-1)) for p in parts), default=-1) + 1
    starts = np.cumsum([1] + [len(p) + 1 for p in parts])
    symbols = np.empty(starts[-1], np.int64)
    symbols[starts - 1] = fence + np.arange(len(starts))
    for p, s in zip(parts, starts, strict=False):
        symbols[s:s + len(p)] = p
    found, grammar = [np.zeros((0, 3), np.int64)], None
    for place, q in candidates(symbols, max(map(len, parts), default=0)):
        grammar = grammar or Grammar(symbols, fence)
        begin = place - grammar.extension(place - 1, place + q - 1, -1)
        size = place + q + grammar.extension(place, place + q) - begin
        enough = size >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.stack([begin, size, q], axis=1)[enough], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period: the first of a stretch has its smallest period
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
    rows[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Word numbers of a document with a periodic tail, for one of ten documents; None for the others."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(words: list[bytes], found: np.ndarray) -> tuple:
    """The row of one document from its words and runs."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist()).encode()
    best, kept = (None, None, None, None), words
    if len(found):
        s, n, q = min(found.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
    return len(found), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id and the runs of each text: how many, the one of greatest exponent, and digests of all runs and of the collapsed text.

    Words are what lies between ASCII white space; the collapsed text drops every word of a run after the run's first
    period. With plant, one of ten documents (by the checksum of its id) first gets a periodic tail. NULL and empty
    texts have no words and no runs, and nothing is planted in documents without an id; repeated rows stay; other
    columns are ignored; an empty table gives no rows. A very long text is handled whole, in one task, with
    about a hundred bytes of memory a word.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_batches(batch):
                ids = batch.column(0).slice(first, len(texts))
                words = [t.split() for t in texts]
                sizes = np.cumsum([0] + [len(w) for w in words])
                codes = pa.array([w for part in words for w in part], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                parts = [codes[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
                if plant:
                    for k, i in enumerate(ids.to_pylist()):
                        if (source := planted(len(parts[k]), i)) is not None:
                            parts[k], words[k] = parts[k][source], [words[k][j] for j in source.tolist()]
                rows = [described(w, found) for w, found in zip(words, runs(parts), strict=True)]
                columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FIELDS}")
