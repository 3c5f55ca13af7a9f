"""Removal of repeated byte strings with a distributed, sparse suffix array.

A byte goes if a string of LENGTH bytes around it starts anywhere else too. Sorting every suffix would
shuffle many times the text, so suffixes are sorted in two rounds.

Round 1 sorts the suffixes at anchors. The anchor of a window (a string of LENGTH bytes) is the place of
the smallest hash among its strings of GRAM bytes, the first one at ties; it depends on the window's
bytes alone, so equal windows have equal anchors. Windows of one anchor follow each other and make a run.
A run whose surroundings (all bytes of its windows) are repeated is repeated as a whole. Runs with a
repeated gram but other surroundings go on, with one run of each repeated surroundings for comparison.

Round 2 sorts the suffixes at all windows of those runs.

Both rounds use the same steps: Spark samples splitters and range-partitions suffixes by their leading
eight bytes, then by fingerprints of what follows, then by place, so that a bucket may end amid equal
suffixes; each bucket sorts its suffixes by multikey quicksort (the next token is looked at only among
ties); neighbours are compared, and the first and last suffix of each bucket with those of the next.

Passages of WORDS words or more that start anywhere else too are found by the same two rounds, with words
for bytes and grams of WORD_GRAM words. They are only counted; what is removed follows the bytes alone.

Fingerprints have 64 bits and count together with the leading bytes; texts are addressed by a 64-bit hash
of id and text. Long texts are taken in overlapping pieces, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.llm.circulant import BASE, _powers
from firnline.llm.texts import joined, mixed, ship, text_batches
from firnline.session import stored

LENGTH, GRAM = 400, 200
WORDS, WORD_GRAM = 51, 13
#: Windows of a text that are handled at once.
PIECE = 2 << 20
GRAM_MARK = np.uint64(GRAM * int(BASE) % (1 << 64))
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SUFFIX = ["lead", "gram", "around", "key", "pos", "n"]


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of the bytes and the factors that make them independent of the place."""
    if not _TABLES or len(_TABLES[0][0]) < len(raw) + 1:
        _TABLES[:] = [_powers(max(1 << 16, 2 * len(raw) + 2))]
    up, down = _TABLES[0]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    return sums, down


def fingerprint(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * BASE)


def leading(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from start on as a number in byte order."""
    value = np.zeros(len(start), np.uint64)
    for i in range(8):
        value = value << np.uint64(8) | raw[start + i].astype(np.uint64)
    return (value ^ np.uint64(1 << 63)).view(np.int64)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def window_runs(grams: np.ndarray, gram: int, length: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one anchor: piece, first window, number of windows, anchor. starts: where each piece begins."""
    ranks = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum(ranks, length - gram + 1)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    stops = starts[1:] - length + 1  # no window of the piece begins here or later
    edges = np.concatenate([starts[:-1], stops[stops > starts[:-1]]])
    new[edges[edges < len(new)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(new)))
    piece = np.searchsorted(starts, first, "right") - 1
    inside = first + length <= starts[piece + 1]
    first = first[inside]
    return piece[inside], first, count[inside], (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchor_runs(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """For every run of windows: piece, first window, number of windows, leading bytes, gram and surroundings."""
    raw, starts = joined(pieces)
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums, down = prefix_sums(raw)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[:len(raw) - GRAM + 1] + GRAM_MARK)
    piece, low, count, anchor = window_runs(grams, GRAM, LENGTH, starts)
    around = fingerprint(sums, down, low, low + count - 1 + LENGTH) + mixed((anchor - low).astype(np.uint64) + BASE)
    return piece, low - starts[piece], count, leading(raw, anchor), grams[anchor].view(np.int64), around.view(np.int64)


def word_edges(raw: np.ndarray) -> np.ndarray:
    """First byte and end of each word in turn; the end of a word that ends the text is left out."""
    space = np.concatenate([[True], _SPACE[raw]])
    return np.flatnonzero(space[1:] != space[:-1])


def words_of(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """First and end byte (within the piece) and fingerprint of each word, and which word each piece begins with."""
    raw, starts = joined([p + b"\n" for p in pieces])
    first, end = word_edges(raw).reshape(-1, 2).T
    words = fingerprint(*prefix_sums(raw), first, end)
    bounds = np.searchsorted(first, starts)
    shift = np.repeat(starts[:-1], np.diff(bounds))
    return first - shift, end - shift, words, bounds


def word_pieces(text: bytes) -> list[tuple[int, bytes]]:
    """The text, or overlapping pieces of a long one that hold all its windows of words: first byte, bytes."""
    if len(text) <= PIECE:
        return [(0, text)]
    raw = np.frombuffer(text, np.uint8)
    first, step = word_edges(raw)[::2], max(1, PIECE // 8)
    stops = np.append(first, len(text))
    return [(int(first[i]), text[first[i]:stops[min(i + step + WORDS - 1, len(first))]]) for i in range(0, len(first) - WORDS + 1, step)]


def passage_runs(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Like anchor_runs for windows of WORDS words: piece, first byte, bytes of the surroundings, gram and surroundings."""
    first, end, words, bounds = words_of(pieces)
    if len(words) < WORDS:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums, down = prefix_sums(words)
    at = np.arange(len(words) - WORD_GRAM + 1)
    grams = fingerprint(sums, down, at, at + WORD_GRAM)
    piece, low, count, anchor = window_runs(grams, WORD_GRAM, WORDS, bounds)
    last = low + count - 2 + WORDS
    around = fingerprint(sums, down, low, last + 1) + mixed((anchor - low).astype(np.uint64) + BASE)
    return piece, first[low], end[last] - first[low], grams[anchor].view(np.int64), around.view(np.int64)


def first_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> one row per run."""
    for batch in batches:
        for first, texts in text_batches(batch, limit=PIECE):
            pieces, rows, bases = [], [], []
            for i, t in enumerate(texts):
                for base in range(0, max(1, len(t) - LENGTH + 1), PIECE):
                    pieces.append(t[base:base + PIECE + LENGTH - 1])
                    rows.append(first + i)
                    bases.append(base)
            piece, low, count, lead, gram, around = anchor_runs(pieces)
            keys = batch.column(0).to_numpy()[np.array(rows)[piece]] if len(piece) else np.zeros(0, np.int64)
            low = low + np.array(bases)[piece] if len(piece) else low
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(gram), pa.array(around), pa.array(keys), pa.array(low), pa.array(count)], SUFFIX)


def first_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> one row per run of windows of words; n is in bytes, and the gram stands for the leading bytes."""
    for batch in batches:
        for first, texts in text_batches(batch, limit=PIECE):
            rows, bases, pieces = [], [], []
            for i, t in enumerate(texts):
                for base, piece in word_pieces(t):
                    rows.append(first + i)
                    bases.append(base)
                    pieces.append(piece)
            if not pieces:
                continue
            piece, low, n, gram, around = passage_runs(pieces)
            keys = batch.column(0).to_numpy()[np.array(rows)[piece]]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(gram), pa.array(around), pa.array(keys), pa.array(low + np.array(bases)[piece]), pa.array(n)], SUFFIX)


def of_kind(batch: pa.RecordBatch, words: bool) -> pa.RecordBatch:
    return batch.append_column("words", pa.array(np.full(batch.num_rows, words)))


def first_of_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, found in ((False, first_suffixes), (True, first_passages)):
            for rows in found(iter([batch])):
                yield of_kind(rows, words)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by all columns; each column after the first is looked at only among ties of those before."""
    order = np.argsort(columns[0])
    tied = np.arange(len(order))
    run = np.cumsum(np.concatenate([[0], np.diff(columns[0][order]) != 0])) if len(order) else tied
    for column in columns[1:]:
        alone = np.bincount(run)[run] == 1
        tied, run = tied[~alone], run[~alone]
        if not len(tied):
            break
        values = column[order[tied]]
        inner = np.lexsort((values, run))
        order[tied] = order[tied][inner]
        values, run = values[inner], run[inner]
        run = np.cumsum(np.concatenate([[0], (np.diff(values) != 0) | (np.diff(run) != 0)]))
    return order


def compare_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket; returns its repeated suffixes, and its first and last one in any case.

    whole: the surroundings are repeated. part: the gram is repeated with other surroundings; one run of
    each surroundings is enough. edge: bit 0 for the first suffix, bit 1 for the last; only these keep
    what they are compared by.
    """
    held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if held is None or not held.num_rows:
        return
    lead, gram, around, key, pos, n, words = (c.to_numpy() for c in held.columns)
    order = multikey_order([lead, gram, around])
    lead, gram, around, key, pos, n, words = (c[order] for c in (lead, gram, around, key, pos, n, words))
    same_gram = (lead[1:] == lead[:-1]) & (gram[1:] == gram[:-1])
    same_all = same_gram & (around[1:] == around[:-1])
    no = np.zeros(1, bool)
    whole = np.concatenate([no, same_all]) | np.concatenate([same_all, no])
    head = ~np.concatenate([no, same_all])
    group = np.cumsum(~np.concatenate([no, same_gram])) - 1
    # other surroundings of the gram are in this bucket, or may be in the next
    part = head & ((np.bincount(group, head)[group] > 1) | (group == group[-1]))
    edge = np.zeros(len(order), np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    out = np.flatnonzero(whole | part | (edge > 0))
    bucket = np.full(len(out), TaskContext.get().partitionId(), np.int32)
    inner = edge[out] == 0
    marks = [pa.array(c[out], mask=inner) for c in (lead, gram, around)]
    columns = [pa.array(bucket), pa.array(edge[out]), *marks, *(pa.array(c[out]) for c in (key, pos, n, words, whole, part))]
    for begin in range(0, len(out), 1 << 16):
        yield pa.RecordBatch.from_arrays([c.slice(begin, 1 << 16) for c in columns], ["bucket", "edge", *SUFFIX, "words", "whole", "part"])


def compared(suffixes: DataFrame) -> DataFrame:
    """Repeated suffixes of all buckets: key, pos, n, words, whole, part. The window runs over two rows per bucket."""
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = suffixes.repartitionByRange(n, "lead", "gram", "around", "key", "pos")
    kind = "bucket int, edge int, lead long, gram long, around long, key long, pos long, n long, words boolean, whole boolean, part boolean"
    found = stored(buckets.mapInArrow(compare_bucket, kind), "suffix-repeats")
    line = W.partitionBy().orderBy("bucket", "edge")
    mark = F.struct("lead", "gram", "around")
    beside = [F.coalesce(way(mark).over(line) == mark, F.lit(False)) for way in (F.lag, F.lead)]
    edges = found.where("edge > 0").select("key", "pos", "n", "words", (F.col("whole") | beside[0] | beside[1]).alias("whole"), F.lit(True).alias("part"))
    return found.where("edge = 0").select("key", "pos", "n", "words", "whole", "part").union(edges)


def second_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, runs -> one row per window of the runs."""
    def windows(pieces: list[bytes], keys: list[int], lows: list[int]) -> pa.RecordBatch:
        raw, starts = joined(pieces)
        sums, down = prefix_sums(raw)
        run, within = counted(np.diff(starts) - LENGTH + 1)
        at = starts[run] + within
        prints = pa.array(fingerprint(sums, down, at, at + LENGTH).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(leading(raw, at)), prints, prints, pa.array(np.array(keys)[run]),
                                           pa.array(np.array(lows)[run] + within), pa.array(np.ones(len(run), np.int64))], SUFFIX)

    def passages(pieces: list[bytes], keys: list[int], lows: list[int]) -> pa.RecordBatch:
        first, end, words, bounds = words_of(pieces)
        run, within = counted(np.diff(bounds) - WORDS + 1)
        at = bounds[run] + within
        prints = pa.array(fingerprint(*prefix_sums(words), at, at + WORDS).view(np.int64))
        return pa.RecordBatch.from_arrays([prints, prints, prints, pa.array(np.array(keys)[run]), pa.array(np.array(lows)[run] + first[at]),
                                           pa.array(end[at + WORDS - 1] - first[at])], SUFFIX)

    def counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.repeat(np.arange(len(counts)), counts)
        return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)

    def rows() -> Iterator[pa.RecordBatch]:
        for words, made in ((False, windows), (True, passages)):
            if held[words][0]:
                yield of_kind(made(*held[words]), words)

    held, total = [([], [], []), ([], [], [])], 0
    for batch in batches:
        for key, text, runs in zip(*batch.columns, strict=True):
            text, key = text.as_buffer(), key.as_py()
            for r in runs.as_py():
                piece = bytes(text[r["pos"]:r["pos"] + r["n"] + (0 if r["words"] else LENGTH - 1)])
                for kept, value in zip(held[r["words"]], (piece, key, r["pos"]), strict=True):
                    kept.append(value)
                total += len(piece)
                if total > PIECE:
                    yield from rows()
                    held, total = [([], [], []), ([], [], [])], 0
    yield from rows()


def covered(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of size bytes lie between a low and its high."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs of repeated windows -> doc_id, n_bytes, starts and ends of removed spans, kept bytes, words in repeated passages."""
    for batch in batches:
        for first, texts in text_batches(batch):
            starts, ends, kept, passage_words = [], [], [], []
            runs = batch.column(2).slice(first, len(texts))
            for text, r in zip(texts, runs, strict=True):
                if not r.is_valid or not len(r):
                    starts.append([]), ends.append([]), kept.append(text), passage_words.append(0)
                    continue
                raw = np.frombuffer(text, np.uint8)
                words, low, n = (r.values.field(k).to_numpy(zero_copy_only=False) for k in ("words", "pos", "n"))
                gone = covered(len(raw), low[~words], (low + n - 1 + LENGTH)[~words])
                border = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                starts.append(np.flatnonzero(border == 1)), ends.append(np.flatnonzero(border == -1))
                kept.append(raw[~gone].tobytes())
                passage_words.append(int(covered(len(raw), low[words], (low + n)[words])[word_edges(raw)[::2]].sum()) if words.any() else 0)
            spans = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()), *spans, pa.array(kept, pa.binary()),
                                              pa.array(passage_words, pa.int64())], ["doc_id", "n_bytes", "starts", "ends", "kept", "n_passage_words"])


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, starts, ends (of the removed spans), kept (remaining bytes), n_passage_words for every row.

    n_passage_words: the text's words that lie in a string of WORDS words which starts anywhere else too, whatever white
    space is between them. Nothing is removed for it.

    NULL texts count as empty. Texts shorter than LENGTH bytes stay whole. Repeated rows are documents of
    their own, so long texts among them vanish entirely. Other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    suffix = "lead long, gram long, around long, key long, pos long, n long, words boolean"
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # hashed twice, for the splitters and for the shuffle, which costs less than storing all anchors
    anchors = texts.select("key", "text").mapInArrow(first_of_both, suffix)
    once = stored(compared(anchors), "suffix-runs")
    runs = lambda df: df.groupBy("key").agg(F.collect_set(F.struct("pos", "n", "words")).alias("runs"))
    unsure = stored(runs(once.where("part")), "suffix-unsure")
    windows = texts.select("key", "text").join(unsure, "key").mapInArrow(second_suffixes, suffix)
    twice = compared(windows).where("whole").select("key", "pos", "n", "words")
    repeated = stored(runs(once.where("whole").select("key", "pos", "n", "words").union(twice)), "suffix-repeated")
    return texts.join(repeated, "key", "left").select("doc_id", "text", "runs") \
        .mapInArrow(cut, f"doc_id {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary, n_passage_words long")
