"""Cross-entropy difference of a target and a background model for every document.

A token's loss is its negative log probability; a document's score is the mean loss per token under the
target model less that under the background model: the lower, the closer to the target. The background
model counts all documents, the target model those that a label names, both over one vocabulary.

score_words is the method: bigrams of words, over the vocabulary of all words of the corpus.

  1. Documents fall into chunks of about CHUNK bytes by a hash. A chunk's distinct words and pairs of
     neighbours are its grams; sorted by fingerprint they are dealt to buckets.
  2. Each bucket sums its grams over all chunks and sends every chunk the totals of its own grams, in the
     chunk's order, so that no fingerprint travels back.
  3. The chunk's texts, shuffled once for both steps, are scored with these totals.

A gram goes to its bucket once for each chunk, however often it occurs, and a chunk gets no gram that its
texts lack: no table of counts is held whole anywhere. Fingerprints have 63 bits.

score is a smaller model for callers who want a bounded one: 4-grams of 64 symbols, into
which the bytes of the text fall (letters without case, ten digits as one, blanks as one, common signs
apart, bytes of other characters by their value). There are at most 64**4 grams, whatever the corpus, so
the count table and the two arrays of losses that each worker derives from it have a proven bound (64 MB
each).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.circulant import _SPACE, BASE
from firnline.llm.suffix_dedup import fingerprint, prefix_sums
from firnline.llm.texts import filesystem, joined, mixed, ship, text_batches
from firnline.session import shared_folder

SYMBOLS, ORDER = 64, 4
#: Weight of the lower order in each order's estimate, in counts.
PRIOR = 16.0
#: Bytes of text of a chunk, about.
CHUNK = 4 << 20
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 19
#: Rows of one id are spread over so many chunks.
SPREAD = 8
#: The mark before a document's first word; there are as many ends.
START = np.uint64(2)


def symbol_table() -> np.ndarray:
    """Symbol of each byte; 0 is the blank, which also stands before the text."""
    table = np.full(256, 63, np.uint32)
    table[:33] = 0
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[48:58] = 27
    for i, sign in enumerate(b".,;:!?-'\"()/|*#$%&<>@_="):
        table[sign] = 28 + i
    table[128:256] = 51 + np.arange(128) // 11
    return table


TABLE = symbol_table()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of all texts, and where each text begins."""
    raw, starts = joined([b"   " + t for t in texts])
    s = TABLE[raw]
    codes = s.copy()
    for back in range(1, ORDER):
        codes[back:] |= s[:-back] << np.uint32(6 * back)
    keep = np.ones(len(raw), bool)
    for i in range(ORDER - 1):
        keep[starts[:-1] + i] = False
    return codes[keep], starts - (ORDER - 1) * np.arange(len(starts))


def losses(counts: np.ndarray) -> np.ndarray:
    """Loss of every gram's last symbol, given dense counts of all grams."""
    counts = counts.reshape((SYMBOLS,) * ORDER)

    def estimate(seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return (seen + PRIOR * lower) / (seen.sum(axis=-1, keepdims=True) + PRIOR)

    lower = np.full(1, 1.0 / SYMBOLS)
    for order in range(1, ORDER):
        lower = estimate(counts.sum(axis=tuple(range(ORDER - order))), lower)
    out = np.empty(counts.shape, np.float32)
    for first in range(SYMBOLS):  # one symbol after the other, to hold little besides the result
        out[first] = -np.log(estimate(counts[first], lower))
    return out.ravel()


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, target, background: counts over all rows of docs(text, wanted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, texts in text_batches(batch, 0, 8 << 20):
                codes, starts = grams(texts)
                aim = np.repeat(wanted[first:first + len(texts)], np.diff(starts))
                found, where = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.bincount(where[aim], minlength=len(found))),
                                                  pa.array(np.bincount(where, minlength=len(found)))], ["gram", "target", "background"])

    return docs.mapInArrow(run, "gram int, target long, background long").groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


_READY: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _model(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Losses under both models, once per Python worker."""
    if path not in _READY:
        fs, inner = filesystem(path)
        table = ds.dataset(inner, filesystem=fs, format="parquet").to_table()
        _READY.clear()
        made = []
        for name in ("target", "background"):
            counts = np.zeros(SYMBOLS**ORDER)
            counts[table["gram"].to_numpy()] = table[name].to_numpy()
            made.append(losses(counts))
        _READY[path] = tuple(made)
    return _READY[path]


def score(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference for every document.

    wanted lists the doc_ids of the target (repeats count once). Losses are means per token (byte); NULL and
    empty texts have no tokens and NULL losses. Repeated rows count and are scored each; other columns are ignored.
    Without any target document the target model is the uniform one.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = wanted.select(F.col("doc_id").alias("doc_id"), F.lit(True).alias("wanted")).where("doc_id is not null").distinct()
    # a merge join at every size: labels grow with the documents, and Spark can split a hot id
    train = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    path = shared_folder(spark, "gram-counts")
    count_grams(train).write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target, background = _model(path)
            for first, texts in text_batches(batch, 1, 2 << 20):
                codes, starts = grams(texts)
                n = np.diff(starts)
                none, parts = n == 0, []
                for model in (target, background):
                    means = np.zeros(len(n))
                    if not none.all():
                        means[~none] = np.add.reduceat(model[codes].astype(np.float64), starts[:-1][~none]) / n[~none]
                    parts.append(np.round(means, 6))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n.astype(np.int64)), *[pa.array(p, mask=none) for p in parts],
                     pa.array(np.round(parts[0] - parts[1], 6), mask=none)], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, target_loss double, background_loss double, difference double"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Odd fingerprints of all words, and where the words of each text begin (one entry more than texts)."""
    prints, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, some in text_batches(pa.record_batch([pa.array(texts, pa.binary())], ["text"]), 0, SLICE):
        raw, starts = joined([t + b"\n" for t in some])
        space = _SPACE[raw]
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        prints.append(fingerprint(*prefix_sums(raw), first, end) | np.uint64(1))
        counts.append(np.diff(np.searchsorted(first, starts)))
    return np.concatenate(prints), np.cumsum(np.concatenate(counts))


class Grams:
    """The distinct grams of some texts in order, their counts, and which ones each word needs."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray) -> None:
        words, bounds = word_prints(texts)
        self.sizes = np.diff(bounds)
        some = self.sizes > 0
        self.first = bounds[:-1][some]
        before = np.concatenate([[START], words[:-1]])[:len(words)]
        before[self.first] = START
        parts = [words, mixed(before * BASE + words) & ~np.uint64(1), np.full(len(self.first), START)]
        aim = np.repeat(wanted, self.sizes)
        aims = np.concatenate([aim, aim, wanted[some]])
        self.prints, where = np.unique(np.concatenate(parts), return_inverse=True)
        self.n = np.bincount(where, minlength=len(self.prints))
        self.t = np.bincount(where[aims], minlength=len(self.prints))
        self.word, self.pair = where[:len(words)], where[len(words):2 * len(words)]
        self.start = np.searchsorted(self.prints, START)
        self.before = np.concatenate([[self.start], self.word[:-1]])[:len(words)]
        self.before[self.first] = self.start

    def losses(self, counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """Loss of every word, given the corpus's counts of these grams, its number of words and of distinct words."""
        alone = (counts + PRIOR / (vocabulary + 1)) / (total + counts[self.start] + PRIOR)
        return np.log(counts[self.before] + PRIOR) - np.log(counts[self.pair] + PRIOR * alone[self.word])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers with all lowest bytes first, then the next ones: the shuffle's codec shortens the zeros."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _chunk(rows: pa.Table) -> tuple[pa.Table, Grams]:
    """The documents among a chunk's rows (the others are marks of target ids), and their grams."""
    mark = rows["mark"].to_numpy()
    docs = rows.filter(pa.array(~mark))
    wanted = pc.is_in(docs["doc_id"], value_set=rows.filter(pa.array(mark))["doc_id"].combine_chunks()).to_numpy().astype(bool)
    return docs, Grams([(t or "").encode() for t in docs["text"].to_pylist()], wanted)


def deal_grams(buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """chunk's rows -> one row per bucket: differences of its sorted fingerprints, counts in all texts and in the target."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, g = _chunk(rows)
        bucket = ((g.prints >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        cut = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(g.prints) else []
        columns = [[packed(np.diff(g.prints[c], prepend=np.uint64(0))) for c in cut], [packed(g.n[c]) for c in cut], [packed(g.t[c]) for c in cut]]
        return pa.table({"bucket": pa.array(range(len(cut)), pa.int32()), "chunk": pa.array([key[0].as_py()] * len(cut), pa.int64()),
                         **{name: pa.array(c, pa.binary()) for name, c in zip(("prints", "n", "t"), columns, strict=True)}})

    return run


def add_up(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's rows -> the same with counts over all chunks; vocabulary and words (all, target) of the bucket."""
    prints, n, t = ([unpacked(x) for x in rows[name].to_pylist()] for name in ("prints", "n", "t"))
    cut = np.cumsum([len(x) for x in prints])[:-1]
    found, where = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in prints]), return_inverse=True)
    sums = [np.bincount(where, np.concatenate(x), len(found)).astype(np.uint64) for x in (n, t)]
    word = (found & np.uint64(1)).astype(bool)
    known = [int(word.sum()), *[int(s[word].sum()) for s in sums]]
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"],
                     **{name: pa.array([packed(x) for x in np.split(s[where], cut)], pa.binary()) for name, s in zip(("n", "t"), sums, strict=True)},
                     **{name: pa.array([x] * rows.num_rows, pa.int64()) for name, x in zip(("vocabulary", "words", "aimed"), known, strict=True)}})


def score_chunk(rows: pa.Table, totals: pa.Table) -> pa.Table:
    docs, g = _chunk(rows)
    totals = totals.sort_by("bucket")
    none, means = g.sizes == 0, []
    for name, words in (("t", "aimed"), ("n", "words")):
        mean = np.zeros(len(none))
        if not none.all():
            counts = np.concatenate([unpacked(x) for x in totals[name].to_pylist()]).astype(np.float64)
            loss = g.losses(counts, pc.sum(totals[words]).as_py(), pc.sum(totals["vocabulary"]).as_py())
            mean[~none] = np.add.reduceat(loss, g.first) / g.sizes[~none]
        means.append(np.round(mean, 6))
    columns = [pa.array(m, mask=none) for m in (*means, np.round(means[0] - means[1], 6))]
    return pa.table([docs["doc_id"], pa.array(g.sizes.astype(np.int64)), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])


def score_words(docs: DataFrame, wanted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference for every document.

    The columns are those of score, with words for tokens. Both models are interpolated bigram models. A
    document's first word follows a start mark, and an end mark follows its last one; the lowest order is
    uniform over the corpus's words and the end mark. The losses of end marks are not in the means.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    chunks = size // chunk + 1
    place = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(chunks).cast("long")).alias("chunk")
    salt = F.pmod(F.xxhash64("text"), F.lit(SPREAD).cast("long"))
    marks = wanted.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id is not null").distinct() \
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    rows = docs.select(F.when(F.col("doc_id").isNull(), place("text")).otherwise(place("doc_id", salt)).alias("chunk"), "doc_id", "text", F.lit(False).alias("mark")) \
        .union(marks.select(place("doc_id", "salt"), "doc_id", F.lit(None).cast("string"), F.lit(True)))
    # partitions and buckets follow the input: a task has two or three chunks at any size, a bucket as many grams as two chunks
    parts, held = chunks // 2 + 1, "n binary, t binary"
    rows = rows.repartition(parts, "chunk")
    dealt = rows.groupBy("chunk").applyInArrow(deal_grams(parts), f"bucket int, chunk long, prints binary, {held}")
    totals = dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(add_up, f"chunk long, bucket int, {held}, vocabulary long, words long, aimed long") \
        .repartition(parts, "chunk")
    return rows.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        score_chunk, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double")
