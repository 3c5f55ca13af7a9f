"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Shingles are hashed to 64 bits. One permutation spreads them over 2**32 places; a second one, shifted
circularly by k places, gives coordinate k of the signature as its smallest value over the set, so two
permutations serve all coordinates. BANDS bands of ROWS coordinates make the buckets: a pair at the
threshold of 0.8 misses all of them with probability (1 - 0.8**5)**32 = 3e-6.

  1. Documents with equal sets form a class; only its smallest id goes on.
  2. In each bucket every class is a candidate with the bucket's smallest id.
  3. Candidates pass if their sizes allow the threshold and their signatures agree in CHECKED places
     (six standard deviations below what the threshold leads to); then the full sets decide.
  4. Components of the links so far. What can still matter are pairs of classes in one bucket that lie in
     different components. All members of a bucket belong to the star of its leader, and one of such a
     pair is an outlier there, in another component than the leader. Outliers of a star meet all its
     members in blocks of about BLOCK times BLOCK classes, compared on full sets inside a task, which
     yields one link per outlier and component. A group of near copies is one component by then and
     leaves its few outliers; a large star is spread over many blocks.

Sets are computed again for documents in surviving pairs alone, so texts and sets of all others are
never shuffled. Joins on bucket keys and ids read stored tables on both sides, which lets Spark split
hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.components import components
from firnline.llm.texts import joined, mixed, new_name, ship, text_batches
from firnline.session import stored

#: Words of a shingle, unless a caller wants another length.
SHINGLE = 4
BANDS, ROWS = 32, 5
PLACES = BANDS * ROWS
#: Fewest equal coordinates of a pair that is verified: 128 of 160 are expected at the threshold, six deviations less.
CHECKED = 97
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Classes on each side of a block of comparisons.
BLOCK = 256
BASE = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (BASE, inverse))


class Shingler:
    """Distinct shingles of some words of texts as 64-bit hashes."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        odds = [0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93]
        more = mixed(np.arange(4, max(shingle, 4), dtype=np.uint64)) | np.uint64(1)
        self.odds = np.concatenate([np.array(odds, np.uint64), more])[:shingle - 1]
        self.up, self.down = _powers(1 << 16)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """One sorted array per text; texts with fewer words than a shingle give one element, those without words none."""
        raw, starts = joined([t + b"\n" for t in texts])
        if len(raw) + 1 > len(self.up):
            self.up, self.down = _powers(2 * len(raw))
        lower = _LOWER[raw]
        space = _SPACE[lower]
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * self.up[:len(raw)], out=sums[1:])
        words = mixed((sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64))
        bounds = np.searchsorted(first, starts)
        window = words * np.uint64(3)
        for k, odd in enumerate(self.odds, 1):
            window[:-k] += words[k:] * odd
        window = mixed(window)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= self.shingle:
                out.append(np.unique(window[a:b - self.shingle + 1]))
            elif b > a:
                value = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    value = mixed(value * np.uint64(5) + w)
                out.append(value)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def second_permutation(places: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (two rounds of multiply and shift)."""
    v = places ^ (places >> np.uint32(16))
    v *= np.uint32(0x7FEB352D)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x846CA68B)
    v ^= v >> np.uint32(16)
    return v


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PLACES coordinates for each set; sets must not be empty."""
    places = (mixed(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), PLACES), np.uint32)
    for k in range(PLACES):
        out[:, k] = np.minimum.reduceat(second_permutation(places - np.uint32(k)), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * BASE + rows[:, :, r])
    return key.view(np.int64)


def describe(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, set_key, bands, signature (the low byte of each coordinate)."""
    shingler = Shingler(shingle)
    for batch in batches:
        for first, texts in text_batches(batch, limit=1 << 20):
            sets = shingler.sets(texts)
            full = [s for s in sets if len(s)]
            key, bands, signature = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                marks = signatures(full)
                keys, low = band_keys(marks), marks.astype(np.uint8)
                for j, i in enumerate(i for i, s in enumerate(sets) if len(s)):
                    bands[i], signature[i] = keys[j], low[j].tobytes()
                    key[i] = np.array([mixed(sets[i]).sum(), mixed(sets[i] ^ BASE).sum()], np.uint64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())], ["doc_id", "n", "set_key", "bands", "signature"])


def full_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(shingle)
    for batch in batches:
        for first, texts in text_batches(batch, limit=1 << 20):
            sets = [s.tobytes() for s in shingler.sets(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sets, pa.binary())], ["doc_id", "items"])


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in (2, 3))
            good = np.count_nonzero(left == right, axis=1) >= CHECKED
            yield batch.select(["a", "b"]).filter(pa.array(good))


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links among pairs(a, b) of class ids."""
    kind = "a long, b long"
    marks = classes.select("id", "signature")
    seen = pairs.join(marks.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a") \
        .join(marks.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b").select("a", "b", "x", "y")
    close = stored(seen.mapInArrow(alike, kind), "near-close")
    ends = stored(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ends")
    items = stored(docs.join(ends, "doc_id", "left_semi").mapInArrow(partial(full_sets, shingle=shingle), "doc_id long, items binary").dropDuplicates(["doc_id"]), "near-sets")
    whole = close.join(items.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a") \
        .join(items.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return stored(whole.mapInArrow(linked, kind), "near-links")


def compare_block(rows: pa.Table) -> pa.Table:
    """Links between the outliers and the members of one block, one per outlier and component."""
    side = rows["outlier"].to_numpy(zero_copy_only=False).astype(bool)
    ids, tops = rows["id"].to_numpy(), rows["top"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["items"]]
    sizes = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    out: set[tuple[int, int]] = set()
    if len(left) and len(right):
        common = np.intersect1d(np.concatenate([sets[i] for i in left]), np.concatenate([sets[i] for i in right]))
        shared = np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, len(common), 4096):
            some = common[begin:begin + 4096]
            marks = []
            for part in (left, right):
                mark = np.zeros((len(part), len(some)), np.float32)
                for r, i in enumerate(part):
                    at = np.searchsorted(some, sets[i])
                    at = at[(at < len(some)) & (some[np.minimum(at, len(some) - 1)] == sets[i])]
                    mark[r, at] = 1
                marks.append(mark)
            shared += marks[0] @ marks[1].T
        both = 100 * shared >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - shared)
        both &= tops[left][:, None] != tops[right][None, :]
        seen = set()
        for x, y in zip(*np.nonzero(both), strict=True):
            if (x, tops[right[y]]) not in seen:
                seen.add((x, tops[right[y]]))
                out.add((int(ids[left[x]]), int(ids[right[y]])))
    pairs = sorted(out)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _star_links(star: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links between members of different components of each star(b, id, top)."""
    own = star.where("id = b").select("b", F.col("top").alias("own"))
    marked = stored(star.join(own, "b").withColumn("outlier", F.col("top") != F.col("own")), "near-marked")
    counts = marked.groupBy("b").agg(F.count("*").alias("m"), F.sum(F.col("outlier").cast("long")).alias("k")).where("k > 0")
    counts = counts.select("b", F.ceil(F.col("k") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("columns"))
    placed = stored(marked.join(stored(counts, "near-counts"), "b"), "near-placed")
    ends = stored(placed.select(F.col("id").alias("doc_id")).distinct(), "near-ends")
    items = stored(docs.join(ends, "doc_id", "left_semi").mapInArrow(partial(full_sets, shingle=shingle), "doc_id long, items binary").dropDuplicates(["doc_id"]), "near-sets")
    whole = placed.join(items.withColumnRenamed("doc_id", "id"), "id")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["b", "id", "top", "items"]
    outliers = whole.where("outlier").select(*keep, F.lit(True).alias("outlier"), part("rows").alias("i"), every("columns").alias("j"))
    members = whole.select(*keep, F.lit(False).alias("outlier"), part("columns").alias("j"), every("rows").alias("i"))
    return outliers.unionByName(members).groupBy("b", "i", "j").applyInArrow(compare_block, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    NULL, empty and blank texts have no shingles and are linked with nothing. Rows of one doc_id are one
    document (its first text counts in comparisons with others). Rows without doc_id are linked with nothing,
    have no component_id and are kept. Other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stored(texts.mapInArrow(partial(describe, shingle=shingle), "doc_id long, n long, set_key binary, bands array<long>, signature binary"), "near-marks")
    named = marked.where("doc_id is not null and n > 0")
    classes = stored(named.groupBy("set_key").agg(F.min_by(F.struct("n", "bands", "signature"), "doc_id").alias("m"), F.min("doc_id").alias("id")).select("set_key", "id", "m.*"), "near-classes")
    entries = stored(classes.select("id", "n", F.explode("bands").alias("band")), "near-bands")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT
    leaders = entries.groupBy("band").agg(F.min(F.struct("id", "n")).alias("m"), F.count("*").alias("c")).where("c > 1")
    leaders = stored(leaders.select("band", F.col("m.id").alias("b"), F.col("m.n").alias("m")), "near-leaders")
    first = entries.join(leaders, "band").where((F.col("id") != F.col("b")) & fits(F.col("n"), F.col("m"))).select(F.col("id").alias("a"), "b").distinct()
    known = texts.where("doc_id is not null")
    links = _verified(stored(first, "near-pairs"), classes, known, shingle)
    tops = components(links)
    # second round: buckets whose members the first has left in different components
    crowded = entries.join(leaders, "band").join(tops.select(F.col("node").alias("id"), "component"), "id", "left")
    crowded = stored(crowded.select("band", "b", "id", F.coalesce("component", "id").alias("top")), "near-crowded")
    split = crowded.groupBy("band").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low <> high").select("band")
    star = stored(crowded.join(stored(split, "near-split"), "band", "left_semi").select("b", "id", "top").distinct(), "near-stars")
    more = stored(_star_links(star, known, shingle), "near-links")
    tops = components(links.union(more))
    groups = classes.join(tops.select(F.col("node").alias("id"), "component"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = marked.join(stored(groups, "near-groups"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Documents of which no other one of their group has a smaller id; all columns as before."""
    gone = stored(near_groups(docs, shingle).where("not kept").select(F.col("doc_id").alias("gone")), "near-gone")
    name = new_name(docs, "gone")
    return docs.join(gone.withColumnRenamed("gone", name).distinct(), docs["doc_id"] == F.col(name), "left_anti")
