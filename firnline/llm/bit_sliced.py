"""Exact top-k by inner product on a bit-sliced index.

Attributes are whole numbers. A block of the index holds some thousand vectors; slice b of an
attribute is a bitmap with bit b of every vector. For a query the weighted sum over the attributes
is formed with bitmap arithmetic: for each set bit of a query component the attribute's slices
(complemented if the component is negative) join the pile of slices of their weight, and carry-save
adders reduce three slices of a weight to one there and one of double weight until each weight has
at most two, which a ripple adder finishes. The sum's slices are then read from the most significant
one downward: rows with the bit set come first as long as they fit into k, the others stay as ties.
Ties of the last place are resolved by the smaller id, as rows of a block lie in id order.

Blocks of queries meet blocks of the index in an equi-join on the block number (the stated queries
against all rows, in blocks); each pair yields at most k rows per query, and a window keeps the
best k of all blocks. Vectors never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.llm.texts import ship
from firnline.session import stored

BLOCK_ROWS = 8192
QUERY_ROWS = 256


def add_slices(piles: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum of all piles, lowest weight first; piles[w] holds bitmaps (2-d: one per row) of weight 2**w."""
    out, width = [], 0
    w = 0
    while any(v for k, v in piles.items() if k >= w):
        stack = piles.pop(w, [])
        if stack:
            held = np.concatenate(stack)
            width = held.shape[1]
            while len(held) > 2:  # three slices become a sum and a carry
                n = len(held) // 3
                a, b, c, rest = held[:n], held[n:2 * n], held[2 * n:3 * n], held[3 * n:]
                half = a ^ b
                piles.setdefault(w + 1, []).append((a & b) | (half & c))
                held = np.concatenate([half ^ c, rest])
            if len(held) == 2:
                piles.setdefault(w + 1, []).append(held[:1] & held[1:])
                held = held[:1] ^ held[1:]
            out.append(held[0])
        else:
            out.append(np.zeros(width, np.uint64) if width else None)
        w += 1
    return [np.zeros(width, np.uint64) if s is None else s for s in out]


def count_bits(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums among allowed rows; ties to the lower position."""
    sure, ties = np.zeros_like(allowed), allowed
    n_sure = 0
    for s in reversed(slices):
        ones = ties & s
        n = count_bits(ones)
        if n_sure + n > k:
            ties = ones
        else:
            sure, n_sure, ties = sure | ones, n_sure + n, ties & ~s
            if n_sure == k:
                return positions(sure)
    return np.concatenate([positions(sure), positions(ties)[:k - n_sure]])


class Block:
    """Bit slices of some vectors in id order; attributes are shifted to start at zero."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray, low: int):
        self.ids, self.slices, self.low = ids, slices, low  # slices[b, d]: bitmap of bit b of attribute d
        rows = np.zeros(slices.shape[2] * 64, np.uint8)
        rows[:len(ids)] = 1
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        low = int(values.min()) if values.size else 0
        shifted = (values[order] - low).astype(np.uint64)
        bits = max(1, int(shifted.max()).bit_length()) if values.size else 1
        padded = np.zeros((-(-len(ids) // 64) * 64, values.shape[1]), np.uint64)
        padded[:len(ids)] = shifted
        by_dim = np.ascontiguousarray(padded.T)
        slices = [np.packbits(((by_dim >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)]
        return cls(ids[order], np.stack(slices), low)

    def search(self, query: np.ndarray, without: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of this block for a query of whole numbers, leaving out the id without."""
        piles: dict[int, list[np.ndarray]] = {}
        bits, full = len(self.slices), (1 << len(self.slices)) - 1
        size, negative = np.abs(query), query < 0
        base = int(query.sum()) * self.low - int(size[negative].sum()) * full  # what shifts and complements add
        for j in range(int(size.max()).bit_length() if len(size) else 0):
            has = (size >> j) & 1 == 1
            for dims, flip in ((np.flatnonzero(has & ~negative), False), (np.flatnonzero(has & negative), True)):
                if len(dims):
                    for b in range(bits):
                        part = self.slices[b, dims]
                        piles.setdefault(j + b, []).append(~part if flip else part)
        slices = add_slices(piles)
        allowed, own = self.rows, np.flatnonzero(self.ids == without)
        if len(own):
            allowed = allowed.copy()
            for i in own.tolist():
                allowed[i // 64] &= ~np.uint64(1 << (i % 64))
        best = top_rows(slices, allowed, k)
        scores = np.full(len(best), base, np.int64)
        for w, s in enumerate(slices):
            scores += ((s[best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        return self.ids[best], scores


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def complete(vector: Column) -> Column:
    """True if the vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _packed(rows: DataFrame, size: int, sliced: bool) -> DataFrame:
    """Rows (g, id, v) in order of g as blocks of one g and at most size rows: g, n, low, ids, data (slices or plain vectors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        g_held, n_held = None, 0

        def block() -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held, strict=True))
            made = Block.of(ids, values) if sliced else None
            raw, low = (made.slices.tobytes(), made.low) if sliced else (values.astype("<i8").tobytes(), 0)
            return pa.RecordBatch.from_pydict({"g": pa.array([g_held], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "low": pa.array([low], pa.int64()),
                                               "ids": [(made.ids if sliced else ids).astype("<i8").tobytes()], "data": [raw]})

        for batch in batches:
            g, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            at = 0
            while at < len(g):
                if held and (g[at] != g_held or n_held >= size):
                    yield block()
                    held, n_held = [], 0
                g_held = int(g[at])
                end = min(int(np.searchsorted(g, g_held, "right")), at + size - n_held)
                held.append((ids[at:end], values[at:end]))
                n_held += end - at
                at = end
        if held:
            yield block()

    return rows.mapInArrow(run, "g int, n int, low long, ids binary, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows of vectors by inner product of the scaled vectors.

    A row with the query's own id is no candidate. Vectors that are NULL or empty, or hold NULL or components that
    are not finite, and rows without an id take no part on either side; all others must have one length. Ties go to
    the smaller id; repeated candidate rows each take a place, query rows of one id count once. Fewer than k
    candidates give fewer rows, empty tables none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)

    def plain(df: DataFrame) -> DataFrame:
        whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and size(v) > 0")
        return whole.where(complete(F.col("v"))).select("id", whole_numbers(F.col("v"), scale).alias("v"))

    groups = max(1, -(-vectors.count() // BLOCK_ROWS))
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")
    index = stored(_packed(plain(vectors).select(group, "id", "v").repartition(groups, "g").sortWithinPartitions("g", "id"), BLOCK_ROWS, True), "slices")
    asked = plain(queries).dropDuplicates(["id"]).select(F.lit(0).alias("g"), "id", "v")
    asked = stored(_packed(asked, QUERY_ROWS, False), "slice-queries")
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # much work for each byte: partitions of a stated number are not merged by their size, and few groups meet in one
    spread = groups + 64
    pairs = index.repartition(spread, "g").join(everywhere.repartition(spread, "g").hint("shuffle_hash"), "g").select("low", "ids", "data", "q_ids", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, ids, data, q_ids, q_data in zip(*batch.columns, strict=True):
                ids, q_ids = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(q_ids.as_py(), "<i8")
                asked_ = np.frombuffer(q_data.as_py(), "<i8").reshape(len(q_ids), -1)
                words = -(-len(ids) // 64)
                slices = np.frombuffer(data.as_py(), np.uint64).reshape(-1, asked_.shape[1], words)
                made, out = Block(ids, slices, low.as_py()), []
                for q, v in zip(q_ids.tolist(), asked_, strict=True):
                    best, scores = made.search(v, q, k)
                    out.append((np.full(len(best), q), best, scores))
                q, best, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best), pa.array(scores)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return """
WITH e AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM (SELECT * FROM e WHERE id % 50 = 0) q JOIN e c ON q.id <> c.id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""
