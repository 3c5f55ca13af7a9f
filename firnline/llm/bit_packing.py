"""Token ids in files of fixed-width bits.

File format (all numbers little-endian): the blocks; the byte offset of each block (64 bits each); per document
its id and its number of ids (64 bits each); and a footer of fixed size with the magic "FXBP", version, bits per
id, ids per block, number of blocks, of documents and of ids. In a block ids follow each other with `bits`
bits each, lowest bits first, padded to whole bytes. Any id is found from its number alone: block
number // ids per block, then the bit offset.

Documents are range-partitioned by doc_id on splitters that Spark samples; each partition is one file
(a shard) in the shared folder, written under a name of its attempt and moved into place, so repeated
and lost tasks do no harm. Encoding happens while a shard is written, holding one block at a time.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.llm.texts import Recent, filesystem, ship
from firnline.session import shared_folder, stored

MAGIC, VERSION = b"FXBP", 1
FOOTER = struct.Struct("<4sHHIQQQ")
BLOCK_IDS = 1 << 16
#: Texts encoded at once, in characters.
BATCH_CHARS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """n ids from the first-th id of a block on."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    start, end = first * bits, (first + n) * bits
    spread = np.unpackbits(np.frombuffer(raw, np.uint8)[start // 8:(end + 7) // 8], bitorder="little")[start % 8:start % 8 + n * bits]
    return (spread.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardWriter:
    """Writes one file; add() takes documents in order. Less than a block of ids is held."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held, self.n_held, self.offsets, self.docs, self.n_ids, self.at = [], 0, [], [], 0, 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.add_all([doc_id], np.array([len(ids)]), ids)

    def add_all(self, doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Some documents at once: ids holds theirs after each other."""
        self.docs.extend(zip(doc_ids, sizes.tolist(), strict=True))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.block_ids
            for i in range(0, cut, self.block_ids):
                self._block(whole[i:i + self.block_ids])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").reshape(-1, 2).tobytes())
        self.out.write(FOOTER.pack(MAGIC, VERSION, self.bits, self.block_ids, len(self.offsets), len(self.docs), self.n_ids))
        self.out.close()


class ShardReader:
    """Random access to one file; only the footer, the offsets and the wanted blocks are read."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2) or source.tell()
        magic, version, self.bits, self.block_ids, self.n_blocks, self.n_docs, self.n_ids = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of packed ids")
        self.docs_at = end - FOOTER.size - 16 * self.n_docs
        self.offsets = np.frombuffer(self._at(self.docs_at - 8 * self.n_blocks, 8 * self.n_blocks), "<u8")
        self._last = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def _count(self, block: int) -> int:
        return min(self.block_ids, self.n_ids - block * self.block_ids)

    def docs(self) -> np.ndarray:
        """(doc_id, number of ids) of each document, in file order."""
        return np.frombuffer(self._at(self.docs_at, 16 * self.n_docs), "<i8").reshape(-1, 2)

    def read(self, start: int, n: int) -> np.ndarray:
        parts, at = [], start
        while at < start + n:
            block, first = divmod(at, self.block_ids)
            take = min(self._count(block) - first, start + n - at)
            if self._last[0] != block:
                self._last = (block, self._at(self.offsets[block], (self._count(block) * self.bits + 7) // 8))
            parts.append(unpack(self._last[1], take, self.bits, first))
            at += take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


#: Characters whose case and class need no tables: ASCII and the letters of Latin-1.
UNSAFE = re.compile(r"[^\x00-\x7f\xc0-\xff]|<\|")
#: The tokenizer's pieces of lower-cased text made of such characters; letters, the most frequent, are tried first.
PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\ra-z0-9\xdf-\xf6\xf8-\xff]+")
#: What the last token of a piece ends with (fixed value).
WORD_END = "</w>"
PLAIN_SPACE = re.compile(r"[ \t\n\r]+")


class PieceIds(Recent):
    """Encodes texts by their pieces, which the tokenizer treats apart.

    Texts of plain characters are cut into the tokenizer's own pieces. Others are cut at plain white space, which
    the tokenizer drops, and parts with other characters (or signs of special tokens) are given to it as they are.
    """

    def __init__(self, tokenizer):
        super().__init__(1 << 19)
        self.tokenizer = tokenizer
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text if text.isascii() else not UNSAFE.search(text):
            return PIECE.findall(text.lower())
        out = []
        for part in PLAIN_SPACE.split(text):
            if UNSAFE.search(part):
                out.append(part)
            else:
                out.extend(PIECE.findall(part.lower()))
        return out

    def make(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def worth(self, piece: str) -> bool:
        return len(piece) <= 64

    def learn(self, new: list[str]) -> None:
        """Encode pieces and remember them. Plain ones go together, with white space between them: the end of each piece shows in its last token."""
        odd = {p for p in new if not p.isascii() and UNSAFE.search(p) or "<|" in p}
        plain, rest = [p for p in new if p not in odd], list(odd)
        for begin in range(0, len(plain), 512):
            some = plain[begin:begin + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise ValueError("the vocabulary has no word ends")
            raw, at = ids.tobytes(), 0
            for p, end in zip(some, (4 * cuts).tolist(), strict=True):
                self.keep(p, raw[at:end])
                at = end
        for begin in range(0, len(rest), 4096):
            some = rest[begin:begin + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.keep(p, np.array(e.ids, "<u4").tobytes())

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and how many each text has."""
        parts = [self.pieces(t) for t in texts]
        self.learn([p for p in set().union(*parts) if p not in self and p not in self.older and self.worth(p)])
        raw = [b"".join(map(self.__getitem__, part)) for part in parts]
        return np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) for r in raw], np.int64) // 4


_READY: dict[int, PieceIds] = {}


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode all texts and write shards to folder; returns one row per shard: shard, file, n_docs, n_ids.

    NULL texts count as empty, and every document gets end_id appended. Documents lie in ascending doc_id
    order over all shards (NULL ids first, written as the smallest number; equal ids by the hash of their
    text). Other columns are ignored; an empty table gives no file.
    """
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # a fixed file of a few megabytes
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        key = hash(raw.value)
        if key not in _READY:
            _READY[key] = PieceIds(Tokenizer.from_buffer(raw.value))
        cache = _READY[key]
        bits = bits_for(cache.tokenizer.get_vocab_size())
        fs, base = filesystem(folder)
        shard, writer, held, chars = TaskContext.get().partitionId(), None, [], 0
        trial = f"{base}/.{uuid.uuid4().hex}"

        def flush() -> None:
            ids, sizes = cache.ids_of([t for _, t in held])
            writer.add_all([i for i, _ in held], sizes + 1, np.insert(ids, np.cumsum(sizes), end_id))
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = ShardWriter(fs.open_output_stream(trial), bits)
                held.append((doc_id.as_py() if doc_id.is_valid else -(1 << 63), text.as_py() or ""))
                chars += len(held[-1][1])
                if chars >= BATCH_CHARS:
                    flush()
                    chars = 0
        if writer is not None:
            flush()
            writer.close()
            name = f"{folder}/ids-{shard:06d}.fxbp"
            fs.move(trial, f"{base}/ids-{shard:06d}.fxbp")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(run, "shard int, file string, n_docs long, n_ids long"), "packed-shards")


def read_back(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of write().

    start counts the ids of all documents before it; the window runs over one row per shard.
    """
    before = F.sum("n_ids").over(W.partitionBy().orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = shards.select("file", F.coalesce(before, F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as source:
                    reader = ShardReader(source)
                    docs, at = reader.docs(), 0
                    for begin in range(0, len(docs), 4096):
                        part, sums = docs[begin:begin + 4096], []
                        starts = start + at + np.cumsum(part[:, 1]) - part[:, 1]
                        for n in part[:, 1].tolist():
                            sums.append(zlib.crc32(reader.read(at, n).astype("<u4").tobytes()))
                            at += n
                        ids = pa.array(part[:, 0], mask=part[:, 0] == -(1 << 63))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(part[:, 1]), pa.array(sums, pa.int64())],
                                                         ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents to folder (a new shared one if None) and list them as read back."""
    return read_back(write(docs, vocabulary, folder or shared_folder(docs.sparkSession, "packed-ids"), end_id))
