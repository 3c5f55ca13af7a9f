"""Token counts kept in a cache by the digests of content and tokenizer.

The cache is a Parquet table (version, digest, n_tokens), partitioned by version. A version is the digest of the
tokenizer's file, of its library's version and of the way it is called; a digest is the SHA-256 of a text's
bytes after normalisation. A call computes the digests of all texts, finds those of the version that the cache
lacks by an anti join, encodes one text for each of them, appends the counts, and joins the counts to all
rows. Only digests and counts take part in joins; texts move once, one for each digest and map task, and
only those whose counts are missing. An append is committed as a whole by Spark's writer, so that lost
executors cost tasks; two calls that append the same digest at once do no harm.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from importlib.metadata import version as version_of

import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.texts import Recent, ship, text_batches
from firnline.session import is_small, shared_folder, stored

#: Letters, marks and signs whose class and white space are the same in every version of Unicode.
PLAIN = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0, 0x2AF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))) + "]*")
#: The pattern that byte-level pre-tokenizers of this family share (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Library:
    """Counts the tokens of whole texts as the tokenizer's own library does, special strings inside texts included."""

    def __init__(self, raw: bytes, kind: str):
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.counts = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            self.tokenizer = None
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self.tokenizer = Tokenizer.from_buffer(raw)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.counts = self._encoded

    def _encoded(self, texts: list[str]) -> list[int]:
        out = []
        for begin in range(0, len(texts), 512):  # encodings hold offsets and strings besides the ids
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts[begin:begin + 512], add_special_tokens=False)]
        return out

    def by_pieces(self) -> bool:
        """Whether the pieces of PIECES are encoded apart: a byte-level pre-tokenizer with its pattern and nothing else."""
        import json

        if self.tokenizer is None:
            return False
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        return made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout") \
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)


class PieceCounts(Recent):
    """Counts by pieces where the tokenizer encodes pieces apart, with a bounded memory of recent ones.

    Texts with other than plain characters, or with the string of a special token, go to the library whole.
    """

    def __init__(self, library: Library):
        super().__init__(1 << 19)
        self.library = library
        self.special = [t.content for t in library.tokenizer.get_added_tokens_decoder().values()]

    def make(self, piece: str) -> int:
        return self.library.counts([piece])[0]

    def worth(self, piece: str) -> bool:
        return len(piece) <= 64

    def counts(self, texts: list[str]) -> list[int]:
        plain = [(t.isascii() or PLAIN.fullmatch(t) is not None) and not any(s in t for s in self.special) for t in texts]
        whole = iter(self.library.counts([t for t, p in zip(texts, plain, strict=True) if not p]))
        parts = [PIECES.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        new = [p for p in set().union(*(x for x in parts if x)) if p not in self and p not in self.older and self.worth(p)]
        for p, n in zip(new, self.library.counts(new), strict=True):
            self.keep(p, n)
        return [next(whole) if x is None else sum(map(self.__getitem__, x)) for x in parts]


_READY: dict[str, Library | PieceCounts] = {}


def _counter(version: str, raw: bytes, kind: str) -> Library | PieceCounts:
    """The counter of a worker; that of another tokenizer is given up."""
    if version not in _READY:
        _READY.clear()
        library = Library(raw, kind)
        _READY[version] = PieceCounts(library) if library.by_pieces() else library
    return _READY[version]


def tokenizer_version(vocabulary: str) -> tuple[str, str, bytes]:
    """Digest of everything that counts depend on, the kind of file, and its bytes (a fixed file of a few megabytes)."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    kind = "model" if vocabulary.endswith(".model") else "json"
    library = "sentencepiece" if kind == "model" else "tokenizers"
    said = f"{library} {version_of(library)}; no added special tokens; {hashlib.sha256(raw).hexdigest()}"
    return hashlib.sha256(said.encode()).hexdigest(), kind, raw


def content(text: Column) -> Column:
    """The normalisation that changes no count: NULL is the empty text."""
    return F.coalesce(text, F.lit(""))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def cached(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """digest, n_tokens of a version, one row a digest; None if nothing has been written to path."""
    try:
        rows = spark.read.schema("digest binary, n_tokens long, version string").parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, keyed: DataFrame, vocabulary: str, path: str, normalise: Callable[[Column], Column] = content) -> None:
    """Append the counts that the cache at path lacks for the digests of keyed; texts are those of docs."""
    spark = docs.sparkSession
    version, kind, raw = tokenizer_version(vocabulary)
    texts = docs.select(normalise(F.col("text")).alias("text")).select(digest_of(F.col("text")).alias("digest"), "text")
    known, misses = cached(spark, path, version), None
    if known is not None:
        misses = stored(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "count-misses")
        if misses.isEmpty():
            return
        if is_small(misses):  # then texts with a count stay where they are
            texts, misses = texts.join(F.broadcast(misses), "digest", "left_semi"), None
    once = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if misses is not None:  # copies have met before, so no digest has many rows here
        once = once.join(misses, "digest", "left_semi")
    ship(spark)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(version, shared.value, kind)
        for batch in batches:
            for first, held in text_batches(batch, limit=1 << 20):
                counts = counter.counts([t.decode() for t in held])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = once.mapInArrow(run, "digest binary, n_tokens long").withColumn("version", F.lit(version))
    counted.write.mode("append").partitionBy("version").parquet(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, path: str | None = None, normalise: Callable[[Column], Column] = content) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row; path is the cache, a new one if it is None.

    NULL texts count as empty, with no bytes and tokens. Repeated rows stay, and copies of a text share one
    cached count. Other columns are ignored; an empty table gives no rows. normalise maps the text to what is
    encoded: a tokenizer that lowers case, say, may share counts between texts that differ in case alone.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "token-counts")
    text = normalise(F.col("text"))
    keyed = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest_of(text).alias("digest")),
                   "count-digests")
    fill(docs, keyed, vocabulary, path, normalise)
    known = cached(spark, path, tokenizer_version(vocabulary)[0])
    if known is None:  # no rows, so no file
        known = spark.createDataFrame([], "digest binary, n_tokens long")
    # stored, so that Spark may split the rows of a digest that many documents share
    mine = stored(known.join(keyed.select("digest").distinct(), "digest", "left_semi"), "count-rows")
    return keyed.join(mine, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
