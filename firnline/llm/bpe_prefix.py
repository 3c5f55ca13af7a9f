"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a piece of text the table holds the last token of that prefix's encoding. This
token is unique: of the vocabulary tokens that end the prefix, exactly one forms a valid pair with
the last token of what precedes it, where a pair is valid if merging its bytes by rank gives the
two tokens back (the ranks of a token's two halves are taken to be below its own, as they are in
vocabularies that merging has built). The encoding is read off from the end. Because a prefix's entry never depends on
what follows, appending bytes only adds entries, and after an edit entries are computed anew from
the edit on until as many entries as the longest token has bytes agree with the old ones.

Texts are split by the pattern of the vocabulary first; pieces are encoded apart and a bounded
memory of frequent pieces is kept per Python worker. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from firnline.llm.texts import Recent, ship

NONE = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks by token from a rank file: lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class PrefixBpe:
    """Encoder of single pieces over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._pairs: dict[int, bool] = {}
        self._edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        # lengths of the tokens that end in three given bytes, longest first, and the two shorter ones
        sizes: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 2:
                sizes.setdefault(t[-3:], set()).add(len(t))
        self.sizes = {end: (*sorted(s, reverse=True), 2, 1) for end, s in sizes.items()}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives token; None for a single byte."""
        parts = [self.tokens[token][i:i + 1] for i in range(len(self.tokens[token]))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NONE))
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def edge(self, token: int, side: int) -> list[int]:
        """Tokens at one edge (0 left, 1 right) of token while it is being built, from the byte to the token."""
        known = self._edges[side].get(token)
        if known is None:
            split = self.halves(token)
            known = [token] if split is None else [*self.edge(split[side], side), token]
            self._edges[side][token] = known
        return known

    def fits(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both by rank gives before and token back.

        It does unless a merge across their border comes first at some time: what lies at the border
        on either side grows at the ranks of its own merges, the left one first at equal ranks.
        """
        if before < 0:
            return True
        key = before << 32 | token
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self._meet(self.edge(before, 1), self.edge(token, 0))
            if len(self._pairs) >= 1 << 18:  # forgotten pairs are computed again
                self._pairs.clear()
        return known

    def _meet(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        while True:
            across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], NONE)
            next_left = left[i + 1] if i + 1 < len(left) else NONE
            next_right = right[j + 1] if j + 1 < len(right) else NONE
            if across < next_left and across <= next_right:
                return False
            if next_left == next_right == NONE:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def last_token(self, raw: bytes, upto: int, last: list[int]) -> int:
        """Last token of the encoding of raw[:upto], given those of all shorter prefixes (last[0] is -1)."""
        for size in range(min(self.longest, upto), 0, -1):
            token = self.ranks.get(raw[upto - size:upto])
            if token is not None and self.fits(last[upto - size], token):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def extend(self, raw: bytes, last: list[int]) -> None:
        """Append to last the last tokens of all prefixes of raw that it lacks; last_token in a loop, without calls."""
        ranks, pairs, sizes, fits, short = self.ranks, self._pairs, self.sizes, self.fits, (2, 1)
        for upto in range(len(last), len(raw) + 1):
            for size in sizes.get(raw[upto - 3:upto], short) if upto > 2 else short:
                if size > upto:
                    continue
                token = ranks.get(raw[upto - size:upto])
                if token is not None:
                    before = last[upto - size]
                    known = pairs.get(before << 32 | token)
                    if known or (known is None and fits(before, token)):
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks single bytes")

    def ids(self, last: list[int]) -> list[int]:
        """The encoding that the table of last tokens holds."""
        out, at, lengths = [], len(last) - 1, self.lengths
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def encode(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:  # a piece that is a token is that token, even if merging would not reach it
            return [whole]
        last = [-1]
        self.extend(raw, last)
        return self.ids(last)


class Prefixes:
    """The table of one piece, kept for appends and edits."""

    def __init__(self, bpe: PrefixBpe, raw: bytes = b""):
        self.bpe, self.raw, self.last = bpe, b"", [-1]
        self.append(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.bpe.extend(self.raw, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace raw[start:end] by new; returns how many entries were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.raw = self.raw[:start] + new + self.raw[end:]
        self.last = old[:start + 1]
        agreed = done = 0
        for upto in range(start + 1, len(self.raw) + 1):
            token = self.bpe.last_token(self.raw, upto, self.last)
            self.last.append(token)
            done += 1
            # entries read no further back than the longest token
            agreed = agreed + 1 if upto - shift > end and old[upto - shift] == token else 0
            if agreed >= self.bpe.longest:
                self.last.extend(old[upto + 1 - shift:])
                break
        return done

    def ids(self) -> list[int]:
        return self.bpe.ids(self.last)


class PieceCache(Recent):
    """Ids (as little-endian 32-bit integers) of recent pieces."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__(1 << 18)
        self.bpe = bpe

    def make(self, piece: str) -> bytes:
        return np.array(self.bpe.encode(piece.encode()), "<u4").tobytes()

    def worth(self, piece: str) -> bool:
        return len(piece) <= 64


def spaces_by_property(pattern: str) -> str:
    r"""The pattern with \s and \S as the White_Space property, so that control characters are no spaces."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


_READY: dict[int, PieceCache] = {}


def _cache(raw: bytes) -> PieceCache:
    """One encoder per Python worker and vocabulary."""
    key = hash(raw)
    if key not in _READY:
        _READY[key] = PieceCache(PrefixBpe(read_ranks(raw)))
    return _READY[key]


_TOKENS: dict[int, np.ndarray] = {}


def _tokens(raw: bytes) -> np.ndarray:
    """Bytes by id, once per Python worker and vocabulary."""
    key = hash(raw)
    if key not in _TOKENS:
        ranks = read_ranks(raw)
        table = np.empty(max(ranks.values(), default=0) + 1, object)
        for t, i in ranks.items():
            table[i] = t
        _TOKENS[key] = table
    return _TOKENS[key]


def _vocabulary(docs: DataFrame, path: str):
    ship(docs.sparkSession)
    with open(path, "rb") as f:  # a fixed file of about a megabyte
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every text.

    NULL and empty texts have no ids; repeated rows stay; other columns are ignored. Special tokens
    are not recognised: their strings are ordinary text.
    """
    raw, pattern = _vocabulary(docs, path), spaces_by_property(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cache = regex.compile(pattern).findall, _cache(raw.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [b"".join(map(cache.__getitem__, find(t))) if t else b"" for t in (x.as_py() for x in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encode() and decoded: the bytes of the ids."""
    raw = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokens(raw.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [b"".join(table[np.frombuffer(x.as_py(), "<u4")].tolist()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
