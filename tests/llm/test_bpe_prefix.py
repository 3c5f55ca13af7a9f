import hashlib
import random

import numpy as np
import odd
import public_tokenizers as P
import pytest
import tiktoken

from firnline.llm import bpe_prefix as B
from firnline.llm.queries import digests

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, "rb") as f:
        return B.PrefixBpe(B.read_ranks(f.read()))


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_like_the_library(spark, library):
    docs = odd.documents(spark)
    coded = B.decode(B.encode(docs, PATH, P.PATTERN), PATH)
    got = digests(coded).collect()
    assert len(got) == docs.count()
    texts = {r[0]: r[1] or "" for r in odd.rows()}
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert digests(B.decode(B.encode(odd.empty(spark), PATH, P.PATTERN), PATH)).collect() == []


def test_pieces_like_the_library(bpe, library):
    rnd = random.Random(4)
    parts = ["the", "ing", "on", " ", "é", "ß", "a", "zz", "1", "!?", "日", "\n", "tion", "́"]
    for _ in range(2000):
        piece = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        for p in library._core_bpe.encode_ordinary(piece), :
            assert b"".join(bpe.tokens[i] for i in p) == piece.encode()
        cache = B.PieceCache(bpe)
        found = B.regex.findall(B.spaces_by_property(P.PATTERN), piece)
        assert list(np.frombuffer(b"".join(map(cache.__getitem__, found)), "<u4")) == library.encode_ordinary(piece)


def test_appends_and_edits(bpe):
    rnd = random.Random(3)
    for _ in range(200):
        raw = bytes(rnd.choice(b"abcdeinghto ") for _ in range(rnd.randint(0, 200)))
        table = B.Prefixes(bpe)
        for i in range(0, len(raw), 17):
            table.append(raw[i:i + 17])
        assert table.last == B.Prefixes(bpe, raw).last
        start = rnd.randint(0, len(raw))
        end, new = rnd.randint(start, min(len(raw), start + 5)), b"ing"[:rnd.randint(0, 3)]
        done = table.edit(start, end, new)
        assert table.raw == raw[:start] + new + raw[end:] and table.last == B.Prefixes(bpe, table.raw).last
        assert done <= len(table.raw) - start
    long = B.Prefixes(bpe, b"information about the weather of the region and its people " * 100)
    assert long.edit(10, 11, b"x") < 200
