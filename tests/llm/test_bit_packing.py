import io
import zlib

import numpy as np
import odd
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from firnline.llm import bit_packing as B

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 20, 32])
def test_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000)
    raw = B.pack(ids, bits)
    assert len(raw) == (1000 * bits + 7) // 8
    assert (B.unpack(raw, 700, bits, 123) == ids[123:823]).all()


def test_file_with_random_access():
    class Kept(io.BytesIO):
        def close(self):
            pass

    out, rng = Kept(), np.random.default_rng(1)
    docs = [(i, rng.integers(0, 1 << 17, n)) for i, n in enumerate([0, 5, 1000, 1, 0, 333, 64])]
    writer = B.ShardWriter(out, 17, block_ids=100)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    reader, whole = B.ShardReader(io.BytesIO(out.getvalue())), np.concatenate([d for _, d in docs])
    assert reader.docs().tolist() == [[i, len(d)] for i, d in docs]
    for start, n in ((0, 0), (0, len(whole)), (99, 2), (100, 100), (len(whole) - 1, 1), (250, 777)):
        assert (reader.read(start, n) == whole[start:start + n]).all()


def test_bits():
    assert [B.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_like_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    more = [(200 + i, t, None) for i, t in enumerate(["It's <|endoftext|> x<|startoftext|>", "ΑΣ Σ İ \x0b a b", "DON'T we'll ÀÉß×÷ 12½", "e ́a"])]
    docs = odd.documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in B.pack_documents(docs, PATH, 2).collect())
    at, want = 0, []
    rows = sorted(((-1 if i is None else i, t or "") for i, t in docs.select("doc_id", "text").collect()))
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert B.pack_documents(odd.empty(spark), PATH, 2).collect() == []
