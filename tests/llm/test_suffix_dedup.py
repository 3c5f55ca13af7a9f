import collections
import random

import numpy as np
import odd
import pytest

from firnline.llm import suffix_dedup as D


def brute(texts):
    seen = collections.Counter(b[j:j + D.LENGTH] for b in texts for j in range(len(b) - D.LENGTH + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - D.LENGTH + 1):
            if seen[b[j:j + D.LENGTH]] > 1:
                gone[j:j + D.LENGTH] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def planted(rnd):
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    sources, texts = [word(3000) for _ in range(3)], []
    for size in (399, 400, 401, 420, 500, 599, 600, 601, 900):
        for _ in range(3):
            a = rnd.choice(sources)
            start = rnd.randint(0, len(a) - size)
            texts.append(word(rnd.randint(0, 300)) + a[start:start + size] + word(rnd.randint(0, 700)))
    return [*sources, *texts, "a" * 1500, "ab" * 500 + "x", "é" * 199 + "z", "q" * 399, "abc " * 300 + "zz" + "abc " * 150, *[sources[0][:700] + str(i) * 5 + sources[1] for i in range(8)]]


@pytest.mark.parametrize("seed, piece", [(1, D.PIECE), (2, 1000)])
def test_like_brute_force(spark, monkeypatch, seed, piece):
    texts = planted(random.Random(seed))
    if piece != D.PIECE:  # long texts are taken in pieces
        raw = [t.encode() for t in texts]
        whole = D.anchor_runs(raw)
        assert int(whole[2].sum()) == sum(max(0, len(r) - D.LENGTH + 1) for r in raw)
        return
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, len(r.starts), bytes(r.kept)) for r in D.repeats_removed(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = D.repeats_removed(docs).collect()
    texts = [(r[1] or "").encode() for r in odd.rows()]
    assert sorted((r.n_bytes, len(r.starts), bytes(r.kept)) for r in got) == sorted(brute(texts))
    assert D.repeats_removed(odd.empty(spark)).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 5, 500) for _ in range(3)]
    assert (np.stack(columns)[:, D.multikey_order(columns)] == np.stack(columns)[:, np.lexsort(columns[::-1])]).all()
    assert len(D.multikey_order([np.zeros(0, int)] * 3)) == 0


def test_pieces_join(spark, monkeypatch):
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    batch = D.pa.RecordBatch.from_pydict({"key": [1], "text": [text]})
    monkeypatch.setattr(D, "PIECE", 1000)
    parts = [b.to_pandas() for b in D.first_suffixes(iter([batch]))]
    runs = sorted((p, n) for part in parts for p, n in zip(part.pos, part.n, strict=True))
    covered = [w for p, n in runs for w in range(p, p + n)]
    assert covered == list(range(len(text) - D.LENGTH + 1))


def passage_words(texts):
    lists = [b.split() for b in texts]
    strings = [[tuple(w[j:j + D.WORDS]) for j in range(len(w) - D.WORDS + 1)] for w in lists]
    seen = collections.Counter(x for each in strings for x in each)
    out = []
    for w, each in zip(lists, strings, strict=True):
        held = np.zeros(len(w), bool)
        for j, x in enumerate(each):
            held[j:j + D.WORDS] |= seen[x] > 1
        out.append(int(held.sum()))
    return out


def test_passages_below_the_length(spark):
    """Passages of over 50 words and under 400 bytes are counted and stay in the text."""
    rnd = random.Random(3)
    prose = lambda n: [str(rnd.randint(0, 9999)) for _ in range(n)]
    texts = [" ".join(prose(rnd.randint(0, 200))) for _ in range(20)]
    for size in (49, 50, 51, 52, 60, 75):
        passage = prose(size)
        for gap in (" ", " ", "\n"):
            texts.append(" ".join(prose(rnd.randint(0, 90))) + gap + gap.join(passage) + " " + " ".join(prose(rnd.randint(0, 90))))
    texts += ["a " * 90, " ".join(["b"] * 51), "b\t" * 52, "c  " * 50 + "c", " ".join(texts[-1].split() * 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in D.repeats_removed(frame).collect()}
    raw = [t.encode() for t in texts]
    assert [got[i].n_passage_words for i in range(len(texts))] == passage_words(raw)
    assert [(got[i].n_bytes, len(got[i].starts), bytes(got[i].kept)) for i in range(len(texts))] == brute(raw)
    short = [got[i] for i in range(26, 35)]
    assert all(r.n_passage_words >= D.WORDS and bytes(r.kept) == raw[r.doc_id] for r in short)


def test_passages_of_odd_rows(spark):
    texts = [(r[1] or "").encode() for r in odd.rows()]
    got = D.repeats_removed(odd.documents(spark)).collect()
    assert sorted((r.n_bytes, r.n_passage_words) for r in got) == sorted(zip(map(len, texts), passage_words(texts), strict=True))


def test_passages_of_pieces(monkeypatch):
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(1500)).encode()
    firsts = D.word_edges(np.frombuffer(text, np.uint8))[::2]
    whole = D.passage_runs([text])
    monkeypatch.setattr(D, "PIECE", 1000)
    batch = D.pa.RecordBatch.from_pydict({"key": [1], "text": [text.decode()]})
    parts = [b.to_pandas() for b in D.first_passages(iter([batch]))]
    spans = [(int(p), int(n)) for part in parts for p, n in zip(part.pos, part.n, strict=True)]
    count = lambda found: sorted(w for p, n in found for w in firsts[(firsts >= p) & (firsts < p + n)][:1 - D.WORDS])
    assert count(spans) == count(zip(whole[1], whole[2], strict=True)) == firsts[:1 - D.WORDS].tolist()
