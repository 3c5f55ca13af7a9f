import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from firnline.llm import periodic_runs as R


def naive(w):
    """All runs of a list, by comparing words a period apart."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(6, 4 * q) and not any(w[s:i + q - d] == w[s + d:i + q] for d in range(1, q)):
                out.add((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_hand(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = naive(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


words = st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=7), st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(3, 9)).map(lambda x: x[0] * x[1])),
                 max_size=6).map(lambda parts: [x for p in parts for x in p])


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_runs_like_naive(parts):
    got = R.runs([np.array(p, np.int64) for p in parts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [naive(p) for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=4))
def test_extensions(parts):
    symbols = [100]
    for k, p in enumerate(parts):
        symbols += [*p, 101 + k]
    grammar = R.Grammar(np.array(symbols), 100)
    pairs = [(i, j) for i in range(1, len(symbols)) for j in range(i + 1, len(symbols))][:3000]
    if not pairs:
        return
    left, right = (np.array(x) for x in zip(*pairs, strict=True))
    for way in (1, -1):
        for (i, j), size in zip(pairs, grammar.extension(left, right, way).tolist(), strict=True):
            n = 0
            while symbols[i + way * n] == symbols[j + way * n]:
                n += 1
            assert size == n


def test_grammar_is_short_for_powers():
    symbols = np.concatenate([[7], np.zeros(1 << 16, np.int64), [8]])
    grammar = R.Grammar(symbols, 7)
    assert sum(len(x.symbols) for x in grammar.levels) < len(symbols) + 10
    assert grammar.extension(np.array([1]), np.array([2]))[0] == (1 << 16) - 1


def test_many_periods_in_one_text(monkeypatch):
    rnd = random.Random(5)
    part = np.array([0] * 4000 + [0, 1] * 300 + sum(([rnd.randrange(3)] + [5, 6, 7] * rnd.randrange(9) for _ in range(200)), []))
    want = naive(part.tolist())
    assert [tuple(r) for r in R.runs([part])[0].tolist()] == want and len(want) > 50
    monkeypatch.setattr(R, "QUERIES", 100)  # candidates in many steps
    assert [tuple(r) for r in R.runs([part])[0].tolist()] == want


@pytest.mark.parametrize("plant", [True, False])
def test_odd_rows(spark, plant):
    more = [(200 + i, "a b c " * (i % 9) + "x y " * (i % 7) + "z " * (i % 11), "s") for i in range(60)]
    docs = odd.documents(spark).select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    docs = docs.withColumns({"n_runs": docs.doc_id, "start": docs.doc_id, "period": docs.source})
    got = [tuple(r) for r in R.periodic_runs(docs, plant).collect()]
    want = [by_hand(i, t, plant) for i, t in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 50


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 20000")  # the naive version is slow
    got = sorted(map(tuple, R.periodic_runs(docs, True).collect()))
    assert got == sorted(by_hand(i, t) for i, t in docs.select("doc_id", "text").collect())
    assert sum(r[1] > 0 for r in got) > 10


def test_empty_table(spark):
    assert R.periodic_runs(odd.empty(spark), True).collect() == []
