import random
import re

import numpy as np
import odd
import pytest

from firnline.llm import circulant as C
from firnline.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n=4):
    w = [z for z in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if z]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in sets}


def near_copies(seed):
    rnd, rows = random.Random(seed), []
    for g in range(12):
        words = [f"w{rnd.randint(0, 9999)}" for _ in range(rnd.choice([5, 30, 120, 400]))]
        for c in range(rnd.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 22))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 9999)}"
            rows.append((g * 100 + c, " ".join(copy) if c % 2 else " \n".join(copy).upper()))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in C.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = C.near_groups(docs).collect()
    assert len(got) == docs.count()
    want = brute([r[:2] for r in odd.rows()])
    for r in got:
        assert r.component_id is None and r.kept if r.doc_id is None else (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    kept = C.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert C.near_groups(odd.empty(spark)).collect() == [] and C.kept_documents(odd.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300), (-5, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {-5} and {got[100 + i] for i in range(40)} == {100}
    assert got[200] == 200 and got[301] == 300 and len(got) == 61 + 1 + 40 + 1 + 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        b = a.copy()
        k = int(1000 * (1 - share) / (1 + share))
        b[:k] = rng.integers(0, 1 << 63, k).astype(np.uint64)
        x, y = C.signatures([np.unique(a), np.unique(b)])
        assert abs((x == y).mean() - share) < 0.12
    assert len(set(C.second_permutation(np.arange(1 << 16, dtype=np.uint32)).tolist())) == 1 << 16


@pytest.mark.parametrize("shingle", [2, 4, 5, 7])
def test_length_of_shingles(shingle):
    texts = ["a b c d e f g h", "A b\tc d e f g x", "a b c", "a b c d", "", "a b c d e f g h a b c d e f g h"]
    sets = C.Shingler(shingle).sets([t.encode() for t in texts])
    for t, got in zip(texts, sets, strict=True):
        w = t.lower().split()
        want = {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        assert len(got) == len(want)
    assert len(np.intersect1d(sets[0], sets[1])) == 8 - shingle and len(np.intersect1d(sets[0], sets[5])) == 8 - shingle + 1


def test_a_changed_word_in_43_links_shingles_of_four_words_only(spark):
    words = [f"w{i}" for i in range(43)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in C.near_groups(docs).collect()} == {1: 1, 2: 1}
    assert {r.doc_id: r.component_id for r in C.near_groups(docs, 5).collect()} == {1: 1, 2: 2}
