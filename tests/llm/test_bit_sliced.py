import math

import numpy as np
import pytest

from firnline.llm import bit_sliced as S


def brute(rows, queries, k):
    whole = lambda v: [math.floor(256 * float(x)) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if queries(i)}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, dims", [(3, 4), (700, 16), (9000, 3)])
def test_like_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, 1, dims).round(1)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [None] * dims), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (None, [1.0] * dims), (n + 5, []), (50, [0.0] * dims)][:6]
    rows += [(n + 6, rows[0][1]), (n + 7, rows[0][1])]  # ties
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, id int, g int, v string")
    asked = frame.where("vec_id % 50 = 0")
    got = sorted(map(tuple, S.top_k(frame, asked, 5).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_repeated_candidates_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(0, [1.0, -1.0]), (0, [1.0, -1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], kind)
    got = sorted(map(tuple, S.top_k(frame, frame.where("vec_id = 0"), 5).collect()))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]
    none = spark.createDataFrame([], kind)
    assert S.top_k(none, none, 5).collect() == []


def test_adders_and_selection():
    rng = np.random.default_rng(2)
    rows = rng.integers(-300, 300, (1000, 6))
    block = S.Block.of(np.arange(1000), rows)
    for q in (np.array([3, -5, 0, 255, -256, 1]), np.zeros(6, int), np.array([-1, 0, 0, 0, 0, 0])):
        best, scores = block.search(q, 17, 9)
        want = sorted((-int(s), i) for i, s in enumerate(rows @ q) if i != 17)[:9]
        assert sorted(zip((-scores).tolist(), best.tolist(), strict=True)) == want
