import collections
import math

import numpy as np
import odd
import pytest

from firnline.llm import cross_entropy as X


def by_hand(texts):
    """Losses per text under the interpolated model of all texts, from dictionaries."""
    def cut(t):
        symbols = [0, 0, 0, *X.TABLE[list(t)].tolist()]
        return [tuple(symbols[i:i + 4]) for i in range(len(t))]

    grams = [cut(t) for t in texts]
    counts, contexts = collections.Counter(), collections.Counter()
    for g in (g for gs in grams for g in gs):
        for k in range(4):
            counts[g[k:]] += 1
            contexts[4 - k, g[k:-1]] += 1

    def p(g):
        return 1 / 64 if not g else (counts[g] + X.PRIOR * p(g[1:])) / (contexts[len(g), g[:-1]] + X.PRIOR)

    return lambda t: -sum(math.log(p(g)) for g in cut(t)) / len(t)


def test_like_the_formula(spark):
    docs = odd.documents(spark)
    wanted = spark.createDataFrame([(1,), (2,), (2,), (None,), (999,)], "doc_id long")
    got = X.score(docs, wanted).collect()
    rows = [(i, (t or "").encode()) for i, t, *_ in odd.rows()]
    assert len(got) == len(rows)
    background, target = by_hand([t for _, t in rows]), by_hand([t for i, t in rows if i in (1, 2)])
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(t)
        if t:
            assert r.target_loss == pytest.approx(target(t), abs=1e-4) and r.background_loss == pytest.approx(background(t), abs=1e-4)
            assert r.difference == pytest.approx(r.target_loss - r.background_loss, abs=2e-6)
        else:
            assert r.target_loss is None and r.difference is None
    assert X.score(odd.empty(spark), wanted).collect() == []


def test_without_target_the_model_is_uniform(spark):
    row = X.score(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).first()
    assert row.target_loss == pytest.approx(math.log(64), abs=1e-5)


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(1).poisson(0.1, 64**4).astype(float)
    total = np.exp(-X.losses(counts).reshape(-1, 64).astype(float)).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def test_held_out_labels(spark, small):
    """Trained on half of the labels, the score tells good from bad in the other half."""
    folder = small.replace("sf0.001", "sf0.01")  # the smallest table has a handful of bad documents
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.difference for r in X.score(docs, labels.where("quality = 1 AND doc_id % 2 = 0")).collect()}
    held = [(scores[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect() if scores.get(r.doc_id) is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    if good and bad:
        assert sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9
