import collections
import math
import re

import odd
import pytest

from firnline.llm import cross_entropy as X


def by_hand(texts, vocabulary):
    """Mean loss per word under the interpolated bigram model of some texts, from dictionaries."""
    pairs, before, alone = collections.Counter(), collections.Counter(), collections.Counter()
    for words in filter(None, texts):
        for v, w in zip(["", *words], [*words, ""]):
            pairs[v, w] += 1
            before[v] += 1
            alone[w] += 1

    def p(v, w):
        one = (alone[w] + X.PRIOR / (vocabulary + 1)) / (sum(alone.values()) + X.PRIOR)
        return (pairs[v, w] + X.PRIOR * one) / (before[v] + X.PRIOR)

    return lambda words: -sum(math.log(p(v, w)) for v, w in zip(["", *words], words)) / len(words)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("chunk", [X.CHUNK, 3000])
def test_like_the_formula(spark, chunk):
    wanted = spark.createDataFrame([(1,), (2,), (2,), (None,), (999,)], "doc_id long")
    got = X.score_words(odd.documents(spark), wanted, chunk).collect()
    rows = [(i, words(t)) for i, t, *_ in odd.rows()]
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    size = len({w for _, ws in rows for w in ws})
    background, target = by_hand([ws for _, ws in rows], size), by_hand([ws for i, ws in rows if i in (1, 2)], size)
    texts = dict(rows)
    for r in got:
        ws = texts[r.doc_id]
        assert r.n_tokens == len(ws)
        if ws:
            assert r.target_loss == pytest.approx(target(ws), abs=2e-6) and r.background_loss == pytest.approx(background(ws), abs=2e-6)
            assert r.difference == pytest.approx(r.target_loss - r.background_loss, abs=2e-6)
        else:
            assert r.target_loss is None and r.background_loss is None and r.difference is None
    assert X.score_words(odd.empty(spark), wanted).collect() == []


def test_without_target_the_model_is_uniform(spark):
    row = X.score_words(spark.createDataFrame([(1, "a b c b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).first()
    assert row.target_loss == pytest.approx(math.log(4), abs=1e-6)


def test_words_of_one_byte_class_are_told_apart(spark):
    """Case, digits and letters of other scripts fall into one symbol each; the words differ, and so must the losses."""
    pairs = [("Polish", "polish"), ("1905", "1984"), ("дом", "дон"), ("日本", "日本語")]
    docs = spark.createDataFrame([(2 * i + k, p[k] + " x") for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.difference for r in X.score_words(docs, docs.where("doc_id % 2 = 0").select("doc_id")).collect()}
    assert all(got[2 * i] < got[2 * i + 1] - 0.1 for i in range(len(pairs)))


def test_the_query_counts_words(spark, small):
    from firnline.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op6_cross_entropy"](spark, small).collect()}
    assert got == {i: len(words(t)) for i, t in texts.items()}


def test_held_out_labels(spark, small):
    """Trained on half of the labels, the score tells good from bad in the other half."""
    folder = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.difference for r in X.score_words(docs, labels.where("quality = 1 AND doc_id % 2 = 0")).collect()}
    held = [(scores[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect() if scores.get(r.doc_id) is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    if good and bad:
        share = sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
        print("share", share)
        assert share > 0.9
