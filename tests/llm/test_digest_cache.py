import odd
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from firnline.llm import digest_cache as D
from firnline.session import shared_folder

STRANGE = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext", "I'll we've 'S it's  \n\n  x\t\t y z\u0085 \x1c\x1d  　 end   ", "é İı 中文。 \U0001f600\U0001f468‍\U0001f469",
           "١٢ ²³ Ⅷ ½ café naïve – “quoted” €5", "힣ᄀ क्ष אָ", "\x00\x7f\x80\x9f", "x" * 300, " " * 500 + "a", "word" + " " * 3]


def library(name):
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(P.path(name))
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_like_the_library(spark, name):
    docs = odd.documents(spark).select("doc_id", "text", "n_chars").unionByName(
        spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(STRANGE)], "doc_id long, text string, n_chars long"))
    docs = docs.withColumns({"digest": D.F.lit("x"), "n_tokens": D.F.lit(5), "version": D.F.lit(1)})
    count, want = library(name), []
    for i, t in docs.select("doc_id", "text").collect():
        n = count(t or "")
        want.append((i, len((t or "").encode()), n, n > 40))
    got = [tuple(r) for r in D.token_counts(docs, P.path(name), limit=40).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_table(spark, small):
    docs, count = spark.read.parquet(f"{small}/documents.parquet"), library("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in D.token_counts(docs, P.path("byte_bpe_50k.json"), 1024).collect()}
    assert got == {i: (n := count(t or ""), n > 1024) for i, t in docs.select("doc_id", "text").collect()}


def test_only_misses_are_encoded_and_appended(spark, monkeypatch):
    path, name = shared_folder(spark, "test-counts"), P.path("byte_bpe_50k.json")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    cache = lambda: spark.read.parquet(path)
    D.token_counts(make([(1, "one two"), (2, "one two"), (3, "three")]), name, 10, path)
    assert cache().count() == 2
    second = make([(4, "three"), (5, "four"), (6, None)])
    assert {r.doc_id: r.n_tokens for r in D.token_counts(second, name, 10, path).collect()} == {4: 1, 5: 1, 6: 0}
    assert cache().count() == 4
    # a stored count is used as it is: nothing is encoded again
    version = D.tokenizer_version(name)[0]
    digest = cache().limit(0).select("digest").schema
    spark.createDataFrame([(bytearray(D.hashlib.sha256(b"planted").digest()),)], digest).withColumn("n_tokens", D.F.lit(77).cast("long")) \
        .withColumn("version", D.F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    for small in (True, False):  # misses too many for a broadcast
        monkeypatch.setattr(D, "is_small", lambda df, s=small: s)
        third = make([(7, "planted"), (8, f"new text {small}"), (9, "planted"), (10, f"new text {small}")])
        got = {r.doc_id: (r.n_tokens, r.over_limit) for r in D.token_counts(third, name, 10, path).collect()}
        assert got == {7: (77, True), 9: (77, True), 8: (3, False), 10: (3, False)}
    assert cache().count() == 7
    D.token_counts(second, P.path("word_bpe_49k.json"), 10, path)  # another tokenizer shares no count
    assert cache().count() == 10 and cache().select("version").distinct().count() == 2
    # the same digest appended twice by calls at one time
    cache().where(D.F.col("version") == version).write.mode("append").partitionBy("version").parquet(f"{path}-twice")
    cache().where(D.F.col("version") == version).write.mode("append").partitionBy("version").parquet(f"{path}-twice")
    assert D.token_counts(second, name, 10, f"{path}-twice").count() == 3


def test_normalised_texts_share_a_count(spark):
    path, name = shared_folder(spark, "test-counts"), P.path("word_bpe_49k.json")  # lower case, by the tokenizer as well
    docs = spark.createDataFrame([(1, "Some Words"), (2, "some words"), (3, "SOME WORDS")], "doc_id long, text string")
    got = D.token_counts(docs, name, 1, path, lambda t: D.F.lower(D.content(t))).collect()
    assert {r.n_tokens for r in got} == {2} and len(got) == 3 and spark.read.parquet(path).count() == 1


def test_empty_table(spark):
    assert D.token_counts(odd.empty(spark), P.path("byte_bpe_50k.json"), 10).collect() == []
