import hashlib
import re

import duckdb
import numpy as np
import odd
import public_tokenizers as P
import tiktoken
from test_circulant import brute

import corpus_pipeline
from firnline.llm import blob_ledger, bpe_prefix, line_rules, mixing


def clean(text):
    spans = []
    for rule in blob_ledger.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def by_hand(rows):
    """Ids of the pipeline's result from rows (doc_id, text, source): SQL, dictionaries and the tokenizer's library."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    kept = con.execute(line_rules.oracle(columns="doc_id, cleaned_text, source, kept", keep=", source")).fetchall()
    kept = [r[:3] for r in kept if r[3]]
    groups = brute([r[:2] for r in kept], corpus_pipeline.SHINGLE)
    kept = [(i, clean(t), s) for i, t, s in kept if groups[i][1] == i]
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    copies = {i: taken // size for i, size, _, _, taken in con.execute(mixing.oracle()).fetchall() if size}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_prefix.read_ranks(f.read()), special_tokens={})
    out = []
    for i, t, _ in kept:
        ids = library.encode_ordinary(t)
        out += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies.get(i, 0)
    return sorted(out)


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "secret scans", "mixing to target weights", "byte-level BPE"]


def test_like_the_version_by_hand(spark, small):
    got = corpus_pipeline.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    rows = duckdb.connect().execute(f"SELECT doc_id, text, source FROM '{small}/documents.parquet'").fetchall()
    assert sorted(map(tuple, got)) == by_hand(rows)
    assert len({r.doc_id for r in got}) > 50


def test_odd_rows_through_all_stages(spark):
    docs = odd.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.documents(spark).columns, name
    ends = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in ends} <= {16, 18}


def test_near_duplicates_go_by_five_words(spark):
    words = [f"w{i}" for i in range(43)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, " ".join(words).upper())], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}
