import duckdb
import odd
import pytest
from pyspark.sql import functions as F

from firnline.llm import line_rules


def test_odd_rows_like_sql(spark):
    docs = odd.documents(spark)
    got = line_rules.judge(docs).drop("text")
    assert line_rules.judge(odd.empty(spark)).collect() == []
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in odd.rows()])
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, con.execute(line_rules.oracle()).fetchall()))
    kept = line_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r for r in kept.collect()}
    assert set(by_id) == {16, 18}
    assert by_id[16].text == odd.LONG and by_id[16].n_chars == len(by_id[16].text)


def test_numbers_by_hand(spark):
    text = "a b c x a b c\n#one $two\n\n#one $two"
    row = line_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (11, 23, 4, 1)
    assert row.n_repeat_words == 6 and row.base_failed and not row.kept


def test_rules(spark):
    lines = ["Home | News | About us", "BUY!! NOW!! HERE!! TODAY!!", "xx### yy*** zz%%% end.", "All rights reserved.", "We accept cookies here.",
             " ".join(["word"] * 25), odd.PROSE, "A short heading", ""]
    frame = spark.createDataFrame([(s,) for s in lines], "s string")
    assert [r[0] for r in frame.select(line_rules.failing(frame.s)).collect()] == [True, True, True, True, True, True, False, False, False]


@pytest.mark.parametrize("mark", "।॥։።។။۔！？｡")
def test_sentence_marks_of_other_scripts(spark, mark):
    line = " ".join(["शब्द"] * 30)
    got = spark.createDataFrame([(line + mark,), (line,)], "s string").select(line_rules.failing(F.col("s")).alias("f")).collect()
    assert [r.f for r in got] == [False, True]
