import duckdb
import odd
import pytest

from checks.compare import duck_rows, spark_rows
from firnline.llm import filter_audit as A

LABELS = [(1, 1, 0), (1, 0, 0), (2, None, 1), (7, 1, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (11, 1, None)]


def by_sql(rows, labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.execute("CREATE TABLE labels(doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    for name, some in (("documents", rows), ("labels", labels)):
        if some:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", some)
    return duck_rows(con, A.oracle())


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in LABELS], "doc_id long, quality int, toxic int, part string, row int")


def test_odd_rows(spark, labels):
    docs = [(i, t, s) for i, t, _, s, *_ in odd.rows()] + [(None, odd.PROSE, "a"), (50, odd.PROSE, "a"), (49, odd.PROSE, "b"), (51, "#" + odd.PROSE.upper() * 3, "a")]
    frame = spark.createDataFrame([(*r, 1, "d", 2) for r in docs], "doc_id long, text string, lang string, row int, digest string, prefix int")
    assert spark_rows(A.audit(frame, labels)) == by_sql(docs, LABELS)


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.audit(none, labels).collect() == []
    docs = [(1, "a b", None), (2, "a b", "")]
    got = A.audit(spark.createDataFrame(docs, none.schema), labels.limit(0))
    assert spark_rows(got) == by_sql(docs, [])
    assert got.count() == 600 and got.where("good_lost + toxic_lost > 0").count() == 0


def test_other_rules(spark, labels):
    """Two rules and copies by hand: short texts, then texts with an x."""
    docs = spark.createDataFrame([(1, "xx yy", "p"), (2, "x", "p"), (3, "y", "p"), (4, "y", "p"), (5, "y y y", "p")], "doc_id long, text string, source string")
    rules = {"S": lambda text, w: A.F.size(w) < 2, "X": lambda text, w: text.contains("x")}
    got = {(r.filter_order, r.step): r for r in A.audit(docs, labels, "source", rules).collect()}
    assert len(got) == 18
    assert [(got["SXE", k].removed, got["SXE", k].kept, got["SXE", k].redundant) for k in (1, 2, 3)] == [(3, 2, 0), (1, 1, 1), (0, 1, 1)]
    assert [(got["EXS", k].removed, got["EXS", k].kept, got["EXS", k].redundant) for k in (1, 2, 3)] == [(1, 4, 0), (2, 2, 0), (1, 1, 2)]
    assert [got["SXE", k].unique_fails for k in (1, 2, 3)] == [1, 1, 0]
    assert sum(got["XES", k].shapley for k in (1, 2, 3)) == 6 * 4  # each of four removed rows in each order
    assert got["XSE", 1].good_lost == 1 and got["XSE", 1].toxic_lost == 1


def test_each_order_removes_the_same(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = A.audit(docs, labels)
    ends = got.groupBy("part", "filter_order").agg(A.F.sum("removed").alias("gone"), A.F.min("kept").alias("left"))
    per_part = {r.part: r["count"] for r in docs.groupBy(A.F.coalesce("lang", A.F.lit("")).alias("part")).count().collect()}
    rows = ends.collect()
    assert len(rows) == 120 * len(per_part)
    assert all(r.gone + r.left == per_part[r.part] for r in rows) and len({(r.part, r.left) for r in rows}) == len(per_part)


def test_failing_ids_are_a_table_for_each_filter(spark, small):
    rows = A.numbered(spark.read.parquet(f"{small}/documents.parquet"), "lang", A.RULES)
    ids = A.failing_ids(rows, len(A.RULES))
    assert ids.where("filter = 4").count() == A.copies(rows).count() and ids.select("filter").distinct().count() == 5
    plan = ids.where("filter = 4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(filter" in plan
    assert ids.count() == ids.select("row", "filter").distinct().count()
