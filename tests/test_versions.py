"""Versioned tables: what readers see while a table is rewritten."""

import pytest

from firnline.sources import sinks
from firnline.sources.versions import Snapshot, StaleSnapshot, VersionedTable
from tests.conftest import rows


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "t"), "day")
    made.write(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (4, "x=/y", 4.0)], "n INT, day STRING, x DOUBLE"))
    return made


def test_partitions_are_replaced_and_others_keep_their_folders(table):
    before = table.snapshot()
    table.change(lambda some: some.withColumn("x", some.x + 10), ["a", None])
    assert rows(table.read(), "n") == [(1, "a", 11.0), (2, "b", 2.0), (3, None, 13.0), (4, "x=/y", 4.0)]
    after = table.snapshot()
    assert after.number == 2 and {d for d in after.folders if after.folders[d] == before.folders[d]} == {"day=b", table.folder_name("x=/y")}
    table.write(table.read(only=["a"]).where("n < 0"), ["a"])
    assert rows(table.read(), "n") == [(2, "b", 2.0), (3, None, 13.0), (4, "x=/y", 4.0)], "a partition without rows is gone"
    table.write(table.read(only=["b"]))
    assert rows(table.read(), "n") == [(2, "b", 2.0)]
    assert rows(table.read(but=["b"])) == [] and table.read(but=["b"]).columns == ["n", "day", "x"]


def test_a_reader_during_a_rewrite_sees_the_old_rows_and_a_later_one_the_new(spark, table):
    early, seen = table.read(), []

    def body(some):
        seen.append(rows(VersionedTable(spark, table.path, "day").read(), "n"))  # another reader, while the writer works
        return some.where("n <> 1")

    table.change(body, ["a", "b"])
    assert [r[0] for r in seen[0]] == [1, 2, 3, 4]
    assert [r[0] for r in rows(early, "n")] == [1, 2, 3, 4], "what a reader has begun stays"
    assert [r[0] for r in rows(table.read(), "n")] == [2, 3, 4]


def test_a_failed_rewrite_changes_nothing(spark, table):
    with pytest.raises(Exception, match="broken"):
        table.change(lambda some: some.selectExpr("n", "day", "CAST(raise_error('broken') AS DOUBLE) AS x"), ["a"])
    assert rows(table.read(), "n")[0] == (1, "a", 1.0) and table.snapshot().number == 1
    with pytest.raises(ValueError, match="outside"):
        table.change(lambda some: some.selectExpr("n", "'b' AS day", "x"), ["a"])
    assert table.snapshot().number == 1


def test_the_second_of_two_writers_fails(spark, table, monkeypatch):
    state = table.snapshot()
    other = VersionedTable(spark, table.path, "day")
    table.change(lambda some: some, ["a"])
    monkeypatch.setattr(other, "snapshot", lambda: Snapshot(state.number, state.schema, state.folders))
    with pytest.raises(StaleSnapshot):
        other.write(table.read(only=["b"]).where("n < 0"), ["b"])
    assert table.read().count() == 4


def test_vacuum_keeps_what_the_last_snapshots_name(table):
    for _ in range(3):
        table.change(lambda some: some, ["a"])
    assert len(table.vacuum(keep=1)) == 2 and table.read().count() == 4
    assert table.vacuum(keep=1) == []


def test_filters_choose_folders(table):
    plan = table.read().where("day = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_no_table_yet(spark, tmp_path):
    empty = VersionedTable(spark, str(tmp_path / "none"), "day")
    assert empty.snapshot() is None
    with pytest.raises(FileNotFoundError):
        empty.read()


def test_clean_in_place_rewrites_only_partitions_with_copies(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "day")
    table.write(spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("b", 1, 9), ("b", 2, 9), ("c", 1, 1), ("c", 1, 1)], "day STRING, k INT, nr INT"))
    before = table.snapshot().folders
    assert sorted(sinks.clean_in_place(table, ["day", "k"], ["nr"])) == ["a", "c"]
    assert rows(table.read(), "day", "k") == [("a", 1, 4), ("b", 1, 9), ("b", 2, 9), ("c", 1, 1)]
    assert table.snapshot().folders["day=b"] == before["day=b"]
    assert sinks.clean_in_place(table, ["day", "k"], ["nr"]) == []
