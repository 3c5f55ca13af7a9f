import duckdb
import odd
import pytest

from firnline.llm import mixing


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # level: 2400 words in all; a is full at 20; 780 left per weight unit would fill the last one too (180)
    assert got["a"] == 20 and got[None] == 180
    assert sum(got.values()) == pytest.approx(2400)
    assert got["b"] == pytest.approx(2 * got["c"]) or got["b"] == 2000 or got["c"] == 1000
    assert all(got[s] <= 2 * n for s, n in (("a", 10), ("b", 1000), ("c", 500), (None, 90)))


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken == r.copies * r.size and r.copies in (0, 1, 2) for r in got)
    assert {r.size for r in got if r.doc_id in (3, 4, 5, 15)} == {0}
    assert mixing.mix(odd.empty(spark)).collect() == []
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.copies for r in got)


def test_near_the_target_and_like_sql(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mix(docs).drop("copies", "source").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(mixing.oracle()).fetchall())
    total = con.execute(f"SELECT sum(target), sum(taken), max(abs(target - taken) / source_size) FROM (SELECT source, any_value(target) AS target, any_value(source_size) AS source_size,"
                        f" sum(taken) AS taken FROM ({mixing.oracle()}) JOIN documents USING (doc_id) GROUP BY 1)").fetchone()
    assert total[1] == pytest.approx(total[0], rel=0.05)


def test_inclusion_follows_probability(spark):
    """Of every source the words follow its ratio, and of every size the second copies follow their own probability."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7 * 3), "abc"[i % 3]) for i in range(9000)], "doc_id long, text string, source string")
    ranked, state = mixing.mix_plan(docs)
    levels = {r.source: r for r in state.collect()}
    words, seconds = {}, {}
    for r in mixing.mix(docs).collect():
        words.setdefault(r.source, []).append((r.taken, r.size, r.target / r.source_size))
        seconds.setdefault((r.source, r.size), []).append(r.copies - levels[r.source].certain)
    for pairs in words.values():
        assert sum(t for t, _, _ in pairs) / sum(n for _, n, _ in pairs) == pytest.approx(pairs[0][2], abs=0.001)
    shares = {}
    for (source, size), taken in seconds.items():
        m = size if size < 8 else size >> (size.bit_length() - 3) << (size.bit_length() - 3)
        shares[source, size] = min(1.0, levels[source].level * m)
        assert sum(taken) / len(taken) == pytest.approx(shares[source, size], abs=0.06)
    assert len({round(p, 3) for p in shares.values() if 0 < p < 1}) > 3  # the odds differ inside a source


def by_hand(sizes, rank, gap):
    """Documents that a walk in order of rank takes, one by one."""
    taken = set()
    for i in sorted(sizes, key=rank.get):
        if rank[i] == mixing.FIRST or 0 < sizes[i] <= gap and rank[i] < mixing.BIG:
            taken.add(i)
            gap -= 0 if rank[i] == mixing.FIRST else sizes[i]
    near = [i for i in sizes if i not in taken and 0 < rank[i] < mixing.BIG and 0 < sizes[i] < 2 * gap]
    return taken | set(sorted(near, key=rank.get)[:1])


@pytest.mark.parametrize("rows_ordered", [5, 100_000])
def test_cells_are_divided(spark, monkeypatch, rows_ordered):
    """The same sample whether a cell is ordered at once or divided many times, and as in a plain walk."""
    monkeypatch.setattr(mixing, "HOT_ROWS", rows_ordered)
    monkeypatch.setattr(mixing, "CELLS", 4)
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    ranked, state = mixing.mix_plan(docs)
    rows, per = ranked.collect(), {r.source: r for r in state.collect()}
    got = {r.doc_id for r in mixing.mix(docs).collect() if r.copies > per[r.source].certain}
    want = set()
    for source, s in per.items():
        own = [r for r in rows if r.source == source]
        sure = sum(r.size for r in own if r.rank == mixing.FIRST)
        want |= by_hand({r.doc_id: r.size for r in own}, {r.doc_id: r.rank for r in own}, s.rest - sure)
    assert got == want
