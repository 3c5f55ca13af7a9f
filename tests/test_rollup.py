import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from firnline.operators import medians, moving, rollup
from firnline.operators.medians import bracketed_median
from tests.conftest import rows


def test_rollup_skips_nulls_and_null_keys(spark):
    frame = spark.createDataFrame([
        ("A", "d1", "t2", 1.0, 4.0, 7.0), ("A", "d1", "t1", 3.0, None, 9.0), ("A", "d1", "t3", None, 8.0, None),
        ("B", "d1", "t1", None, None, None), (None, "d1", "t1", 5.0, 5.0, 5.0)],
        "s STRING, d STRING, t STRING, h DOUBLE, m DOUBLE, x DOUBLE")
    got = rollup.daily_rollup(frame, ["d", "s"], "t", ["h"], ["m"], ["x"])
    assert rows(got, "s") == [("d1", "A", "t1", 2.0, 6.0, 9.0), ("d1", "B", "t1", None, None, None)]


def _readings(spark):
    rng = random.Random(5)
    data = [(rng.choice("aaaaaaaab"), rng.choice([1, 2]), i, rng.choice([None, rng.gauss(0, 9), 1.0])) for i in range(4000)]
    data += [("c", 1, 1, 7.5), ("d", 1, 1, None)]
    return data, spark.createDataFrame(data, "s STRING, d INT, t INT, h DOUBLE")


def test_split_plan_equals_plain_plan(spark):
    _, frame = _readings(spark)
    args = (["d", "s"], "t", ["h"], [], [])
    plain = rows(rollup.daily_rollup(frame, *args), "d", "s")
    for hot_rows in (1, 500, 10**9):
        split = rollup.daily_rollup(frame, *args, hot_rows=hot_rows)
        assert rows(split, "d", "s") == plain


def test_bracketed_median_is_exact(spark):
    data, frame = _readings(spark)
    got = {(r.d, r.s): r.h for r in bracketed_median(frame, ["d", "s"], "h").collect()}
    for key in {(d, s) for s, d, _, _ in data}:
        values = [h for s, d, _, h in data if (d, s) == key and h is not None]
        if values:
            assert got[key] == pytest.approx(statistics.median(values), abs=0)


@pytest.mark.parametrize("margin", [-0.3, 0.2, None])
def test_a_missed_bracket_is_searched_exactly(spark, monkeypatch, margin):
    """With a bracket that is empty (or lies on one side) for every group, medians still are exact."""
    rng = random.Random(7)
    groups = {
        "even": [rng.random() for _ in range(1000)], "odd": [rng.gauss(0, 1) for _ in range(777)], "same": [3.5] * 400, "two": [1.0] * 300 + [2.0] * 300,
        "wide": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(900)], "one": [4.0], "pair": [1.0, 2.0], "heavy": [0.0] * 500 + [rng.random() for _ in range(499)]}
    frame = spark.createDataFrame([(k, v) for k, values in groups.items() for v in [*values, None]], "k STRING, v DOUBLE").repartition(3)
    if margin is None:
        monkeypatch.setattr(medians, "PIVOTS", 2)
        monkeypatch.setattr(medians, "MARGIN", -0.3)
    else:
        monkeypatch.setattr(medians, "MARGIN", margin)
    monkeypatch.setattr(medians, "ACCURACY", 3)
    got = {r.k: r.v for r in bracketed_median(frame, ["k"], "v").collect()}
    assert got == {k: statistics.median(values) for k, values in groups.items()}


def test_circular_mean(spark):
    frame = spark.createDataFrame([(350.0,), (10.0,)], "w DOUBLE")
    assert frame.agg(rollup.circular_mean(F.col("w"))).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_moving_average_needs_full_window_without_nulls(spark):
    values = [1.0, 2.0, None, 4.0, 5.0, 6.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    got = [r.v_avg for r in moving.moving_average(frame, ["v"], 2, ["i"]).orderBy("i").collect()]
    assert got == [None, 1.5, None, None, 4.5, 5.5]


def test_moving_average_counts_rows_not_days(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 9), dt.date(2024, 3, 1)]
    frame = spark.createDataFrame([("A", d, float(i)) for i, d in enumerate(days)], "s STRING, d DATE, v DOUBLE")
    got = [r.v_avg for r in moving.moving_average(frame, ["v"], 3, ["d"], ["s"]).orderBy("d").collect()]
    assert got == [None, None, 1.0]


def averages(data, n):
    """By hand: data of (station, place, value), where ties of a place follow the value, NULL first."""
    out, groups = [], {}
    for s, i, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or 0.0)):
        values = groups.setdefault(s, [])
        values.append(v)
        last = values[-n:]
        out.append((s, i, v, sum(last) / n if len(last) == n and None not in last else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 40])
@pytest.mark.parametrize("n", [1, 4, 30])
def test_ranges_with_a_halo_equal_one_window(spark, parts, n):
    """Ranges of about 300, 75 and 7 rows, so that a window spans several of them; one station has two thirds of the rows."""
    rng = random.Random(parts + n)
    data = [(rng.choice(["A", "A", "A", "A", "B", None]), rng.randrange(200), rng.choice([None, *[float(rng.randrange(9))] * 40])) for _ in range(300)]
    frame = spark.createDataFrame(data, "s STRING, i INT, v DOUBLE").repartition(5)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        placed, starts = moving._ranged(frame, ["s", "i", "v"])
        assert starts[-1] == 300 and (parts == 1 or max(b - a for a, b in zip(starts, starts[1:])) < 250)
        got = sorted(map(tuple, moving.moving_average(frame, ["v"], n, ["i"], ["s"]).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = averages(data, n)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3]) if w[3] is not None else g[3] is None for g, w in zip(got, want))


def test_moving_average_of_nothing(spark):
    frame = spark.createDataFrame([], "s STRING, i INT, v DOUBLE")
    assert moving.moving_average(frame, ["v"], 3, ["i"], ["s"]).collect() == []
