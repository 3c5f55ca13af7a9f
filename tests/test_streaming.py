import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from firnline import schemas
from firnline.operators.clusters import RiskModel
from firnline.operators.rollup import daily_rollup
from firnline.operators.scaling import Scaler
from firnline.streaming import jobs
from firnline.vocabulary import FEATURES
from tests.conftest import rows

R = "nr BIGINT, station STRING, t TIMESTAMP, day DATE, v DOUBLE"


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def land(spark, folder, data):
    spark.createDataFrame([(n, s, t, t.date(), v) for n, s, t, v in data], R).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return jobs.landed_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def roll(frame):
    return daily_rollup(frame, ["day", "station"], "t", ["v"], [], [])


def test_ingest_adds_only_new_files(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/in", [(1, "A", at(1, 1), 1.0)])
    jobs.append_stream(stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", ["day"])
    land(spark, f"{root}/in", [(2, "A", at(2, 1), 2.0)])
    for _ in range(2):
        jobs.append_stream(stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", ["day"])
    assert [r.nr for r in spark.read.parquet(f"{root}/out").orderBy("nr").collect()] == [1, 2]


def test_exact_dedupe_keeps_the_first_batch(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/in", [(1, "A", at(1, 1), 1.0), (2, "A", at(1, 1), 2.0), (3, "B", at(1, 1), 3.0)])
    jobs.dedupe_stream(stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", ["station", "t"], ["nr"], "day")
    land(spark, f"{root}/in", [(4, "A", at(1, 1), 4.0), (5, "A", at(1, 2), 5.0), (6, "A", at(3, 1), 6.0)])
    jobs.dedupe_stream(stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", ["station", "t"], ["nr"], "day")
    assert [r.nr for r in spark.read.parquet(f"{root}/out").orderBy("nr").collect()] == [1, 3, 5, 6]


def test_dedupe_over_many_batches_reads_no_stored_rows(spark, tmp_path):
    """Ten batches with copies inside and across them, NULL keys and equal orders; the target is taken away in between."""
    rng, root, everything = random.Random(3), str(tmp_path), []
    seen, kept = set(), []
    for batch in range(10):
        data = [(rng.randrange(50) + 100 * batch, rng.choice(["A", "B", None]), at(rng.randint(1, 4), rng.randint(0, 5)), float(rng.randrange(3))) for _ in range(25)]
        land(spark, f"{root}/in{batch}", data)
        new = {}
        for n, s, t, v in sorted(data, key=lambda r: (r[0], r[2], r[3])):
            if (s, t) not in seen:
                new.setdefault((s, t), (n, s, t, v))
        seen |= set(new)
        kept += new.values()
        folders = spark.readStream.schema(R).parquet(f"{root}/in*")
        jobs.dedupe_stream(folders, f"{root}/out", f"{root}/cp", ["station", "t"], ["nr", "day", "v"], "day")
        everything += [tuple(r) for r in spark.read.schema(R).parquet(f"{root}/out").select("nr", "station", "t", "v").collect()]  # of this batch alone
        os.rename(f"{root}/out", f"{root}/out-of-batch-{batch}")
    assert sorted(everything, key=str) == sorted(kept, key=str)


def test_dedupe_with_bounded_state(spark, tmp_path):
    root = str(tmp_path)
    batches = [[(1, "A", at(1, 1), 1.0), (2, "A", at(1, 2), 2.0)], [(3, "A", at(1, 1), 3.0), (4, "A", at(9, 1), 4.0)], [(5, "A", at(9, 2), 5.0)],
               [(6, "A", at(1, 1), 6.0), (7, "A", at(9, 1), 7.0), (8, "A", at(9, 3), 8.0)]]
    for data in batches:
        land(spark, f"{root}/in", data)
        jobs.dedupe_stream(stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", ["station", "t"], ["nr"], "day", event_time="t", delay="2 days")
    assert [r.nr for r in spark.read.parquet(f"{root}/out").orderBy("nr").collect()] == [1, 2, 4, 5, 8], "6 is too late, 3 and 7 are copies"
    with pytest.raises(ValueError, match="event time"):
        jobs.dedupe_stream(stream(spark, f"{root}/in"), f"{root}/o", f"{root}/c", ["station"], ["nr"], "day", event_time="t", delay="1 day")


def test_late_rows_change_their_day(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/in", [(1, "A", at(1, 1), 1.0), (2, "A", at(2, 1), 5.0)])
    args = (f"{root}/store", f"{root}/out", f"{root}/cp", "day", roll)
    jobs.daily_stream(stream(spark, f"{root}/in"), *args)
    land(spark, f"{root}/in", [(3, "A", at(1, 2), 3.0), (4, "B", at(1, 2), 9.0)])
    jobs.daily_stream(stream(spark, f"{root}/in"), *args)
    got = spark.read.parquet(f"{root}/out").select(F.col("day").cast("date").alias("day"), "station", "t", "v")
    assert rows(got, "day", "station") == rows(roll(spark.read.parquet(f"{root}/in")), "day", "station")
    assert got.count() == 3


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    """The output is there but the checkpoint is lost: everything is processed again."""
    root = str(tmp_path)
    land(spark, f"{root}/in", [(1, "A", at(1, 1), 1.0), (2, "A", at(1, 1), 2.0)])
    for attempt in range(2):
        jobs.dedupe_stream(stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp{attempt}", ["station", "t"], ["nr"], "day")
        jobs.daily_stream(stream(spark, f"{root}/in"), f"{root}/store", f"{root}/daily", f"{root}/dcp{attempt}", "day", roll)
    assert [r.nr for r in spark.read.parquet(f"{root}/out").collect()] == [1]
    assert [r.v for r in spark.read.parquet(f"{root}/daily").collect()] == [1.5]


def test_bounded_state_dedupe_and_windowed_rollup(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/in", [(1, "A", at(1, 1), 1.0), (2, "A", at(1, 1), 1.0), (3, "A", at(1, 5), 3.0)])
    land(spark, f"{root}/in", [(4, "A", at(9, 1), 7.0)])
    jobs.append_stream(jobs.dedupe_within(stream(spark, f"{root}/in"), ["station", "t"], "t", "1 day"), f"{root}/out", f"{root}/cp")
    assert spark.read.parquet(f"{root}/out").count() == 3
    daily = jobs.windowed_daily(stream(spark, f"{root}/out"), "t", "station", "1 day", [F.median("v").alias("v")])
    jobs.append_stream(daily, f"{root}/daily", f"{root}/dcp")
    assert rows(spark.read.parquet(f"{root}/daily")) == [(dt.date(2024, 1, 1), "A", 2.0)], "the open day waits for the watermark"


def test_json_arrays_as_a_stream(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.json", "w") as out:
        out.write('[{"station_code": "A", "measure_date": "2024-01-01T06:00:00Z", "HS": 1.5},\n {"station_code": "B", "HS": null}]')
    jobs.append_stream(jobs.landed_files(spark, f"{tmp_path}/in", schemas.SNOW_RECORD, "json"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got.select("station_code", "HS"), "station_code") == [("A", 1.5), ("B", None)]


def test_scores_equal_batch_scores(spark, tmp_path):
    model = RiskModel(Scaler(FEATURES, [0.0] * 4, [1.0] * 4), {0: [0.0] * 4, 1: [5.0] * 4}, [[1.0, 0, 0, 0], [0, 1.0, 0, 0]])
    frame = spark.createDataFrame([(1.0, 2.0, 0.0, 0.0), (6.0, 6.0, 6.0, 6.0), (None, 0.0, 0.0, 0.0)], ", ".join(f"{f} DOUBLE" for f in FEATURES))
    frame.write.parquet(f"{tmp_path}/in")
    jobs.score_stream(jobs.landed_files(spark, f"{tmp_path}/in", frame.schema), model, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").select("PCA1", "PCA2", "k_cluster")
    assert rows(got, "PCA1") == [(1.0, 2.0, 0), (6.0, 6.0, 1)] == rows(model.score(frame).select("PCA1", "PCA2", "k_cluster"), "PCA1")


def test_a_failing_stream_raises(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [(1, "A", at(1, 1), 1.0)])

    def fail(batch, number):
        raise RuntimeError("no")

    with pytest.raises(Exception):
        jobs.each_batch(stream(spark, f"{tmp_path}/in"), fail, f"{tmp_path}/cp")
