"""JSON arrays in byte ranges against Python's own parser."""

import json
import random

import pytest
from pyspark.sql import types as T

from firnline.sources.json_arrays import read_records

SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("s", T.StringType()),
    T.StructField("o", T.StructType([T.StructField("p", T.ArrayType(T.LongType())), T.StructField("t", T.StringType())]))])


def records(n, nested, seed=0):
    rng, out = random.Random(seed), []
    for k in range(n):
        out.append({"k": k, "s": "".join(rng.choice(["a", "}", "{", "[", "]", ",", '"', "\\", "é", " ", "\n"]) for _ in range(rng.randint(0, 12)))})
        if rng.random() < nested:
            out[-1]["o"] = {"p": [1, k], "t": "}, {"}
    return out


def plain(r):
    return r["k"], r["s"], (r["o"]["p"], r["o"]["t"]) if r.get("o") else None


@pytest.fixture
def ranges(spark):
    """Sets the size of byte ranges for one test."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(k) for k in keys]
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(keys, (size, "1"))]
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["128m", "1k", "61b"])
@pytest.mark.parametrize("nested", [0.0, 0.4, 1.0])
def test_several_ranges_of_one_file(spark, tmp_path, ranges, size, nested):
    files = {"a": records(150, nested), "b": records(80, nested, 1), "c": []}
    (tmp_path / "a").write_text(json.dumps(files["a"]))
    (tmp_path / "b").write_text("﻿\n [\n" + " ,\n".join(json.dumps(r, indent=2, ensure_ascii=False) for r in files["b"]) + "\n]\n", encoding="utf-8")
    (tmp_path / "c").write_text(" [ ]\n")
    (tmp_path / "empty").write_text("")
    ranges(size)
    if size == "61b":
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 50
    got = sorted(read_records(spark, str(tmp_path), SCHEMA, position=True).collect(), key=lambda r: (r.file, r.nr))
    assert [(r.file, plain(r.asDict(True))) for r in got] == [(name, plain(r)) for name in "ab" for r in files[name]]
    assert len({(r.file, r.nr) for r in got}) == len(got)


def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, ranges):
    (tmp_path / "a.json").write_text(json.dumps(records(60, 0.3) + [{"k": "no number", "s": 5}, {}, {"k": None, "z": 1}]))
    ranges("300b")
    key = lambda r: str(r)
    whole = spark.read.schema(SCHEMA).json(str(tmp_path), multiLine=True)
    assert sorted(read_records(spark, str(tmp_path), SCHEMA).collect(), key=key) == sorted(whole.collect(), key=key)


@pytest.mark.parametrize("text", [
    '[{"k":1},{"k":2', '[{"k":1}', '{"k":1}', '{"k":1}\n{"k":2}\n', '[{"k":1}, 5]', '[1, {"k":1}]', '[{"s":"x]', '[[{"k":1}]]', '[{"k":1} {"k":2}] x'])
def test_other_files_are_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="array"):
        read_records(spark, str(tmp_path), SCHEMA).collect()


def test_records_of_one_piece_are_not_grouped(spark, tmp_path):
    """Flat records are parsed where their byte range is read back; the grouping gets the closing bracket alone."""
    (tmp_path / "a.json").write_text(json.dumps(records(50, 0.0)).replace("}\"", "\""))
    frame = read_records(spark, str(tmp_path), SCHEMA)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "EvalPython" not in plan and "CartesianProduct" not in plan
