"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.session import shared_folder

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words as a long; no array of words is kept."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def new_name(frame: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of the frame has that name."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_batches(batch: pa.RecordBatch, column: int = 1, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch with about limit bytes of text each: (first row, UTF-8 texts; NULL gives no bytes)."""
    first, held, total = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        raw = b"" if not value.is_valid else value.as_buffer().to_pybytes()
        held.append(raw)
        total += len(raw)
        if total >= limit:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each part begins (one entry more than parts)."""
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    v = values ^ (values >> np.uint64(30))
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


class Recent(dict):
    """A bounded memory of values by key: when it is full, what was not used since it was last full is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if not self.worth(key):
                return value
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def make(self, key):
        raise KeyError(key)

    def worth(self, key) -> bool:
        return True


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it, for a URI or an absolute path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, and hold a thousand rows at a time; done once for a Spark context."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts are long rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if getattr(context, "_firnline_shipped", False):
        return
    top, raw = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    target = f"{shared_folder(spark, 'package')}/firnline.zip"
    fs, inner = filesystem(target)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(raw.getvalue())
    context.addPyFile(target)
    context._firnline_shipped = True
