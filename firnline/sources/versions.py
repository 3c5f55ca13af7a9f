"""Partitioned tables whose partitions are replaced in one step, for readers at any moment.

    path/data/version=<tag>/<column>=<value>/part-….parquet     written once, never changed
    path/snapshots/<number>.json                                which folder holds each partition

A rewrite puts the new partitions into a folder of their own and then adds a snapshot that names them; partitions that
it does not touch keep their folders. The snapshot appears under its number in one rename that fails if the number is
taken, so of two writers one fails and starts again from the newer state. A reader takes the snapshot of
the highest number: it sees all of a rewrite or nothing of it, and what it began to read stays in place until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class StaleSnapshot(RuntimeError):
    """Another writer came first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    schema: T.StructType
    folders: dict[str, str] = field(default_factory=dict)  # partition folder name -> version
    notes: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """A table below path, partitioned by one column."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def folder_name(self, value) -> str:
        escape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.column}={NO_VALUE if value is None else escape(str(value))}"

    # ---- reading ----

    def snapshot(self) -> Snapshot | None:
        """The newest state; None before the first write."""
        numbers = [int(n[:-5]) for n in self._names(f"{self.path}/snapshots") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        stream = self._fs.open(self._hadoop(f"{self.path}/snapshots/{max(numbers):012d}.json"))
        try:
            said = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return Snapshot(max(numbers), T.StructType.fromJson(said["schema"]), said["folders"], said["notes"])

    def read(self, snapshot: Snapshot | None = None, only: Iterable | None = None, but: Iterable | None = None) -> DataFrame:
        """Rows of the newest (or the given) state; only, but: values of the partition column to read or to leave out."""
        state = snapshot or self.snapshot()
        if state is None:
            raise FileNotFoundError(self.path)
        wanted = set(state.folders)
        if only is not None:
            wanted &= {self.folder_name(v) for v in only}
        if but is not None:
            wanted -= {self.folder_name(v) for v in but}
        columns = state.schema.fieldNames()
        if not wanted:
            return self.spark.createDataFrame([], state.schema)
        # the partition column is read from folder names, so filters on it choose folders
        stored = T.StructType([f for f in state.schema if f.name != self.column] + [state.schema[self.column]])
        folders = sorted(f"{self.path}/data/version={state.folders[name]}/{name}" for name in wanted)
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*folders).select(*columns)

    # ---- writing ----

    def write(self, rows: DataFrame, touched: Iterable | None = None, notes: dict[str, str] | None = None) -> Snapshot:
        """Put rows in the place of the touched partitions (of all of them if None); a partition without rows is gone."""
        before = self.snapshot()
        tag = uuid.uuid4().hex
        target = f"{self.path}/data/version={tag}"
        rows.hint("rebalance", self.column).write.partitionBy(self.column).parquet(target)
        new = [n for n in self._names(target) if n.startswith(f"{self.column}=")]
        folders = {}
        if before is not None and touched is not None:
            replaced = {self.folder_name(v) for v in touched}
            folders = {n: v for n, v in before.folders.items() if n not in replaced}
            if beside := set(new) & set(folders):
                raise ValueError(f"rows outside the touched partitions: {sorted(beside)[:3]}")
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        state = Snapshot((before.number if before else 0) + 1, nullable, folders | dict.fromkeys(new, tag), notes or {})
        self._commit(state)
        return state

    def change(self, body: Callable[[DataFrame], DataFrame], touched: Iterable) -> Snapshot:
        """Replace the touched partitions by body of their rows; body must keep the partition column's values."""
        touched = list(touched)
        return self.write(body(self.read(only=touched)), touched)

    def _commit(self, state: Snapshot) -> None:
        folder = f"{self.path}/snapshots"
        self._fs.mkdirs(self._hadoop(folder))
        said = {"schema": state.schema.jsonValue(), "folders": state.folders, "notes": state.notes}
        trial, final = self._hadoop(f"{folder}/.{uuid.uuid4().hex}"), self._hadoop(f"{folder}/{state.number:012d}.json")
        out = self._fs.create(trial, False)
        out.write(json.dumps(said).encode())
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(trial, final, options)
        except Exception as taken:
            self._fs.delete(trial, False)
            if self._fs.exists(final):
                raise StaleSnapshot(f"{self.path} has a snapshot {state.number} already") from taken
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions that none of the last snapshots names, and the older snapshots; call it while no writer is at work and no reader is older."""
        numbers = sorted(int(n[:-5]) for n in self._names(f"{self.path}/snapshots") if n.endswith(".json") and n[:-5].isdigit())
        used: set[str] = set()
        for number in numbers[-keep:]:
            stream = self._fs.open(self._hadoop(f"{self.path}/snapshots/{number:012d}.json"))
            used |= set(json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())["folders"].values())
            stream.close()
        gone = [n for n in self._names(f"{self.path}/data") if n.startswith("version=") and n[8:] not in used]
        for number in numbers[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/snapshots/{number:012d}.json"), False)
        for name in gone:
            self._fs.delete(self._hadoop(f"{self.path}/data/{name}"), True)
        return gone
