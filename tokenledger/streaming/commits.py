"""Tables written by micro-batches, made visible all at once.

A batch writes its rows of every table below ``<target>/<table>/batch_id=<n>``. Nobody reads them until the batch is
published: a manifest, written last, names for each table the ranges of batches that count. A batch that is run again
overwrites its folders and changes nothing once it is published, so readers never see a part of a batch, or one twice.
A manifest is created under a number of its own and never overwritten; a writer that comes second reads again and retries.
A snapshot replaces all earlier batches of a table, so that reading does not cost more with every batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

FOLDER = "_commits"
#: Manifests that stay for readers that are at it.
KEPT = 5
_ATTEMPTS = 20


@dataclass
class Manifest:
    """What counts: ranges ``[first, last]`` of batches for each table, and facts that a stream keeps between batches."""

    number: int = -1
    tables: dict[str, list[list[int]]] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)

    def holds(self, table: str, batch_id: int) -> bool:
        return any(low <= batch_id <= high for low, high in self.tables.get(table, []))

    def batches(self, table: str) -> int:
        """How many batches of a table are read."""
        return sum(high - low + 1 for low, high in self.tables.get(table, []))

    def add(self, table: str, batch_id: int, snapshot: bool = False) -> None:
        """Let a batch count; a snapshot in place of all others."""
        ranges = [] if snapshot else [r for r in self.tables.get(table, [])]
        if not any(low <= batch_id <= high for low, high in ranges):
            ranges.append([batch_id, batch_id])
        merged: list[list[int]] = []
        for low, high in sorted(ranges):
            if merged and low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        self.tables[table] = merged


def _files(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{FOLDER}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(path, files) -> list[int]:
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def load(spark: SparkSession, target: str) -> Manifest:
    """The newest manifest; an empty one where nothing was published."""
    path, files = _files(spark, target)
    numbers = _numbers(path, files)
    if not numbers:
        return Manifest()
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, f"{numbers[-1]}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    stored = json.loads(text)
    return Manifest(numbers[-1], stored["tables"], stored["facts"])


def publish(spark: SparkSession, target: str, change: Callable[[Manifest], None]) -> Manifest:
    """Apply ``change`` to the newest manifest and make the result the newest one."""
    path, files = _files(spark, target)
    files.mkdirs(path)
    for _ in range(_ATTEMPTS):
        manifest = load(spark, target)
        change(manifest)
        manifest.number += 1
        text = json.dumps({"tables": manifest.tables, "facts": manifest.facts})
        # Written beside it and then renamed: a manifest is there as a whole or not at all, and renaming never overwrites.
        draft = spark._jvm.org.apache.hadoop.fs.Path(path, f".{manifest.number}.{spark._jvm.java.util.UUID.randomUUID()}")
        stream = files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        final = spark._jvm.org.apache.hadoop.fs.Path(path, f"{manifest.number}.json")
        try:
            done = not files.exists(final) and files.rename(draft, final)
        except Py4JJavaError:  # some stores raise where another writer was first
            done = False
        if done:
            for old in _numbers(path, files)[:-KEPT]:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"{old}.json"), False)
            return manifest
        files.delete(draft, False)
    raise RuntimeError(f"{target}: other writers were first {_ATTEMPTS} times")


def write(df: DataFrame, target: str, table: str, batch_id: int, partitions: tuple[str, ...] = ()) -> str:
    """A batch's rows of a table; not visible until it is published."""
    path = f"{target}/{table}/batch_id={batch_id}"
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return path


def _within(ranges: list[list[int]]) -> Column:
    return reduce(Column.__or__, [F.col("batch_id").between(low, high) for low, high in ranges])


def read(spark: SparkSession, target: str, table: str, ddl: StructType | str, manifest: Manifest | None = None) -> DataFrame:
    """The published rows of a table; only the folders that count are scanned."""
    found = manifest or load(spark, target)
    given = spark.createDataFrame([], ddl).schema
    ranges = found.tables.get(table)
    if not ranges:
        return spark.createDataFrame([], given)
    rows = spark.read.schema(StructType([*given.fields, StructField("batch_id", LongType())])).parquet(f"{target}/{table}")
    return rows.where(_within(ranges)).select(*given.fieldNames())


def remove_unread(spark: SparkSession, target: str, table: str, upto: int) -> None:
    """Delete a table's batch folders up to a number that the newest manifests no longer name, after a snapshot."""
    manifest = load(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{table}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        name = status.getPath().getName()
        number = name.removeprefix("batch_id=")
        if name != number and int(number) <= upto and not manifest.holds(table, int(number)):
            files.delete(status.getPath(), True)
