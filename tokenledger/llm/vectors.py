"""Vectors as blocks of whole numbers, and scores of any size, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 256
#: What a task holds at most: bytes of its stored rows as doubles, asking rows. And the stored rows that are worth a task.
GROUP_BYTES = 32 << 20
GROUP_LEAST = 2048
ASKING = 8192

_HUGE = float(np.finfo(np.float64).max)
_LEAST, _MOST = -(2**63), 2**63 - 1


def _floor(x: Column) -> Column:
    """The floor of a double as a double; from 2^52 on a double is whole already."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def whole(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, where: Column | None = None, **more: Column) -> DataFrame:
    """``(vec_id, vector)`` and more columns; the vectors are whole numbers ``floor(scale * x)``, as doubles. Rows that are
    null, or hold a null or a component that is not finite, are left out; all others stay, however large. (Only of a
    component stored as double beyond 2^1015, the greatest double takes the place of its multiple.)"""
    value = F.col(column)
    usable = value.isNotNull() & F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.filter(usable if where is None else usable & where)
    scaled = F.transform(value, lambda x: F.greatest(F.least(_floor(x.cast("double") * scale), F.lit(_HUGE)), F.lit(-_HUGE)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *[c.alias(name) for name, c in more.items()], scaled.alias("vector"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows, made where they lie: nothing is shuffled. ``labels`` where rows have a ``label``."""
    labelled = "label" in rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            lists = pa.concat_arrays(part.column("vector").chunks)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            matrix = np.zeros((part.num_rows, max(int(widths.max()), 1)), "<f8")
            matrix[np.arange(matrix.shape[1]) < widths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            raw = matrix.astype("<i2" if np.abs(matrix).max(initial=0) < 1 << 15 else "<f8").tobytes()
            one = {
                "block": pa.array([number]), "rows": pa.array([matrix.shape[0]], pa.int32()), "width": pa.array([matrix.shape[1]], pa.int32()),
                "ids": pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), "matrix": pa.array([raw], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(one | ({"labels": pa.array([part.column("label").to_pylist()], pa.list_(pa.int64()))} if labelled else {}))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield made()
                    number, held, count = number + 1, [], 0
        if held:
            yield made()

    return rows.mapInArrow(cut, "block long, rows int, width int, ids array<long>, matrix binary" + ", labels array<long>" * labelled)


def matrix_of(row: dict) -> np.ndarray:
    """A block's rows as doubles."""
    cells = row["rows"] * row["width"]
    kind = "<i2" if len(row["matrix"]) == 2 * cells else "<f8"
    return np.frombuffer(row["matrix"], kind).astype(np.float64).reshape(row["rows"], row["width"])


def meet(stored: DataFrame, asking: DataFrame, function, kind: str, group_bytes: int = GROUP_BYTES, least: int = GROUP_LEAST, most_asking: int = ASKING) -> DataFrame:
    """``function(stored rows, asking rows)`` for each pair of a group of stored blocks and a group of asking blocks: the
    asking set against all rows, in blocks. There are as many groups of stored rows as there are tasks to fill, within both
    limits; both tables are written ones.
    """
    spark: SparkSession = stored.sparkSession
    total, width = (x or 1 for x in stored.agg(F.sum("rows"), F.max("width")).first())
    asked = asking.agg(F.sum("rows")).first()[0] or 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_group = min(max(least, -(-total // tasks)), max(1, group_bytes // (8 * width)))
    groups, asking_groups = -(-total // of_group), -(-asked // most_asking)

    def dealt(parts: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")

    def all_of(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = stored.withColumn("group", dealt(groups)).select("*", all_of(asking_groups).alias("asking_group"))
    right = asking.withColumn("asking_group", dealt(asking_groups)).select("*", all_of(groups).alias("group"))
    return left.groupBy("group", "asking_group").cogroup(right.groupBy("group", "asking_group")).applyInArrow(function, kind)


def shown(score: Column) -> Column:
    """The long nearest to a score that is written as a whole number."""
    return F.coalesce(score.try_cast("long"), F.when(score.startswith("-"), F.lit(_LEAST)).otherwise(F.lit(_MOST)))


def falling(score: Column) -> list[Column]:
    """The order of scores written as whole numbers of any size, highest first."""
    negative = score.startswith("-")
    size = F.when(negative, -F.length(score)).otherwise(F.length(score))
    return [negative.asc(), size.desc(), F.when(~negative, score).desc_nulls_last(), F.when(negative, score).asc_nulls_last()]
