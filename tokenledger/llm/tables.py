"""Helpers the operators share: staged tables, clash-free rows, Arrow schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.session import stage

__all__ = ["stage", "packed", "unpacked", "load", "size_of", "join_checked"]

#: Column in which operators that return their input's rows carry them, so that no column of the input can clash.
ROW = "input_row"


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *columns) -> DataFrame:
    """The whole row as one struct, beside the given columns (names or expressions)."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW), *columns)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def size_of(df: DataFrame) -> int:
    """Rows of a staged table; Parquet footers answer it."""
    return df.count()


#: Rows of at most a few short columns that are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def join_checked(big: DataFrame, small: DataFrame, on: Column, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` joined with a narrow ``small``, which is counted first: broadcast up to ``limit`` rows, else shuffled.

    It keeps long texts where they are while few keys are wanted.
    """
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)
