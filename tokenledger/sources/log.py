"""Reading and writing the log's tables, filling in late columns, and seeding dimension rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

# Columns that came later, with the default of old rows (null where there is none).
LATE_COLUMNS = {
    "org_id": "default_org",
    "project_id": "default",
    "saved_cost": 0.0,
    "saved_tokens": 0,
    "type": "execution",
}

# Rows every log starts with.
SEED_ORG = ("default_org", "Default Organization")
SEED_USER_ID = "local_user"
SEED_ROLE = "admin"

# Usage rows are read by organisation and time, so files are laid out that way.
_PARTITIONS = {"usage_data": ["org_id", "date"]}


def backfill_schema(df: DataFrame, target: str, defaults: Mapping[str, object] = LATE_COLUMNS) -> DataFrame:
    """``df`` in the columns of ``target`` (DDL): missing ones added, nulls of late columns replaced by their default."""
    empty = df.sparkSession.createDataFrame([], target)
    filled = df.unionByName(empty, allowMissingColumns=True)
    return filled.select(
        *[
            (F.coalesce(F.col(f.name), F.lit(defaults[f.name])) if f.name in defaults else F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in empty.schema
        ]
    )


def append_absent(dimension: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """The dimension with those new rows whose key it does not hold yet."""
    keys = [key] if isinstance(key, str) else key
    return dimension.unionByName(new.join(dimension.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def seed_rows(spark: SparkSession, email: str = "dev@localhost") -> dict[str, DataFrame]:
    """Default organisation, user and membership, to be added with :func:`append_absent`."""
    rows = {
        "organizations": (("id", SEED_ORG[0]), ("name", SEED_ORG[1])),
        "users": (("id", SEED_USER_ID), ("email", email), ("name", "Local Developer")),
        "organization_members": (("org_id", SEED_ORG[0]), ("user_id", SEED_USER_ID), ("role", SEED_ROLE)),
    }
    return {
        name: spark.createDataFrame([tuple(v for _, v in row)], ", ".join(f"{c} string" for c, _ in row))
        for name, row in rows.items()
    }


def _defaulted(df: DataFrame) -> DataFrame:
    late = {c: F.coalesce(F.col(c), F.lit(v)).cast(df.schema[c].dataType) for c, v in LATE_COLUMNS.items() if c in df.columns}
    return df.withColumns(late) if late else df


def read_log(spark: SparkSession, source: str | Mapping[str, str], tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The log's tables by name, from a folder of parquet tables or, given JDBC options, from a database.

    Files and tables of several ages may stand side by side: columns that a row was written without get their default.
    Partition columns stay, so that a filter on them prunes files. JDBC options may hold ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read in parallel.
    """
    names = tables or list(schema.TABLES)
    if isinstance(source, str):
        return {n: _defaulted(spark.read.schema(schema.TABLES[n]).parquet(f"{source.rstrip('/')}/{n}")) for n in names}
    prefix = source.get("schema", "")
    options = {k: v for k, v in source.items() if k != "schema"}
    return {
        n: backfill_schema(
            spark.read.format("jdbc").options(**options, dbtable=f"{prefix}.{n}" if prefix else n).load(),
            schema.TABLES[n],
        )
        for n in names
    }


def write_log(tables: Mapping[str, DataFrame], target: str | Mapping[str, str], mode: str = "append") -> None:
    """Write tables to a folder of parquet tables (usage partitioned by organisation and day) or to a database."""
    for name, df in tables.items():
        if not isinstance(target, str):
            prefix = target.get("schema", "")
            options = {k: v for k, v in target.items() if k != "schema"}
            writer = df.write.format("jdbc").options(**options, dbtable=f"{prefix}.{name}" if prefix else name)
            writer.mode(mode).save()
            continue
        path = f"{target.rstrip('/')}/{name}"
        if name in _PARTITIONS and "timestamp" in df.columns:
            dated = df.withColumn("date", F.to_date("timestamp"))
            # AQE's rebalance spreads a hot organisation and day over several files and merges small ones.
            dated.hint("rebalance", *_PARTITIONS[name]).write.mode(mode).partitionBy(*_PARTITIONS[name]).parquet(path)
        else:
            df.write.mode(mode).parquet(path)
