"""Session helpers: where intermediate tables go, and the settings a run needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_TEXT_KEY = "tokenledger.text.partitions"


def build_session(
    app: str = "tokenledger", cpus: int | str = "*", shuffle_partitions: int = 8, text_partitions: int | None = None
) -> SparkSession:
    """A local session for tests and the benchmark. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get(_CHECKPOINT_KEY, None):
        spark.conf.set(_CHECKPOINT_KEY, f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged")
    if text_partitions:
        spark.conf.set(_TEXT_KEY, str(text_partitions))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if not configured:
        raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tokenledger/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and lets several outputs share one pass; the written table outlives lost executors.
    """
    target = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``stage``, with the rows cut by the hash of their keys into ``buckets`` files, sorted by key.

    Joins and groupings on exactly these keys then need no exchange on this side. The table's name leaves the catalog at
    once; the frame keeps its layout and the files stay where ``stage`` would put them.
    """
    spark = df.sparkSession
    table = f"staged_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    placed.option("path", path or new_path(spark, name)).saveAsTable(table)
    written = spark.table(table)
    spark.sql(f"drop table {table}")
    return written


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, dealt by its keys into as many partitions as the session asks for in ``tokenledger.text.partitions``.

    Unset (the default), rows stay where the scan puts them. Set it where a table of long texts is one file of one row
    group, which the scan cannot split. The plan follows from the session alone, never from the data.
    """
    parts = df.sparkSession.conf.get(_TEXT_KEY, None)
    return df.repartition(int(parts), *keys) if parts else df


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove the intermediate tables of finished work below the shared folder."""
    drop(spark, f"{shared_dir(spark)}/tokenledger")
