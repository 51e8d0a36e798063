"""Live forms of ingest, the response cache, heartbeats and the statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from .. import schema
from ..config import Config
from ..functions.pricing import PRICES, Price
from ..operators.cache import find_hits
from ..operators.verify import kill
from ..session import drop, stage
from ..sources.ingest import ingest_usage
from . import commits

DEAD_LETTERS = "dead_letters"


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _bad() -> Column:
    return F.col("id").isNull() | (F.coalesce("input_tokens", F.lit(0)) < 0) | (F.coalesce("output_tokens", F.lit(0)) < 0)


BAD_RECORD = "record has no id or negative token counts"
LETTER = "record string, error string, part string"
# Times in letters keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _letters(df: DataFrame, error: str, part: str) -> DataFrame:
    whole = F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), _JSON).alias("record")
    return df.select(whole, F.lit(error).alias("error"), F.lit(part).alias("part"))


def _store(spark: SparkSession, good: DataFrame, bad: DataFrame, target: str, batch_id: int, cfg: Config, prices: Sequence[Price]) -> None:
    """Write a batch's tables and letters, then publish them together. Where a table cannot be written, the good records
    become letters as well and no table of the batch counts."""
    commits.write(_letters(bad, BAD_RECORD, "check"), target, DEAD_LETTERS, batch_id)
    names = [DEAD_LETTERS]
    try:
        for name, table in ingest_usage(good, cfg, prices).items():
            commits.write(table, target, name, batch_id)
            names.append(name)
    except Exception as error:  # noqa: BLE001 - any failed write must leave a trace, not end the stream
        failed = _letters(good, f"{type(error).__name__}: {error}", "write")
        commits.write(_letters(bad, BAD_RECORD, "check").unionByName(failed), target, DEAD_LETTERS, batch_id)
        names = [DEAD_LETTERS]

    def change(manifest: commits.Manifest) -> None:
        for name in names:
            manifest.add(name, batch_id)

    commits.publish(spark, target, change)


def stream_ingest(
    raw: DataFrame,
    target: str,
    checkpoint: str,
    cfg: Config = Config(),
    prices: Sequence[Price] = PRICES,
    once: bool = False,
) -> StreamingQuery:
    """Ingest a stream of client records into the tables below ``target``.

    All tables of a micro-batch become visible together (see :mod:`.commits`), so no reader sees a call without its
    parts, hits and actions. Records without an id, or with negative counts, go to ``dead_letters``; if a table cannot be
    written, all records of the batch do, with the error, and the stream goes on. :func:`replay_letters` takes them up.
    A micro-batch is written once and all its tables are made from that copy, which goes when the batch is published.
    """
    spark = raw.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        if commits.load(spark, target).holds(DEAD_LETTERS, batch_id):
            return  # published before a restart
        path = f"{target}/_incoming/batch_id={batch_id}"
        records = stage(df, "incoming", path)
        _store(spark, records.where(~_bad()), records.where(_bad()), target, batch_id, cfg, prices)
        drop(spark, path)

    return _start(raw, batch, checkpoint, once)


def read_batches(spark: SparkSession, target: str, name: str, ddl=None) -> DataFrame:
    """A table written by micro-batches; only what was published."""
    return commits.read(spark, target, name, ddl if ddl is not None else schema.TABLES[name])


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """``(record, error, part)`` of all records that were not stored when they came."""
    return commits.read(spark, target, DEAD_LETTERS, LETTER)


def replay_letters(
    spark: SparkSession,
    target: str,
    record: StructType | str,
    mend: Callable[[DataFrame], DataFrame] = lambda df: df,
    cfg: Config = Config(),
    prices: Sequence[Price] = PRICES,
) -> DataFrame:
    """Ingest the letters below ``target`` that are good records after ``mend``; returns those that still are not.

    ``record`` is the schema the letters were sent in, ``mend`` a change of such a table. A letter whose id has been stored
    meanwhile, by the stream or an earlier replay, is not stored again; of several letters with one id, one is. The replay
    is a batch of its own, with a negative number, and is published as one. Running it again stores nothing new.
    """
    given = spark.createDataFrame([], record).schema
    sent = mend(dead_letters(spark, target).select(F.from_json("record", given, _JSON).alias("r")).select("r.*"))
    stored = read_batches(spark, target, "usage_data").select(F.col("id").alias("_stored"))
    number = -1 - commits.load(spark, target).facts.get("replays", 0)
    path = f"{target}/_incoming/batch_id={number}"
    # One letter of each id is chosen, after map-side combine; whole records move once.
    one = sent.where(~_bad()).groupBy("id").agg(F.min(F.to_json(F.struct(*sent.columns), _JSON)).alias("_one"))
    fresh = one.join(stored, one["id"] == stored["_stored"], "left_anti")
    records = stage(fresh.select(F.from_json("_one", sent.schema, _JSON).alias("r")).select("r.*"), "incoming", path)
    tables = ingest_usage(records, cfg, prices)
    for name, table in tables.items():
        commits.write(table, target, name, number)

    def change(manifest: commits.Manifest) -> None:
        for name in tables:
            manifest.add(name, number)
        manifest.facts["replays"] = -number

    commits.publish(spark, target, change)
    drop(spark, path)
    return sent.where(_bad())


CACHE_ROW = "prompt_hash string, id string, timestamp timestamp, response_content string"
CALL_ROW = "id string, prompt_hash string, timestamp timestamp, cached_usage_id string"
# Of the rows written for a batch: the reply of a miss, and whether its hash was stored before.
_REPLAYED = f"{CALL_ROW}, response_content string, known boolean"
#: Parts that the stored keys are cut into, and batches of them after which they become one snapshot.
CACHE_BUCKETS = 64
COMPACT_AFTER = 16


def stream_cache(
    calls: DataFrame, target: str, checkpoint: str, once: bool = False, buckets: int = CACHE_BUCKETS, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Mark each call ``(id, prompt_hash, timestamp, response_content)`` of a stream as a hit or a miss.

    The stored keys lie in folders by the hash of the key. A batch reads only the folders of its own hashes, replays the
    rest within the batch, and adds the hashes seen for the first time; its calls and its keys are published together, so
    a restart gives the same answers. After ``compact_after`` batches the keys are merged into one snapshot. The join
    with the stored keys and the replay are plain joins, which adaptive execution can split for a hot hash; no task ever
    holds all calls of one hash.
    """
    spark = calls.sparkSession
    bucket = F.pmod(F.xxhash64("prompt_hash"), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, batch_id: int) -> None:
        manifest = commits.load(spark, target)
        if manifest.holds("calls", batch_id):
            return  # published before a restart
        asked = [row[0] for row in df.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        known = commits.read(spark, target, "cache", f"{CACHE_ROW}, bucket int", manifest)
        stored = known.where(F.col("bucket").isin(asked)).select("prompt_hash", F.col("id").alias("_known"))
        joined = df.select("id", "prompt_hash", "timestamp", "response_content").join(stored, "prompt_hash", "left")
        replayed = find_hits(joined).withColumn("cached_usage_id", F.coalesce("_known", "cached_usage_id"))
        # Written once; the calls and the new answers are both read from there.
        reply = F.when(F.col("cached_usage_id").isNull(), F.col("response_content")).alias("response_content")
        marked = replayed.select("id", "prompt_hash", "timestamp", "cached_usage_id", reply, F.col("_known").isNotNull().alias("known"))
        written = spark.read.schema(_REPLAYED).parquet(commits.write(marked, target, "calls", batch_id))
        fresh = (
            written.where("not known and coalesce(response_content, '') <> ''")
            .groupBy("prompt_hash")
            .agg(F.min(F.struct("timestamp", "id", "response_content")).alias("_first"))
            .select("prompt_hash", "_first.id", "_first.timestamp", "_first.response_content", bucket.alias("bucket"))
        )
        snapshot = manifest.batches("cache") >= compact_after
        keys = known.unionByName(fresh) if snapshot else fresh
        commits.write(keys.repartition("bucket"), target, "cache", batch_id, ("bucket",))

        def change(newest: commits.Manifest) -> None:
            newest.add("calls", batch_id)
            newest.add("cache", batch_id, snapshot)

        commits.publish(spark, target, change)
        if snapshot:
            commits.remove_unread(spark, target, "cache", batch_id - compact_after)

    return _start(calls, batch, checkpoint, once)


def read_calls(spark: SparkSession, target: str) -> DataFrame:
    """The calls that :func:`stream_cache` has marked."""
    return commits.read(spark, target, "calls", CALL_ROW)


HEARTBEAT = "request_id string, id string, timestamp timestamp, status string, confidence double, previous_status string"


def _chainer(idle_ms: int | None):
    """The state function, nested so that it travels to the workers by value."""

    def chain(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Give each verdict of one request the status before it; only that one status is kept."""
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["timestamp", "id"], kind="stable")
        previous = state.get[0] if state.exists else None
        chained = rows["status"].shift(1)
        chained.iloc[0] = previous
        state.update((rows["status"].iloc[-1],))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            {
                "request_id": key[0],
                "id": rows["id"],
                "timestamp": rows["timestamp"],
                "status": rows["status"],
                "confidence": rows["confidence"],
                "previous_status": chained.astype(object).where(chained.notna(), None),
            }
        )

    return chain


def heartbeat_state(verdicts: DataFrame, threshold: float = 0.7, idle_ms: int | None = None) -> DataFrame:
    """Verdicts of a stream ``(request_id, id, timestamp, status, confidence)`` with the previous status and a stop flag.

    The state of a request is one status, dropped when no verdict comes for ``idle_ms`` (set it on a trigger that keeps
    running). Verdicts of one request arrive in step with its heartbeats, so a
    micro-batch (bounded by the source's rate limit) holds few of each.
    """
    rows = verdicts.select(
        "request_id", "id", F.col("timestamp").cast("timestamp").alias("timestamp"), "status", "confidence"
    )
    chained = rows.groupBy("request_id").applyInPandasWithState(
        _chainer(idle_ms), HEARTBEAT, "status string", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )
    return chained.withColumn("stop", kill(F.col("status"), F.col("confidence"), threshold))


def live_stats(
    usage: DataFrame, window: str = "1 day", watermark: str = "1 hour", by: Sequence[str] = ("org_id", "provider", "model")
) -> DataFrame:
    """Windowed totals of a live (or stored) usage log; rows later than the watermark are left out of closed windows."""
    rows = usage.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("timestamp", watermark)
    saved = F.coalesce("saved_tokens", F.lit(0))
    return (
        rows.groupBy(F.window("timestamp", window).alias("_window"), *by)
        .agg(
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("total_cost").alias("total_cost"),
            F.sum(F.when(F.col("type") == "cache_hit", saved).otherwise(0)).alias("cache_saved_tokens"),
            F.sum(F.when(F.col("type") == "execution", saved).otherwise(0)).alias("compression_saved_tokens"),
            F.count("id").alias("total_requests"),
            F.count_if(F.col("type") == "cache_hit").alias("total_cache_hits"),
        )
        .withColumns({"window_start": F.col("_window.start"), "window_end": F.col("_window.end")})
        .drop("_window")
    )


_SUMS = ("total_tokens", "total_cost", "cache_saved_tokens", "compression_saved_tokens", "total_requests", "total_cache_hits")


def stream_stats(stats: DataFrame, target: str, checkpoint: str, once: bool = False, compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Keep the newest figures of every window of :func:`live_stats`, open or closed, below ``target``.

    Each micro-batch writes the windows it changed into its own folder; after ``compact_after`` of them, the newest of
    each window become one snapshot. :func:`read_stats` takes the newest of each.
    """
    spark = stats.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        manifest = commits.load(spark, target)
        if manifest.holds("stats", batch_id):
            return
        rows = df.withColumn("written", F.lit(batch_id).cast("bigint"))
        snapshot = manifest.batches("stats") >= compact_after
        if snapshot:
            older = commits.read(spark, target, "stats", rows.schema, manifest)
            rows = _newest(older.unionByName(rows), [c for c in df.columns if c not in _SUMS])
        commits.write(rows, target, "stats", batch_id)
        commits.publish(spark, target, lambda newest: newest.add("stats", batch_id, snapshot))
        if snapshot:
            commits.remove_unread(spark, target, "stats", batch_id - compact_after)

    writer = stats.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "written").alias("_newest"))
    return newest.select(*keys, "_newest.*")


def read_stats(spark: SparkSession, target: str, ddl: StructType) -> DataFrame:
    """The newest figures of each window that :func:`stream_stats` has written."""
    rows = commits.read(spark, target, "stats", StructType([*ddl.fields, StructField("written", LongType())]))
    return _newest(rows, [f.name for f in ddl.fields if f.name not in _SUMS]).drop("written")


def stream_totals(
    usage: DataFrame,
    target: str,
    checkpoint: str,
    window: str = "1 day",
    watermark: str = "1 hour",
    by: Sequence[str] = ("org_id", "provider", "model"),
    once: bool = False,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """The figures of :func:`live_stats` with nothing lost: rows that come too late are kept in a table of their own.

    A row is late if its window ended at or before the watermark: the latest time of all earlier micro-batches less
    ``watermark``. The figures are sums, so a batch stores what it adds to each window, the late rows go whole to
    ``late``, and both are published together; after ``compact_after`` batches the sums become one snapshot.
    :func:`read_totals` adds them up, and :func:`read_late` gives the late rows: together they are the batch's figures.
    Rows without a time are late.
    """
    spark = usage.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        manifest = commits.load(spark, target)
        if manifest.holds("late", batch_id):
            return
        path = f"{target}/_incoming/batch_id={batch_id}"
        rows = stage(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")), "incoming", path)
        latest = manifest.facts.get("latest")
        closed = F.lit(False) if latest is None else F.window("timestamp", window)["end"] <= F.timestamp_micros(F.lit(latest)) - F.expr(f"interval {watermark}")
        late = F.coalesce(closed, F.lit(False)) | F.col("timestamp").isNull()
        commits.write(rows.where(late), target, "late", batch_id)
        sums = live_stats(rows.where(~late), window, watermark, by)
        snapshot = manifest.batches("totals") >= compact_after
        if snapshot:
            sums = _added(commits.read(spark, target, "totals", sums.schema, manifest).unionByName(sums))
        commits.write(sums, target, "totals", batch_id)
        newest_time = rows.agg(F.unix_micros(F.max("timestamp"))).first()[0]

        def change(newest: commits.Manifest) -> None:
            newest.add("late", batch_id)
            newest.add("totals", batch_id, snapshot)
            newest.facts["latest"] = max((t for t in (latest, newest_time) if t is not None), default=None)

        commits.publish(spark, target, change)
        drop(spark, path)
        if snapshot:
            commits.remove_unread(spark, target, "totals", batch_id - compact_after)

    return _start(usage, batch, checkpoint, once)


def _added(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c not in _SUMS]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS]).select(*rows.columns)


def read_totals(spark: SparkSession, target: str, ddl: StructType) -> DataFrame:
    """The figures of each window that :func:`stream_totals` has counted in time; ``ddl`` is the schema of ``live_stats``."""
    return _added(commits.read(spark, target, "totals", ddl))


def read_late(spark: SparkSession, target: str, ddl: StructType) -> DataFrame:
    """The rows that came behind the watermark; ``ddl`` is the schema of the usage rows."""
    return commits.read(spark, target, "late", ddl)
