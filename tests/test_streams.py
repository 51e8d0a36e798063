"""Streams against their batch forms, repeated batches, and dead letters."""

import random

import pytest
from pyspark.sql import functions as F

import tokenledger as tl
from tokenledger.plans import queries, views
from tokenledger.session import new_path, shared_dir
from tokenledger.streaming import chunks, commits, live


def files(spark, frame, path, n):
    frame.repartition(n).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chunks_over_several_batches(spark, tmp_path):
    random.seed(2)
    rows = []
    for stream in range(25):
        n = random.randrange(1, 9)
        for seq in range(n):
            usage = (7 + stream, seq) if seq == n - 1 else (None, None)
            rows.append((f"s{stream}", seq, None if seq % 4 == 3 else f"t{seq} ", *usage, seq == n - 1))
    random.shuffle(rows)
    frame = spark.createDataFrame(
        rows, "stream_id string, seq bigint, text string, prompt_tokens bigint, output_tokens bigint, is_last boolean")
    live_rows = queries._drain(tl.fold_chunk_stream(files(spark, frame, str(tmp_path / "in"), 6)), "chunks")
    assert sorted(map(tuple, live_rows.collect())) == sorted(map(tuple, tl.fold_chunks(frame).collect()))


def test_ingest_stream(spark, tmp_path):
    frame = spark.createDataFrame(
        [(f"u{i}", "openai", "o4-mini", i, 5) for i in range(40)] + [(None, "openai", "o4-mini", 1, 1), ("neg", "x", "y", -1, 0)],
        "id string, provider string, model string, input_tokens bigint, output_tokens bigint")
    target = str(tmp_path / "tables")
    stream = files(spark, frame, str(tmp_path / "in"), 4)
    tl.stream_ingest(stream, target, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    stored = live.read_batches(spark, target, "usage_data")
    expected = tl.ingest_usage(frame.where("input_tokens >= 0 and id is not null"))["usage_data"]
    columns = ["id", "type", "total_tokens", "total_cost"]
    assert sorted(map(tuple, stored.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    letters = live.dead_letters(spark, target)
    assert letters.count() == 2 and "record has no id" in letters.first().error


def test_failed_table_is_kept(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([("u1", "openai", "o4-mini", 1, 1)], "id string, provider string, model string, input_tokens bigint, output_tokens bigint")
    real = live.ingest_usage

    def broken(df, cfg, prices):
        tables = real(df, cfg, prices)
        tables["prompt_variables"] = df.select(F.raise_error(F.lit("boom")).alias("x"))
        return tables

    monkeypatch.setattr(live, "ingest_usage", broken)
    target = str(tmp_path / "tables")
    tl.stream_ingest(files(spark, frame, str(tmp_path / "in"), 1), target, str(tmp_path / "cp"), once=True).awaitTermination()
    # No table of the batch counts; the record is a letter, and a replay stores it whole.
    assert live.read_batches(spark, target, "usage_data").count() == 0
    letters = live.dead_letters(spark, target).collect()
    assert len(letters) == 1 and "boom" in letters[0].error and letters[0].part == "write" and '"u1"' in letters[0].record
    monkeypatch.setattr(live, "ingest_usage", real)
    for _ in range(2):
        assert live.replay_letters(spark, target, frame.schema).count() == 0
        assert [r.id for r in live.read_batches(spark, target, "usage_data").collect()] == ["u1"]


def test_cache_stream(spark, sf_dir, tmp_path):
    """Batches in time order give what one replay gives."""
    calls = views.event_calls(views.table(spark, sf_dir, "events"), bypass=False).orderBy("timestamp")
    source = str(tmp_path / "in")
    for i, day in enumerate(("2024-01-05", "2024-01-12", "2024-01-20", "2030-01-01")):
        low = ("2000-01-01", "2024-01-05", "2024-01-12", "2024-01-20")[i]
        calls.where(f"timestamp >= timestamp'{low}' and timestamp < timestamp'{day}'").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    target = str(tmp_path / "out")
    tl.stream_cache(stream, target, f"{target}/cp", once=True, buckets=8, compact_after=2).awaitTermination()
    got = live.read_calls(spark, target).select("id", "cached_usage_id")
    expected = tl.find_hits(calls).select("id", "cached_usage_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert commits.load(spark, target).batches("cache") <= 3
    assert commits.read(spark, target, "cache", live.CACHE_ROW).count() == calls.where("response_content <> ''").select("prompt_hash").distinct().count()


def test_heartbeats_over_batches(spark, tmp_path):
    rows = [(f"r{i % 3}", f"v{i:02d}", float(i) / 20, ["on_track", "failed", "looping"][i % 7 % 3]) for i in range(20)]
    frame = spark.createDataFrame(rows, "request_id string, id string, confidence double, status string").withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1704067200) + F.substring("id", 2, 2).cast("int") * 60))
    source = str(tmp_path / "in")
    for low in (0, 8, 14):
        high = {0: 8, 8: 14, 14: 20}[low]
        n = F.substring("id", 2, 2).cast("int")
        frame.where((n >= low) & (n < high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = queries._drain(tl.heartbeat_state(stream), "beats")
    expected = tl.with_previous_status(frame)
    pick = ["id", "previous_status"]
    assert sorted(map(tuple, got.select(pick).fillna("").collect())) == sorted(map(tuple, expected.select(pick).fillna("").collect()))
    assert {r.id for r in got.where("stop").collect()} == {
        r[1] for r in rows if r[3] == "looping" or (r[3] == "failed" and r[2] > 0.7)}


class Cluster:
    """A session as a cluster would give it, with or without a shared folder."""

    def __init__(self, folder, master="spark://somewhere"):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.folder = folder

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_the_clusters(spark):
    assert new_path(Cluster("hdfs:///shared/"), "x").startswith("hdfs:///shared/tokenledger/x-")
    with pytest.raises(RuntimeError):
        shared_dir(Cluster(None))
    assert shared_dir(spark)


def test_chunks_sent_again_count_once(spark, tmp_path):
    kind = "stream_id string, seq int, text string, prompt_tokens int, output_tokens int, is_last boolean"
    batches = [
        [("r", 0, "A", 0, 0, False), ("r", 2, "C", 3, 4, True)],
        [("r", 0, "A", 0, 0, False), ("s", 0, "x", 1, 1, True)],
        [("r", 1, "B", 0, 0, False), ("r", 1, "B", 0, 0, False)],
        [("r", 1, "B", 0, 0, False), ("s", 0, "x", 1, 1, True)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    chunking_out = chunks.fold_chunk_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    chunking_out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    streamed = sorted((r.stream_id, r.response_content, r.chunks, r.input_tokens, r.complete) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    whole = spark.createDataFrame([r for b in batches for r in b], kind)
    batch = sorted((r.stream_id, r.response_content, r.chunks, r.input_tokens, r.complete) for r in chunks.fold_chunks(whole).collect())
    assert streamed == batch == [("r", "ABC", 3, 3, True), ("s", "x", 1, 1, True)]


def test_manifest_ranges():
    manifest = commits.Manifest()
    for batch in (3, 1, 2, 7, -1, 3):
        manifest.add("t", batch)
    assert manifest.tables["t"] == [[-1, -1], [1, 3], [7, 7]] and manifest.batches("t") == 5
    assert manifest.holds("t", 2) and not manifest.holds("t", 4) and not manifest.holds("u", 1)
    manifest.add("t", 9, snapshot=True)
    assert manifest.tables["t"] == [[9, 9]]


def test_unpublished_batches_are_not_read(spark, tmp_path):
    target = str(tmp_path / "t")
    for batch in range(3):
        commits.write(spark.range(batch, batch + 1), target, "rows", batch)
    assert commits.read(spark, target, "rows", "id bigint").count() == 0
    commits.publish(spark, target, lambda m: m.add("rows", 1))
    assert [r.id for r in commits.read(spark, target, "rows", "id bigint").collect()] == [1]
    for _ in range(commits.KEPT + 3):
        commits.publish(spark, target, lambda m: m.add("rows", 2))
    assert sorted(r.id for r in commits.read(spark, target, "rows", "id bigint").collect()) == [1, 2]
    assert len(list((tmp_path / "t" / commits.FOLDER).glob("*.json"))) == commits.KEPT
    plan = commits.read(spark, target, "rows", "id bigint")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "batch_id" in plan.split("PartitionFilters:")[1][:120]


def test_a_second_writer_loses_nothing(spark, tmp_path, monkeypatch):
    target, first, real = str(tmp_path), [], commits.load

    def slow(session, path):
        manifest = real(session, path)
        if not first:  # another writer publishes between reading and writing
            first.append(True)
            commits.publish(session, path, lambda m: m.add("rows", 5))
        return manifest

    monkeypatch.setattr(commits, "load", slow)
    commits.publish(spark, target, lambda m: m.add("rows", 1))
    assert real(spark, target).tables["rows"] == [[1, 1], [5, 5]]


def test_totals_and_late_rows_are_all_rows(spark, sf_dir, tmp_path):
    """In any order of arrival, with snapshots in between and a batch that runs again."""
    usage = views.usage(spark, sf_dir)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(5):
        usage.where(F.pmod(F.xxhash64("id"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.stream_totals(stream, target, str(tmp_path / "cp"), once=True, compact_after=2).awaitTermination()
    late = live.read_late(spark, target, usage.schema)
    assert 0 < late.count() < usage.count()
    all_ = live._added(live.read_totals(spark, target, live.live_stats(usage).schema).unionByName(live.live_stats(late)))
    def shape(rows):
        found = sorted(rows.select("window_start", "org_id", "provider", "model", "total_tokens", "cache_saved_tokens", "compression_saved_tokens", "total_requests", "total_cache_hits", "total_cost").collect())
        return [tuple(r)[:-1] for r in found], [r.total_cost for r in found]

    def same(rows):
        (keys, costs), (expected, expected_costs) = shape(rows), shape(live.live_stats(usage))
        assert keys == expected and costs == pytest.approx(expected_costs)

    same(all_)
    assert commits.load(spark, target).batches("totals") <= 3
    again = live.stream_totals(stream, target, str(tmp_path / "cp-lost"), once=True)  # its place in the stream is lost
    again.awaitTermination()
    same(live._added(live.read_totals(spark, target, live.live_stats(usage).schema).unionByName(live.live_stats(live.read_late(spark, target, usage.schema)))))
