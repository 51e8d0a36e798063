"""URL filters: a blocked Bloom filter before an exact hash join.

A list holds canonical URLs, each a host and the start of a path, with a verdict. An entry fits its host and all hosts below
it, if the path starts with the entry's; of several, the one of longest host wins, then the one of longest path, which is
the longest as a whole. URLs that no entry fits get the default verdict.

A URL asks for all that could fit it: its host and the hosts above it, each with the starts of its path whose length
occurs in the list. The filter holds the hash of each listed host and of each listed host with path. Its blocks are eight
64-bit lanes and a key sets one bit in each, so a question touches one block. Hosts are asked first, and only hosts that
pass ask for their paths. What passes goes to a hash join with the list itself, which removes false positives; all other
rows bypass the join. The filter takes ``BITS`` bits a key and at most ``MOST_BYTES``, whatever the list's size: beyond
that more false positives reach the join and the result stays the same. Its segments are made by tasks.

Edge cases: a null URL, or one without ``://``, has an empty host and path, and no entry fits it. An entry without a host
is none; one without a path has an empty one; of entries listed twice, ``block`` (the greatest verdict) counts. Rows with
null or repeated ids, and repeated URLs, are judged each. Very long hosts ask for no more hosts than the list's deepest has
labels. An empty list gives all rows the default; an empty table gives an empty table. ``keep`` names the columns that are
returned; with ``None`` they all are, in one struct ``input_row``, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.tables import packed, stage

BITS = 16
MOST_BYTES = 32 << 20
#: Blocks of 64 bytes whose bits one task sets together.
SEGMENT = 1 << 14

_LANES = np.random.default_rng(13).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIST = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def entries(listed: DataFrame) -> DataFrame:
    """The list in canonical form, each entry once."""
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    rows = listed.select(host.alias("host"), path.alias("path"), F.col("verdict").cast("string").alias("verdict")).filter("host <> ''")
    return rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


class Filter:
    """A blocked Bloom filter over 64-bit hashes."""

    def __init__(self, blocks: int, lanes: np.ndarray | None = None):
        self.lanes = np.zeros((blocks, 8), np.uint64) if lanes is None else lanes

    @staticmethod
    def block(hashes: np.ndarray, blocks: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        """The bit of each lane, from the hash's lower half."""
        mixed = (hashes & np.uint64(0xFFFFFFFF))[:, None] * _LANES
        return np.uint64(1) << (mixed >> np.uint64(58))

    def add(self, hashes: np.ndarray, blocks: np.ndarray | None = None) -> None:
        at = self.block(hashes, len(self.lanes)) if blocks is None else blocks
        np.bitwise_or.at(self.lanes, at, self.bits(hashes))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lanes):
            return np.zeros(len(hashes), bool)
        bits = self.bits(hashes)
        return ((self.lanes[self.block(hashes, len(self.lanes))] & bits) == bits).all(axis=1)


def build(hashes: DataFrame, bits: int = BITS, most_bytes: int = MOST_BYTES) -> Filter:
    """The filter of a table ``(hash long)``. Only its bits, at most ``most_bytes``, reach the driver."""
    keys = hashes.count()
    blocks = max(1, min(most_bytes // 64, -(-keys * bits // 512)))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_pydict({"segment": pa.array((Filter.block(own, blocks) // SEGMENT).astype(np.int32)), "hash": batch.column("hash")})

    def filled(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        part = Filter(min(SEGMENT, blocks - segment * SEGMENT))
        for chunk in table.column("hash").chunks:
            own = chunk.to_numpy(zero_copy_only=False).view(np.uint64)
            part.add(own, Filter.block(own, blocks) - segment * SEGMENT)
        return pa.table({"segment": pa.array([segment], pa.int32()), "lanes": pa.array([part.lanes.tobytes()], pa.binary())})

    made = hashes.distinct().mapInArrow(located, "segment int, hash long").groupBy("segment").applyInArrow(filled, "segment int, lanes binary")
    out = Filter(blocks if keys else 0)
    for row in made.toLocalIterator():
        lanes = np.frombuffer(row["lanes"], np.uint64).reshape(-1, 8)
        out.lanes[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(lanes)] = lanes
    return out


def _passing(df: DataFrame, name: str, sent) -> DataFrame:
    """``df`` with the places (from 0) of those hashes in the list column ``name`` that the filter holds, in its stead."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            lists = batch.column(at)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
            held = np.flatnonzero(sent.value.holds(values))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[held], minlength=len(counts)))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array((held - first[row[held]]).astype(np.int32)))
            columns = [places if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {'array<int>' if f.name == name else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(asked, kinds)


def judge(pages: DataFrame, listed: DataFrame, keep: list[str] | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` and ``host, path, rule, verdict``: ``rule`` is the entry that decided, or null."""
    known = stage(entries(listed), "urls-listed")
    sizes = known.agg(F.max(F.size(F.split("host", "\\."))), F.sort_array(F.collect_set(F.length("path")))).first()
    depth, lengths = sizes[0] or 0, sizes[1]
    keys = known.select(F.xxhash64("host").alias("hash")).union(known.select(F.xxhash64("host", "path").alias("hash")))
    sent = pages.sparkSession.sparkContext.broadcast(build(keys))

    own = [pages[f"`{c}`"] for c in keep] if keep is not None else None
    source = packed(pages, host_of(pages[f"`{url}`"]).alias("_host"), path_of(pages[f"`{url}`"]).alias("_path")) if own is None else pages.select(F.struct(*own).alias("input_row"), host_of(pages[f"`{url}`"]).alias("_host"), path_of(pages[f"`{url}`"]).alias("_path"))
    labels = F.split("_host", "\\.")
    above = F.expr(f"transform(sequence(1, least(size(labels), {max(depth, 1)})), n -> concat_ws('.', slice(labels, size(labels) - n + 1, n)))")
    named = source.withColumn("labels", labels).withColumn("hosts", F.when(F.col("_host") != "", above).otherwise(F.array().cast("array<string>")))
    asked = _passing(named.select("input_row", "_host", "_path", "hosts", F.transform("hosts", lambda h: F.xxhash64(h)).alias("places")), "places", sent)
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    pairs = F.flatten(F.transform("places", lambda i: F.transform(starts, lambda n: F.struct(F.get("hosts", i).alias("host"), F.substring(F.col("_path"), F.lit(1), n).alias("path")))))
    paired = asked.select("input_row", "_host", "_path", pairs.alias("pairs"))
    hit = _passing(paired.select("*", F.transform("pairs", lambda p: F.xxhash64(p["host"], p["path"])).alias("places")), "places", sent)
    passed = stage(hit.select("input_row", "_host", "_path", F.transform("places", lambda i: F.get("pairs", i)).alias("pairs")), "urls-asked")

    rows = passed.filter(F.size("pairs") > 0)
    wanted = rows.groupBy("_host", "_path").agg(F.first("pairs").alias("pairs")).select("_host", "_path", F.explode("pairs").alias("pair"))
    exact = wanted.join(known, (wanted["pair.host"] == known["host"]) & (wanted["pair.path"] == known["path"]))
    rank = F.struct(F.length("host"), F.length("path"))
    best = stage(exact.groupBy(F.col("_host").alias("of_host"), F.col("_path").alias("of_path")).agg(F.max_by(F.struct("host", "path", "verdict"), rank).alias("rule")), "urls-decided")
    # Both sides are stored, so that adaptive execution can split a URL given very often.
    decided = rows.join(best, (rows["_host"] == best["of_host"]) & (rows["_path"] == best["of_path"]), "left").select("input_row", "_host", "_path", "rule")
    free = passed.filter(F.size("pairs") == 0).withColumn("rule", F.lit(None).cast("struct<host:string,path:string,verdict:string>")).drop("pairs")
    verdicts = decided.unionByName(free)
    facts = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict")]
    return verdicts.select(*(["input_row"] if keep is None else [F.col(f"input_row.`{c}`").alias(c) for c in keep]), *facts)
