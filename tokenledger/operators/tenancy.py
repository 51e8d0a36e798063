"""Which organisation a record belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config

KEY_REQUIRED = "API key required"
KEY_INVALID = "Invalid API key"


def hash_keys(api_keys: DataFrame) -> DataFrame:
    """Replace plain keys by their SHA-256."""
    return api_keys.withColumn("key_hash", F.sha2("key_hash", 256))


def attach_org(
    records: DataFrame, api_keys: DataFrame, cfg: Config = Config(), hashed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Set ``org_id`` from the record's ``api_key``; returns accepted rows and rejects with a reason.

    A missing or unknown key belongs to the default organisation, or is refused in managed mode. ``hashed``: the key
    table holds SHA-256 values.
    """
    key = F.when(F.coalesce("api_key", F.lit("")) != "", F.col("api_key"))
    probe = F.sha2(key, 256) if hashed else key
    known = api_keys.select(F.col("key_hash").alias("_key"), F.col("org_id").alias("_org"))
    base = records.drop("org_id").withColumn("_probe", probe)
    joined = base.join(known, F.col("_probe") == F.col("_key"), "left")
    if not cfg.managed:
        accepted = joined.withColumn("org_id", F.coalesce("_org", F.lit(cfg.default_org)))
        return accepted.drop("_probe", "_key", "_org"), joined.where("false").withColumn(
            "reason", F.lit(KEY_INVALID)
        ).drop("_probe", "_key", "_org")
    reason = F.when(F.col("_probe").isNull(), F.lit(KEY_REQUIRED)).otherwise(F.lit(KEY_INVALID))
    return (
        joined.where("_org is not null").withColumn("org_id", F.col("_org")).drop("_probe", "_key", "_org"),
        joined.where("_org is null").withColumn("reason", reason).drop("_probe", "_key", "_org"),
    )
