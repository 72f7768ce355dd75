"""Weighted rendezvous hashing: a record's key and the shards' weights alone decide its shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import ranked


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least ``-ln(u) / weight``, u in (0, 1) from a hash of key and shard.

    A shard's draw doesn't depend on the others, so one shard more takes rows into itself
    only, and a share proportional to its weight. Ties go to the lower shard. Null keys hash
    as the empty string.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    name = F.coalesce(key.cast("string"), F.lit(""))
    shares = F.array(*[F.lit(float(w)) for w in weights])

    def draw(weight: Column, shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(name, shard.cast("int")), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / weight).alias("draw"), shard.cast("int").alias("shard"))

    return F.array_min(F.transform(shares, draw)).getField("shard")


def shard_records(df: DataFrame, key: str, weights: Sequence[float], tie: Sequence[str] = (), out: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds each row's shard and its slot there, 0, 1, 2, ... without gaps.

    No row's data moves but what ``df`` holds: select the columns that you need first.
    Repeated keys share a shard and take a slot each; an empty table gives no rows.
    """
    return ranked(df.withColumn(out, rendezvous_shard(F.col(key), weights)), [out], [key, *tie], slot)
