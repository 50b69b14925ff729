"""Operator 10: shards by jump consistent hashing, DataFrame expressions only.

The key's 64-bit linear congruential steps are done on 32- and 16-bit limbs, since Spark's ANSI
arithmetic refuses to wrap. A row's shard depends on its key and the number of shards alone, and with
one shard more a row either stays or moves into the new one.

Null keys: shard 0, also in the grown layout. Empty tables give empty results. Equal keys share a
shard; their slots follow from the other ordering columns, equal rows being interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import table

#: The multiplier of the published hash, as its upper 32, middle 16 and lower 16 bits.
_HIGH, _MIDDLE, _LOW = 0x27BB2EE6, 0x87B0, 0xB0FD
_M32, _M16 = 0xFFFFFFFF, 0xFFFF


def _advanced(high: Column, low: Column) -> tuple[Column, Column]:
    """(key * multiplier + 1) mod 2^64 of a key given as two 32-bit halves."""
    x = low * _LOW + F.lit(1)
    y = low * _MIDDLE
    z = x + F.shiftleft(y.bitwiseAND(_M16), 16)
    carry = F.shiftright(z, 32) + F.shiftright(y, 16)
    upper = low * F.lit(_HIGH) % F.lit(1 << 32) + high * _LOW + F.shiftleft((high * _MIDDLE).bitwiseAND(_M16), 16)
    return (carry + upper).bitwiseAND(_M32), z.bitwiseAND(_M32)


def jump_shards(key: Column, n: int) -> Column:
    """Struct (shard, grown): the shard of ``key`` among n and among n + 1 shards."""
    key = F.coalesce(key.cast("long"), F.lit(0))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_M32).alias("low"), F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _advanced(s["high"], s["low"])
        leap = F.floor((s["at"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        shard = F.when(leap < n, leap).otherwise(s["shard"])
        grown = F.when(leap < n + 1, leap).otherwise(s["grown"])
        moved = F.struct(high.alias("high"), low.alias("low"), leap.alias("at"), shard.alias("shard"), grown.alias("grown"))
        return F.when(s["at"] > n, s).otherwise(moved)

    # Each leap goes at least one shard further, so n + 1 leaps always pass the end.
    return F.aggregate(F.sequence(F.lit(1), F.lit(n + 1)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard(df: DataFrame, key: str, n: int, order: list[str], bins: int = 1024) -> DataFrame:
    """Adds shard, grown_shard and slot (gapless from 0 in each shard).

    Slots are counted in ``bins`` parts of each shard, dealt by a hash of the key, so no task sorts a
    whole shard; only the n * bins counts are summed in order.
    """
    bin_ = F.pmod(F.xxhash64(F.col(key)), F.lit(bins)).cast("int")
    placed = df.withColumn("__at", jump_shards(F.col(key), n)).withColumns({"shard": F.col("__at.shard"), "grown_shard": F.col("__at.grown"), "__bin": bin_}).drop("__at")
    parts = placed.groupBy("shard", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__bin").orderBy(*order)
    placed = placed.withColumn("__i", F.row_number().over(within))
    return placed.join(parts, ["shard", "__bin"]).withColumn("slot", (F.col("__before") + F.col("__i") - 1).cast("long")).drop("__bin", "__before", "__i")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by doc_id; law ``key``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return shard(docs, "doc_id", 16, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
