"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

A key is hashed to 64 bits, and a linear congruential sequence from it decides at which shard counts the key jumps; the
last jump below the shard count is its shard. Appending a shard moves a key only if its next jump lands on the new shard,
so 1 row in n+1 moves and all of them into it. The arithmetic modulo 2^64 is done on limbs of 21, 21 and 22 bits, as
built-in expressions, since 64-bit products overflow under ANSI rules.

Slots number the rows of a shard without gaps, in the order of id, checksum and size, without bringing a shard together:
rows are dealt by ranges of the id, counted per range and shard, and numbered within ranges behind the sum of the ranges
before. Identical rows are aggregated before and expanded after.

Defined results: null texts have no bytes and checksum 0; a null id is one key of its own and comes first in the order;
repeated ids share a shard. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stage_table, text_of

# The multiplier of the published jump consistent hash, in limbs of 21, 21 and 22 bits from the lowest.
MULTIPLIER = 2862933555777941757
_LIMBS = (MULTIPLIER & 0x1FFFFF, MULTIPLIER >> 21 & 0x1FFFFF, MULTIPLIER >> 42)

#: Steps that nearly all keys need at most, whatever the number of shards.
JUMPS = 64


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key (a long column)."""
    c0, c1, c2 = (F.lit(c).cast("long") for c in _LIMBS)
    m21, m22 = F.lit(0x1FFFFF).cast("long"), F.lit(0x3FFFFF).cast("long")
    zero = F.lit(0).cast("long")

    def state(b: Column, j: Column, k0: Column, k1: Column, k2: Column) -> Column:
        return F.struct(b.alias("b"), j.alias("j"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))

    def step(s: Column, _: Column) -> Column:
        t0 = s.k0 * c0 + 1
        t1 = s.k0 * c1 + s.k1 * c0 + F.shiftrightunsigned(t0, 21)
        t2 = s.k0 * c2 + s.k1 * c1 + s.k2 * c0 + F.shiftrightunsigned(t1, 21) + F.shiftleft((s.k1 * c2 + s.k2 * c1).bitwiseAND(F.lit(1).cast("long")), 21)
        k1, k2 = t1.bitwiseAND(m21), t2.bitwiseAND(m22)
        high = F.shiftleft(k2, 9).bitwiseOR(F.shiftrightunsigned(k1, 12))  # the upper 31 bits
        jump = F.floor((s.j + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double")))
        return F.when(s.j < shards, state(s.j, jump, t0.bitwiseAND(m21), k1, k2)).otherwise(s)

    first = state(F.lit(-1).cast("long"), zero, key.bitwiseAND(m21), F.shiftrightunsigned(key, 21).bitwiseAND(m21), F.shiftrightunsigned(key, 42).bitwiseAND(m22))
    # A key jumps some ln(shards) times; the few that jump more than JUMPS times go through all counts.
    soon = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, JUMPS))), first, step)
    whole = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, step, lambda x: x.b)
    return let(soon, lambda s: F.when(s.j >= shards, s.b).otherwise(whole(s))).cast("int")


def stable_key(id_col: str) -> Column:
    """Mixes an id, so that neighbouring ids are independent; null is a key of its own."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the law is `key`."""
    text = text_of(text_col)
    key = stable_key("doc_id")
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("*", jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"))
    )
    rows = stage_table(rows, "shard-rows")
    dealt = stage_table(rows.repartitionByRange("doc_id", "text_crc32", "size").withColumn("range", F.spark_partition_id()), "shard-ranges")
    counted = dealt.groupBy("range", "shard").agg(F.sum("copies").alias("n"))
    # As many rows as there are ranges and shards.
    before = counted.select("range", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    order = Window.partitionBy("range", "shard").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum("copies").over(order) - F.col("copies")
    numbered = dealt.select("*", first.alias("first")).join(before, ["range", "shard"])
    return numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("first") + F.col("k")).alias("slot"), "grown_shard"
    )
