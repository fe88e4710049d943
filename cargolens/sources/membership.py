"""Blocked Bloom filters over stored keys (STR5, STR6, SRC3): new keys, the usual case, never meet the ledger.

A filter row holds 32,768 bits and stands for at most about 3,200 keys of one bucket, so a filter
takes 10 to 20 bits a key, some ten times less than the keys. A key asks seven bits of one
row. A filter never denies a stored key; about one new key in a hundred passes it by chance, and
what passes is left to an exact join. Null is a key like any other.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS = 32_768  # bits of one bitmap_construct_agg
KEY_BITS = 10
PROBES = 7
FILTER = "bucket int, blocks int, block bigint, bits binary"


def blocks_for(keys: int) -> int:
    """Rows of a filter for so many keys: a power of two, so that filters of all sizes share few numbers."""
    least = max(1, -(-keys * KEY_BITS // BLOCK_BITS))
    return 1 << (least - 1).bit_length()


def _block(key: str, blocks: Column) -> Column:
    # The lowest bits chose the bucket.
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 16), blocks)


def _probes(key: str) -> list[Column]:
    """Bit positions by double hashing, from a hash of its own."""
    h = F.xxhash64(F.lit("probe"), key)
    first, stride = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
    return [F.pmod(first + stride * i, F.lit(BLOCK_BITS)) for i in range(PROBES)]


def build(keys: DataFrame, key: str, rows: dict[int, int]) -> DataFrame:
    """A filter (:data:`FILTER`) over the keys of ``keys(bucket, key)``; ``rows`` bounds the rows per bucket.

    Only hashes shuffle, to their block; a block's bits are set in one place, so a partial bit
    map never travels. Keys that repeat are first combined.
    """
    sizes = F.create_map(*[F.lit(x) for b, n in rows.items() for x in (b, blocks_for(n))])
    marked = keys.select("bucket", key).distinct().withColumn("blocks", F.element_at(sizes, F.col("bucket")))
    dealt = marked.select("bucket", "blocks", _block(key, F.col("blocks")).alias("block"), F.array(*_probes(key)).alias("at"))
    dealt = dealt.repartition("bucket", "blocks", "block").withColumn("at", F.explode("at"))
    return dealt.groupBy("bucket", "blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits"))


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(bits.substr(F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def may_hold(asked: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """The rows of ``asked(bucket, key, ...)`` whose key one of several filters may hold, once each.

    ``filters`` are the rows of any number of filters. Rows meet them by (bucket, block), once per size
    that occurs; sizes are powers of two, so there are at most some thirty, and they are what the
    driver sees.
    """
    sizes = sorted(r["blocks"] for r in filters.select("blocks").distinct().collect())
    if not sizes:
        return asked.limit(0)
    at = asked.withColumn("blocks", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("block", _block(key, F.col("blocks")))
    passed = at.join(filters, ["bucket", "blocks", "block"]).where(reduce(Column.__and__, [_is_set(F.col("bits"), p) for p in _probes(key)]))
    return passed.select(*asked.columns).distinct()
