"""A membership filter of fixed size, built and asked with SQL functions only.

Keys are hashed to ``BITS`` bits, kept as rows of (bucket, 4 KiB bitmap): at most 2**BITS / 8 bytes whatever the number of
keys, so it can be broadcast. A hit may be wrong, a miss never is; an exact join follows wherever that matters. When keys
outnumber the bits the sieve only stops saving work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
PAGE = 15  # bits of one bitmap row, fixed by bitmap_construct_agg


def _slot(key: list[Column]) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << BITS) - 1))


def build(keys: DataFrame, *cols: str) -> DataFrame:
    """The sieve of the keys in ``cols``."""
    slot = keys.select(_slot([F.col(c) for c in cols]).alias("slot"))
    return (slot.groupBy(F.shiftright("slot", PAGE).alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << PAGE) - 1))).alias("__bitmap")))


def mark(df: DataFrame, sieve: DataFrame, name: str, *key: Column) -> DataFrame:
    """``df`` with a boolean column ``name``: False where the key is surely not in the sieve. Rows are not shuffled."""
    d = df.withColumn("__slot", _slot(list(key))).withColumn("__bucket", F.shiftright("__slot", PAGE))
    d = d.join(F.broadcast(sieve), "__bucket", "left")
    byte = F.expr(f"substring(__bitmap, (__slot & {(1 << PAGE) - 1}) div 8 + 1, 1)")
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(__slot & 7 as int))")) != 0
    return d.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__slot", "__bucket", "__bitmap")


def only(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``keys``; only rows that pass the sieve reach the join."""
    return mark(df, build(keys, col), "__hit", F.col(col)).filter("__hit").drop("__hit").join(keys, col, "left_semi")


def without(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is not in ``keys``; rows that miss the sieve need no join."""
    d = mark(df, build(keys, col), "__hit", F.col(col))
    rest = d.filter("__hit").join(keys, col, "left_anti").select(*d.columns)
    return d.filter("NOT __hit").unionByName(rest).drop("__hit")
