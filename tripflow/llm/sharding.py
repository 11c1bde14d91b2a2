"""Shards whose source mixture matches the corpus: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; rank r of n gets the fraction (r - 1/2) / n. Sorted by
that fraction the sources interleave in proportion, so equal cuts give shards of equal row count (at most one apart) in
which every source has its share up to rounding.

No source is ranked in one task: a rank is the count of the buckets before it (a small table) plus the place within a
bucket. There are at least ``MIN_BUCKETS`` buckets per source, more when a bucket would pass ``BUCKET_ROWS`` rows; the
number only spreads work and does not change the result.

Defined results: a null source is a source of its own; a null text has size and checksum of the empty text; rows with
equal ids are ordered by checksum and size, and full copies are interchangeable. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.text import or_empty
from tripflow.session import durable

MIN_BUCKETS, BUCKET_ROWS, OVERHEAD = 1024, 20_000, 16


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each bucket (column ``before``) and in all buckets (``total``) of its group."""
    w = Window.partitionBy(*by)
    before = F.sum("count").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    return counts.select(*by, "bucket", before.alias("before"), F.sum("count").over(w).alias("total"))


def interleaved(docs: DataFrame, n_shards: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                seed: int = 17) -> DataFrame:
    """``id``, ``size`` (UTF-8 bytes and the row's overhead), ``text_crc32``, ``shard``, ``slot`` (from 0 in each shard)."""
    text = or_empty(F.col(text_col))
    rows = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
                               F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("order")), "shard-rows")
    n = rows.count()
    buckets = 1 << max(MIN_BUCKETS.bit_length() - 1, (n // BUCKET_ROWS).bit_length())
    ties = ["id", "text_crc32", "size"]

    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 64 - (buckets.bit_length() - 1)))
    sums = _offsets(rows.groupBy("source", "bucket").count(), ["source"]).withColumnsRenamed({"source": "s", "bucket": "b"})
    in_bucket = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("order", 1), F.col("order").bitwiseAND(1), *ties)
    rank = F.row_number().over(in_bucket) + F.col("before")
    ranked = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("part", (2 * rank - 1) / (2.0 * F.col("total"))).select(*ties, "source", "order", "part")

    ranked = durable(ranked.withColumn("bucket", F.floor(F.col("part") * buckets)), "shard-parts")
    sums = _offsets(ranked.groupBy("bucket").count().withColumn("all", F.lit(0)), ["all"]).select(F.col("bucket").alias("b"), "before")
    in_bucket = Window.partitionBy("bucket").orderBy("part", "source", "order", *ties)
    pos = F.row_number().over(in_bucket) + F.col("before") - 1
    out = ranked.join(sums, F.col("bucket") == F.col("b")).withColumn("pos", pos)
    shard = F.expr(f"pos * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return out.withColumn("shard", shard).select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("pos") - first).alias("slot"), "source")
