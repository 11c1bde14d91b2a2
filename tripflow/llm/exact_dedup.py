"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Levels 1 and 2 run on a narrow table (byte length, hash of the first ``prefix`` characters). Only rows whose length and
prefix occur again are hashed in full; they are picked inside the scan by a sieve of fixed size, so no text is shuffled.
All main-path work is SQL functions. Hot groups are counted map-side, and rows meet their group's row by a join that
AQE can split.

Defined results: a null text counts as empty, and all empty texts are equal. Of equal texts the row with the largest id
stays; rows that repeat that id with the same text all stay (they are one document). Null ids lose against any other; in
a group that has only null ids all rows stay. An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm import sieve
from tripflow.llm.text import ascii_lower, or_empty
from tripflow.session import durable

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS,
                digest_col: str | None = None) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``.

    With ``digest_col`` every row also gets the SHA-256 of its normalised text, which the caller wants for rows that
    need no full hash for the grouping.
    """
    text = or_empty(F.col(text_col))
    head = F.xxhash64(ascii_lower(F.substring(text, 1, prefix)))

    narrow = durable(docs.select(F.octet_length(text).alias("n_bytes"), head.alias("head")), "dedup-keys")
    lengths = narrow.groupBy("n_bytes").count().filter("count > 1")
    shared_length = sieve.mark(narrow, sieve.build(lengths, "n_bytes"), "hit", F.col("n_bytes")).filter("hit")
    heads = shared_length.groupBy("n_bytes", "head").count().filter("count > 1")

    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    key = [F.octet_length("__text"), F.xxhash64(ascii_lower(F.substring("__text", 1, prefix)))]
    rows = sieve.mark(rows, sieve.build(heads, "n_bytes", "head"), "hit", *key)
    own = F.sha2(F.encode(ascii_lower(F.col("__text")), "UTF-8"), 256)
    if digest_col:
        rows = rows.select("__id", "hit", own.alias("__digest"))
        rows = durable(rows.select("__id", "__digest", F.when(F.col("hit"), F.col("__digest")).alias("__full")), "dedup-rows")
    else:
        rows = durable(rows.select("__id", F.lit(None).cast("string").alias("__digest"), F.when(F.col("hit"), own).alias("__full")), "dedup-rows")

    groups = (rows.filter("__full IS NOT NULL").groupBy("__full")
              .agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    groups = durable(groups, "dedup-groups")  # a table of its own, so that AQE can split a hot group in the join
    again = rows.filter("__full IS NOT NULL").join(groups, "__full").select("__id", "__digest", "keep_id", "group_size")
    alone = rows.filter("__full IS NULL").select("__id", "__digest", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = again.unionByName(alone).withColumn("kept", F.col("__id").eqNullSafe(F.col("keep_id")))
    cols = [F.col("__id").alias(id_col), "keep_id", "group_size", "kept"]
    return out.select(*cols, *([F.col("__digest").alias(digest_col)] if digest_col else []))
