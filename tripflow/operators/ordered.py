"""Ordered operators that never need a whole trip in one task.

A trip may hold a large share of the fleet's rows, so nothing here opens a window over a whole
trip of samples.  Rows are grouped by (trip, time block); what has to cross a block border comes
from a table with one row per block, small enough to be ordered per trip.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_block"


@dataclass(frozen=True)
class Series:
    """Key, clock and block length of an ordered table.

    ``tie`` breaks equal clock values; leave it empty where the clock is unique per key, which
    keeps the block table in hash aggregation.
    """

    keys: tuple[str, ...] = ("trip",)
    time: str = "time_s"
    tie: tuple[str, ...] = ()
    block_s: float = 3600.0
    block: Column | None = None      # any function of the clock that keeps its order

    def with_block(self, df: DataFrame) -> DataFrame:
        if self.block is not None:
            return df.withColumn(BLOCK, self.block)
        block = F.floor(F.col(self.time).cast("double") / F.lit(float(self.block_s)))
        return df.withColumn(BLOCK, F.coalesce(block, F.lit(-(2 ** 62))))

    def fitted(self, df: DataFrame, rows: int = 1_000_000, hottest: int = 1000) -> Series:
        """Shorter blocks where ``block_s`` would hold more than ``rows`` rows on average.

        One map-side aggregate over key and clock finds the dense keys.  Those that need the
        shortest blocks get their own length; if there are more than ``hottest``, all others share
        the shortest length any of them needs.  At most ``hottest + 1`` keys reach the driver.
        """
        (key,) = self.keys
        t = F.col(self.time).cast("double")
        reach = F.least(F.lit(self.block_s), F.col("_span"))
        share = reach / F.nullif(F.col("_span"), F.lit(0.0))
        dense = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), (F.max(t) - F.min(t)).alias("_span"))
                 .withColumn("_rows", F.col("_n") * share).filter((F.col("_rows") > rows) & (reach > 0))
                 .withColumn("_length", reach * rows / F.col("_rows"))
                 .orderBy("_length", key).limit(hottest + 1).collect())
        if not dense:
            return self
        common = self.block_s if len(dense) <= hottest else dense[-1]["_length"]
        own = [F.lit(v) for r in dense[:hottest] for v in (r[key], r["_length"])]
        length = F.coalesce(F.try_element_at(F.create_map(*own), F.col(key)), F.lit(common))
        return replace(self, block=F.coalesce(F.floor(t / length), F.lit(-(2 ** 62))))

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, BLOCK]

    def rank_by(self) -> Column:
        return F.struct(self.time, *self.tie) if self.tie else F.col(self.time)

    def inside(self):
        """Window over the rows of one block."""
        return Window.partitionBy(*self.block_keys).orderBy(self.time, *self.tie)

    def across(self):
        """Window over the blocks of one key, for the block table only."""
        return Window.partitionBy(*self.keys).orderBy(BLOCK)


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", by: list[str] | None = None,
           spread: int = 32) -> DataFrame:
    """Join rows to a table of one row per key without sending a hot key to one task.

    The table is repeated ``spread`` times and every row picks a copy by a hash of its own values,
    so a key is spread over that many tasks, and a later aggregate by key starts from partial
    results.  Where the table is small Spark broadcasts it and nothing is shuffled.
    """
    plain = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    salt = F.pmod(F.xxhash64(*(by or plain or [F.lit(0)])), F.lit(spread))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    return df.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def attach_counted(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """As :func:`attach`, with rows counted per key first: only keys of more than ``most`` rows have their row repeated.

    For tables with about as many rows as ``df``, which 32 copies would outgrow; at most one key per ``most`` rows reaches the driver.
    """
    counted = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("_of")).filter("_of > 1")
    found = counted.collect()
    if not found:
        return df.join(table, keys, how)
    hot = F.broadcast(df.sparkSession.createDataFrame(found, counted.schema))
    of = F.coalesce("_of", F.lit(1).cast("bigint"))
    plain = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    dealt = df.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*(plain or [F.lit(0)])), of)).drop("_of")
    copies = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), of - 1))).drop("_of")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def with_position(df: DataFrame, s: Series, out: str = "pos") -> DataFrame:
    """Zero-based row position inside each key: rows of earlier blocks plus rank in the block."""
    blocked = s.with_block(df)
    before = s.across().rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocked.groupBy(*s.block_keys).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (blocked.join(offsets, s.block_keys)
            .withColumn(out, F.col("_base") + F.row_number().over(s.inside()) - 1)
            .drop("_base", BLOCK))


def with_neighbours(df: DataFrame, s: Series, cols: list[str], prev: bool = True,
                    following: bool = True) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>``, the values of the adjacent rows of the same key."""
    blocked = s.with_block(df)
    ends = [agg(c, s.rank_by()).alias(f"_{tag}_{c}") for c in cols
            for tag, agg, on in (("last", F.max_by, prev), ("first", F.min_by, following)) if on]
    edges = blocked.groupBy(*s.block_keys).agg(*ends)
    picks = [F.lag(f"_last_{c}").over(s.across()).alias(f"_p_{c}") for c in cols if prev]
    picks += [F.lead(f"_first_{c}").over(s.across()).alias(f"_n_{c}") for c in cols if following]
    out = blocked.join(edges.select(*s.block_keys, *picks), s.block_keys)
    w, added = s.inside(), {}
    for c in cols:
        if prev:
            at_edge = F.lag(F.lit(1)).over(w).isNull()
            added[f"prev_{c}"] = F.when(at_edge, F.col(f"_p_{c}")).otherwise(F.lag(c).over(w))
        if following:
            at_edge = F.lead(F.lit(1)).over(w).isNull()
            added[f"next_{c}"] = F.when(at_edge, F.col(f"_n_{c}")).otherwise(F.lead(c).over(w))
    return out.withColumns(added).drop(BLOCK, *[f"_p_{c}" for c in cols], *[f"_n_{c}" for c in cols])


def with_last_valid(df: DataFrame, s: Series, value: str, out: str) -> DataFrame:
    """Latest present value at or before each row of the same key."""
    blocked = s.with_block(df)
    rank = F.when(F.col(value).isNotNull(), s.rank_by())
    ends = blocked.groupBy(*s.block_keys).agg(F.max_by(value, rank).alias("_v"))
    before = s.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*s.block_keys, F.last("_v", ignorenulls=True).over(before).alias("_carried"))
    here = F.last(value, ignorenulls=True).over(s.inside().rowsBetween(Window.unboundedPreceding, 0))
    return (blocked.join(carried, s.block_keys).withColumn(out, F.coalesce(here, "_carried"))
            .drop("_carried", BLOCK))


def with_halo(df: DataFrame, rows: int, before: int = 0, after: int = 0, pos: str = "pos",
              block: str = "_rows") -> DataFrame:
    """Cut positions into blocks of ``rows`` and lend each block its neighbours' border rows.

    ``_own`` marks the rows that belong to the block; the lent copies only feed window frames that
    reach ``before`` rows back or ``after`` rows ahead.  A block holds ``rows + before + after``
    rows at most, whatever the length of the trip.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - after) / rows))
    last = F.floor((F.col(pos) + before) / rows)
    return (df.withColumn(block, F.explode(F.sequence(first, last)))
            .withColumn("_own", F.floor(F.col(pos) / rows) == F.col(block)))


def first_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """First row of each key in the given order, by an aggregate rather than a ranked window."""
    picked = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep])


def gradient(df: DataFrame, s: Series, value: str, out: str) -> DataFrame:
    """Second-order slope on an uneven clock; one-sided at the two ends of a key."""
    near = with_neighbours(df, s, [value, s.time])
    back = F.col(s.time) - F.col(f"prev_{s.time}")
    ahead = F.col(f"next_{s.time}") - F.col(s.time)
    f, f0, f1 = F.col(value), F.col(f"prev_{value}"), F.col(f"next_{value}")
    slope_back, slope_ahead = (f - f0) / back, (f1 - f) / ahead
    inner = (slope_back * ahead + slope_ahead * back) / (back + ahead)
    return near.withColumn(
        out, F.when(back.isNull(), slope_ahead).when(ahead.isNull(), slope_back).otherwise(inner)
    ).drop(f"prev_{value}", f"next_{value}", f"prev_{s.time}", f"next_{s.time}")
