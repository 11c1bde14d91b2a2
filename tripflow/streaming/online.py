"""Streams of telemetry: resampling, duplicates, sessions, and guarded commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.operators import guards
from tripflow.operators.ordered import Series, attach_counted
from tripflow.session import scratch
from tripflow.streaming.keyed import KeyedState


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant; a zone-less clock is read as UTC seconds."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
        return df.withColumn(column, F.timestamp_micros(micros))
    return df


def resample(stream: DataFrame, period: str, values: list[str], keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Block means per key and clock block; a block is emitted once the watermark has passed it."""
    out = (stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, period).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]))
    return out.select(*keys, F.unix_micros("w.start").alias("start_us"), "n", *values)


def drop_duplicates(stream: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """First copy of each record; copies that arrive within the delay are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, gap: str, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Driving sessions by inactivity: a session ends when nothing arrives for ``gap``."""
    out = (stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w"))
           .agg(F.count(F.lit(1)).alias("n")))
    return out.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run over all data that is there, into a table of files written exactly once."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def for_each_batch(stream: DataFrame, name: str, work: Callable[[DataFrame, int, str], None], root: str | None = None) -> str:
    """Run ``work(batch, id, folder)`` on every micro-batch and return the folder; with the folder of an earlier run as
    ``root`` go on where that one ended."""
    root = root or scratch(stream.sparkSession, name)
    q = (stream.writeStream.foreachBatch(lambda df, i: work(df, i, root)).option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def late_rows(stream: DataFrame, delay_s: float, ts: str = "ts", name: str = "late", root: str | None = None) -> DataFrame:
    """Rows and late rows of every micro-batch: ``batch, rows, late, watermark_us``.

    A row is late if its event time is below the watermark its batch starts with, the newest event time of all earlier batches
    less the delay (NULL before any).  A row without an event time is never late.  The state is one row, kept per
    batch id, so a repeated batch counts the same again.
    """
    state = "batch long, rows long, late long, watermark_us long, newest_us long"

    def work(batch: DataFrame, i: int, folder: str) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(state).parquet(f"{folder}/out/part={i - 1}").first().newest_us if i > 0 else None
        mark = None if known is None else known - int(delay_s * 1e6)
        us = F.unix_micros(ts)
        counted = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(us < F.lit(mark).cast("long")).alias("late"), F.max(us).alias("_newest"))
        (counted.select(F.lit(i).cast("long").alias("batch"), "rows", "late", F.lit(mark).cast("long").alias("watermark_us"),
                        F.greatest("_newest", F.lit(known).cast("long")).alias("newest_us"))
         .write.mode("overwrite").parquet(f"{folder}/out/part={i}"))

    root = for_each_batch(event_time(stream, ts), name, work, root)
    return stream.sparkSession.read.schema(state).parquet(f"{root}/out").drop("newest_us", "part")


def supervise(stream: DataFrame, s: Series, primary: str, fallback: str, situation: list[guards.Guard], dt_s: float, carry: list[str],
              max_w: float = guards.MAX_W, max_rate: float = guards.MAX_RATE_W_PER_S, rows: int = 4096, name: str = "supervised",
              root: str | None = None, every: int = 16, forget_s: float | None = None) -> DataFrame:
    """All guards of :func:`guards.supervise`, batch by batch: sensor and envelope faults, fallback, clamp, slew limit.

    Carried on per key are the last command, the number of steps and the clock, written for the keys a batch touches
    (:class:`KeyedState` says what ``every`` and ``forget_s`` do).  A row that is not newer than what its key
    has already acted on comes too late to be a command and is left out.  ``root`` is the folder of an earlier run to go on from.
    """
    keys = list(s.keys)

    def work(batch: DataFrame, i: int, root: str) -> None:
        spark = batch.sparkSession
        state = KeyedState(root, s.keys, T.StructType([*(batch.schema[k] for k in keys), T.StructField("_last", T.DoubleType()),
                           T.StructField("_n", T.LongType()), T.StructField("_t", batch.schema[s.time].dataType)]), "_t", every, forget_s)
        due = (attach_counted(state.on_time(batch, i, s.time), state.before(spark, i), keys, "left")
               .filter(F.col("_t").isNull() | (F.col(s.time) > F.col("_t"))))
        out = guards.supervise(due, s, primary, fallback, situation, dt_s, [*carry, "_n"], max_w, max_rate, rows, previous="_last")
        out.withColumn("pos", F.col("pos") + F.coalesce("_n", F.lit(0))).drop("_n").write.mode("overwrite").parquet(f"{root}/out/batch={i}")
        done = spark.read.parquet(f"{root}/out/batch={i}")
        state.write(done.groupBy(*keys).agg(F.max_by("applied_w", s.rank_by()).alias("_last"), (F.max("pos") + 1).alias("_n"),
                                            F.max(s.time).alias("_t")), i)

    root = for_each_batch(stream, name, work, root)
    return stream.sparkSession.read.parquet(f"{root}/out").drop("batch")


def guarded_commands(stream: DataFrame, s: Series, proposed: str, dt_s: float, carry: list[str], max_rate: float,
                     max_w: float = guards.MAX_W, rows: int = 4096, name: str = "guarded", root: str | None = None,
                     every: int = 16, forget_s: float | None = None) -> DataFrame:
    """Clamp and slew-limit commands batch by batch.

    A batch runs through the same skew-safe operator as a table.  What is carried on is the last
    command and clock per key, one row each, written for the keys a batch touches (:class:`KeyedState`).
    A row that is not newer than what its key has already acted on is left out, as in :func:`supervise`.
    """
    clamp = guards.actuator_clamp(max_w)
    keys = list(s.keys)

    def work(batch: DataFrame, i: int, root: str) -> None:
        spark = batch.sparkSession
        state = KeyedState(root, s.keys, T.StructType([*(batch.schema[k] for k in keys), T.StructField("_last", T.DoubleType()),
                           T.StructField("_t", batch.schema[s.time].dataType)]), "_t", every, forget_s)
        safe = state.on_time(batch, i, s.time).withColumn("_cmd", clamp(F.col(proposed))["value"])
        due = (attach_counted(safe, state.before(spark, i), keys, "left")
               .filter(F.col("_t").isNull() | (F.col(s.time) > F.col("_t"))).drop("_t"))
        out = guards.rate_limit(due, s.fitted(due), "_cmd", dt_s, list(dict.fromkeys([*carry, s.time, *s.tie, proposed, "_cmd"])),
                                max_rate=max_rate, previous="_last", bounds=(0.0, max_w), rows=rows)
        reason = F.coalesce(F.when(~F.coalesce(F.col(proposed) == F.col("_cmd"), F.lit(False)), clamp(F.col(proposed))["reason"]),
                            guards.rate_reason(F.col("applied_w"), F.col("_cmd")))
        out.withColumn("reason", reason).drop("_cmd", "pos").write.mode("overwrite").parquet(f"{root}/out/batch={i}")
        done = spark.read.parquet(f"{root}/out/batch={i}")
        state.write(done.groupBy(*keys).agg(F.max_by("applied_w", s.rank_by()).alias("_last"), F.max(s.time).alias("_t")), i)

    root = for_each_batch(stream, name, work, root)
    return stream.sparkSession.read.parquet(f"{root}/out").drop("batch")
