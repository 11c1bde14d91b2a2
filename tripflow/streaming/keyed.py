"""State of a stream by key, kept as tables of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class KeyedState:
    """One row per key, written per micro-batch for the keys the batch has touched, and as a whole every ``every`` batches.

    The state before a batch is the last whole table and the changes since, so at most ``every`` small tables are read.  Files
    belong to a batch id: a repeated batch reads what it read before and writes the same files again.

    With ``forget_s`` a key that lies this far behind the newest clock of all keys counts as unknown, and rows that far behind
    are late whatever their key (:meth:`watermark`), so a forgotten key cannot act on an old row.  Whole tables leave such
    keys out; as they are unknown before that too, results do not depend on when it happens.
    """

    root: str
    keys: tuple[str, ...]
    fields: T.StructType
    clock: str
    every: int = 16
    forget_s: float | None = None

    def _path(self, kind: str, i: int) -> str:
        return f"{self.root}/state/{kind}/batch={i}"

    def _all(self, spark: SparkSession, i: int) -> DataFrame:
        """Every key's last row after the batches before ``i``."""
        whole = i // self.every * self.every - 1
        paths = [self._path("whole", whole)] if whole >= 0 else []
        paths += [self._path("changes", j) for j in range(whole + 1, i)]
        if not paths:
            return spark.createDataFrame([], self.fields)
        if len(paths) == 1:
            return spark.read.schema(self.fields).parquet(paths[0])
        rows = (spark.read.schema(self.fields).parquet(*paths)
                .withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)/[^/]*$", 1).cast("long")))
        rest = [f.name for f in self.fields if f.name not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_at").alias("_v"))
        return last.select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*self.fields.names)

    def watermark(self, spark: SparkSession, i: int) -> DataFrame:
        """One row: the clock at and below which rows of batch ``i`` are late for any key (NULL for none)."""
        behind = F.lit(None).cast("double") if self.forget_s is None else F.max(F.col(self.clock).cast("double")) - F.lit(float(self.forget_s))
        return self._all(spark, i).agg(behind.alias("_mark"))

    def before(self, spark: SparkSession, i: int) -> DataFrame:
        """The state that batch ``i`` starts from."""
        known = self._all(spark, i)
        if self.forget_s is None:
            return known
        return known.join(F.broadcast(self.watermark(spark, i))).filter(F.col(self.clock).cast("double") > F.col("_mark")).drop("_mark")

    def on_time(self, rows: DataFrame, i: int, time: str) -> DataFrame:
        """``rows`` of batch ``i`` without those the watermark has passed; their own key's clock is not looked at here."""
        if self.forget_s is None:
            return rows
        late = F.coalesce(F.col(time).cast("double") <= F.col("_mark"), F.lit(False))
        return rows.join(F.broadcast(self.watermark(rows.sparkSession, i))).filter(~late).drop("_mark")

    def write(self, changed: DataFrame, i: int) -> None:
        """Keep the new rows of the keys that batch ``i`` has touched."""
        changed.select(*self.fields.names).write.mode("overwrite").parquet(self._path("changes", i))
        if (i + 1) % self.every == 0:
            spark = changed.sparkSession
            # What the next batch would read without this table.
            earlier = self._all(spark, i).join(spark.read.schema(self.fields).parquet(self._path("changes", i)), list(self.keys), "left_anti")
            now = earlier.unionByName(spark.read.schema(self.fields).parquet(self._path("changes", i)))
            if self.forget_s is not None:
                mark = now.agg((F.max(F.col(self.clock).cast("double")) - F.lit(float(self.forget_s))).alias("_mark"))
                now = now.join(F.broadcast(mark)).filter(F.col(self.clock).cast("double") > F.col("_mark")).drop("_mark")
            now.write.mode("overwrite").parquet(self._path("whole", i))
