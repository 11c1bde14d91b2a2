"""Places of rows in a global order that no task sorts as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.session import durable

PLACE = (1 << 33) - 1     # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def ranked(df: DataFrame, order: list[str | Column], out: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the zero-based place of every row by ``order``, counted within the columns ``within``.

    A range partition puts the rows in order, a row's place in its partition is known where it is sorted, and only one count
    per partition (and the first place per group) is added up.  Nothing depends on what the values look like: long common
    prefixes, NULLs and skewed values spread alike.  Rows of equal order may come in any order; give enough columns.  The
    partitions are written once, so that a lost executor cannot change them between two uses.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in (*within, *order)]
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(by)])
    names = [f"_o{i}" for i in range(len(by))]
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_at", F.monotonically_increasing_id())
    placed = durable(placed.drop(*names[len(within):]), "ranked").withColumn("_task", F.shiftright("_at", 33))
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    rows = placed.join(counts.select("_task", before.alias("_before")), "_task")
    rows = rows.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit(PLACE))).drop("_task", "_at", "_before")
    if not within:
        return rows
    groups = names[:len(within)]
    first = rows.groupBy(*groups).agg(F.min(out).alias("_first")).withColumnsRenamed({c: f"{c}g" for c in groups})
    same = [F.col(c).eqNullSafe(F.col(f"{c}g")) for c in groups]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(first, on).withColumn(out, F.col(out) - F.col("_first")).drop("_first", *groups, *[f"{c}g" for c in groups])
