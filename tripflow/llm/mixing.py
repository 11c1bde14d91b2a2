"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy.

1. Sizes (words) are added up per source. Sources in code point order, null last, get the weights in turn.
2. Targets share ``share`` of all words by weight. A target stops at ``most`` times its source's size, and what it leaves is
   shared anew by weight among the others until none is above: every target is the lesser of its stop and level * weight.
   Level and stops are ratios of whole numbers, compared exactly.
3. A source's rate is its target over its size. Each document is emitted floor(rate) times, and once more where its draw, a
   uniform number from a hash of seed, id and text, is below the fraction of the rate.
4. One draw per document leaves a source of few documents some way off its target. So there are ``DRAWS`` independent draws,
   and each source uses the one whose sum of words comes nearest to its target (the first of equals), by one more aggregate.

SQL functions only. Texts are read once; the tables that are shuffled and joined hold ids, sizes and draws. Sums per source
are partial before they are shuffled, the table of sources is joined without a hint, so Spark broadcasts it where its size
allows and splits hot sources where it does not, and sources are ranked by a range partition, never in one task.

Defined results: a null or blank text has size 0 and is taken 0 times 0 words; a null source is a source of its own, after
all others; sources without words have the target 0. Rows that repeat id and text have the same draws and are taken alike;
null ids draw by their text. An empty table gives an empty result. Columns of the input other than id, source and text are
ignored by ``mixed`` and pass through ``emitted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.operators.rank import ranked
from tripflow.session import durable

WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2  # the share of all words is a ratio of whole numbers
DRAWS, DIGITS = 16, 8  # draws per document; hexadecimal digits of each
PER_HASH = 64 // DIGITS
BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \t-\r]+"), "")), F.lit(0)).cast("long")


def draws(seed: int, id_: Column, text: Column) -> Column:
    """The document's draws as whole numbers below 16**DIGITS, of which each is as likely as any other."""
    key = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    hashes = [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(j)), key), 256) for j in range(-(-DRAWS // PER_HASH))]
    return F.array(*[F.conv(F.substring(hashes[k // PER_HASH], 1 + DIGITS * (k % PER_HASH), DIGITS), 16, 10).cast("long") for k in range(DRAWS)])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (columns source, source_size) with ``target``.

    Each pass of the loop shares what the stopped sources leave among the rest; only the one row of sums reaches the driver.
    """
    places = ranked(sources, [F.col("source").isNull(), "source"], "place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = durable(places.withColumn("weight", turn).drop("place"), "mix-sources")
    stop = F.col("source_size").cast(BIG) * most
    up, down = share
    whole = table.agg(F.sum(F.col("source_size").cast(BIG)), F.sum("weight")).first()
    left, weight = up * int(whole[0] or 0), down * int(whole[1] or 1)  # level = left / weight
    while True:
        above = F.lit(str(left)).cast(BIG) * F.col("weight") >= stop * F.lit(str(weight)).cast(BIG)
        held = table.agg(F.sum(F.when(above, stop)), F.sum(F.when(~above, F.col("weight")))).first()
        now = up * int(whole[0] or 0) - down * int(held[0] or 0), down * int(held[1] or 0)
        if now == (left, weight) or not now[1]:
            break
        left, weight = now
    level = (F.lit(str(left)).cast(BIG) * F.col("weight")).cast("double") / F.lit(float(weight))
    return table.withColumn("target", F.when(above, stop.cast("double")).otherwise(level)).drop("weight")


def _same() -> Column:
    return F.col("source").eqNullSafe(F.col("s"))


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17,
          weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """``id``, ``source``, ``size`` and ``draws`` of every row, and per source ``s`` its sizes, target, whole copies, fraction and draw."""
    rows = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                               draws(seed, F.col(id_col), F.col(text_col)).alias("draws")), "mix-rows")
    table = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = durable(table.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate")), "mix-rates")
    table = table.withColumn("least", F.floor("rate")).withColumn("part", (F.col("rate") - F.floor("rate")) * float(16 ** DIGITS))

    pulled = [F.sum(F.when(F.get("draws", F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"d{k}") for k in range(DRAWS)]
    tried = rows.join(table.filter("part > 0").select("s", "part"), _same()).groupBy("s").agg(*pulled)
    off = F.array(*[F.abs(F.col(f"d{k}") + F.col("least") * F.col("source_size") - F.col("target")) for k in range(DRAWS)])
    draw = F.array_position(off, F.array_min(off)).cast("int") - 1
    best = table.join(tried.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    best = best.select("s", "source_size", "target", "rate", "least", "part", F.coalesce(draw, F.lit(0)).alias("draw"))
    return rows, durable(best, "mix-draws")


def copies() -> Column:
    """How often a row is taken, from its draws and its source's row of the plan."""
    return F.col("least") + (F.get("draws", F.col("draw")) < F.col("part")).cast("long")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``."""
    rows, best = plan(docs, id_col, source_col, text_col, **how)
    out = rows.join(best, _same()).withColumn("copies", copies())
    return out.select("id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emitted(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with ``copy`` (from 0) in place of a column of that name.

    A row's draws follow from the row, so texts meet the small table of sources only.
    """
    _, best = plan(docs, id_col, source_col, text_col, seed, **how)
    kept = [c for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), draws(seed, F.col(id_col), F.col(text_col)).alias("draws"))
    rows = rows.join(best, _same()).withColumn("copies", copies()).filter("copies > 0")
    return rows.select("row.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
