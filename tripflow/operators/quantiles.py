"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.session import durable

DIGITS = 4096                 # digits a bracket is cut into per round of selection
SMALL_TABLE = 8 << 20         # bytes of brackets that may be sent to every task
KEPT = 4_000_000              # rows inside brackets up to which the brackets are sent to the rows
TASK_ROWS = 500_000           # rows a task gets where rows and brackets are shuffled
HOT = 1_000_000               # rows of a group that may meet in one task
EXPONENTS, STEPS = 1075, 2.0 ** 50


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str, **kw) -> DataFrame:
    """Linear-interpolated quantile per group without gathering the group."""
    return exact_quantiles(df, keys, value, {out: q}, **kw)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], **kw) -> DataFrame:
    """Several quantiles of the same groups in the same two passes."""
    ranks = {name: (q, lambda n, q=q: (n - 1) * F.lit(float(q))) for name, q in quantiles.items()}
    return order_statistics(df, keys, value, ranks, **kw)


def place(v: Column) -> Column:
    """A long that keeps the order of doubles; at most four neighbouring doubles share one.

    Exponent and the upper 50 bits of the fraction, with the sign of the value.  Infinities lie outside all numbers and NaN
    above them, as in Spark's own order; differences of two places fit a long.
    """
    size = F.abs(v)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1074))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = guess - (size < power(guess)).cast("long") + (size >= power(guess + 1)).cast("long")
    at = (e + EXPONENTS) * F.lit(1 << 50) + F.floor((size / power(e) - 1.0) * STEPS)
    far = F.lit((1024 + EXPONENTS) << 50)
    whole = F.when(F.isnan(v), far + 1).when(size == float("inf"), far).when(size == 0, F.lit(0)).otherwise(at)
    return F.when((v < 0) & ~F.isnan(v), -whole).otherwise(whole).cast("long")


def _meet(rows: DataFrame, brackets: DataFrame, keys: list[str], seen: dict[str, int]) -> DataFrame:
    """Rows next to their group's brackets, by the figures ``seen`` of all brackets.

    A small table of brackets goes to every task if it leaves few rows.  Otherwise both are shuffled to as many tasks as the rows
    need, and only groups of more than ``HOT`` rows have their brackets repeated, once for every ``HOT`` rows.  The hint keeps Spark
    from sending the table to every task after all: it goes by the size of the compressed file.
    """
    if _fits(seen):
        return rows.join(F.broadcast(brackets), keys)
    tasks = 1 + (seen["rows"] or 0) // TASK_ROWS
    if not seen["hot"]:
        return rows.drop("_h").repartition(tasks, *keys).join(brackets.hint("merge"), keys)
    share = F.ceil(F.col("_n") / HOT)
    dealt = rows.join(F.broadcast(brackets.filter(F.col("_n") > HOT).select(*keys, share.alias("_of"))), keys, "left")
    salted = dealt.withColumn("_salt", F.pmod("_h", F.coalesce("_of", F.lit(1).cast("bigint")))).repartition(tasks, *keys, "_salt")
    copies = brackets.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), share - 1)))
    return salted.join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt", "_of")


def _fits(seen: dict[str, int]) -> bool:
    return (seen["bytes"] or 0) <= SMALL_TABLE and (seen["kept"] or 0) <= KEPT


def _at(cells: Column, rank: Column, field: str) -> Column:
    """``field`` of the cell that holds the zero-based rank; cells are in order and ``c`` is their number of rows."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("cell"), F.lit(0).alias("i"))
    hit = lambda s, c: (s["seen"] <= rank) & (rank < s["seen"] + c["c"])
    found = F.aggregate(cells, start, lambda s, c: F.struct(
        (s["seen"] + c["c"]).alias("seen"), F.when(hit(s, c), s["i"]).otherwise(s["cell"]).alias("cell"), (s["i"] + 1).alias("i")))
    return F.get(cells, found["cell"])[field]


def _narrowed(src: DataFrame, brackets: DataFrame, keys: list[str], ends: list[Callable[[Column], Column]],
              seen: dict[str, int]) -> DataFrame:
    """One round of selection: every bracket is cut into digits by place, and only the digit that holds the rank stays.

    Rows become counts per (group, bracket, digit) before the shuffle, so a group sends at most ``DIGITS`` rows a task.
    """
    both = F.flatten(F.transform("_s", lambda s: F.when(s["w"] % 2 == 1, F.array(s)).otherwise(F.array(
        s, s.withField("w", s["w"] + 1)))))
    split = F.when(F.exists("_s", lambda s: s["w"] % 2 == 1), F.col("_s")).otherwise(both)
    cut = F.transform(split, lambda s: F.struct(s.alias("s"), place(s["lo"]).alias("p"), (F.floor(
        (place(s["hi"]) - place(s["lo"])) / F.lit(float(DIGITS))) + 1).alias("step")))
    met = _meet(src, brackets.select(*keys, "_n", cut.alias("_cut")), keys, seen)
    rows = met.select(*keys, "_v", F.explode(F.filter("_cut", lambda x: F.col("_v") <= x["s"]["hi"])).alias("_x"))
    digit = F.when(F.col("_v") >= F.col("_x.s.lo"), F.floor((place(F.col("_v")) - F.col("_x.p")) / F.col("_x.step"))).otherwise(F.lit(-1))
    # Counts carry numbers only, so that they are hashed; a structure among them would have every row sorted first.
    counts = (rows.groupBy(*keys, F.col("_x.s.w").alias("_w"), digit.alias("_d"))
              .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    cells = counts.groupBy(*keys, "_w").agg(F.sort_array(F.collect_list(F.struct("_d", "c", "lo", "hi"))).alias("_cells"))
    old = brackets.select(*keys, "_n", F.explode(split).alias("_old")).withColumn("_w", F.col("_old.w"))
    folded = cells.join(F.broadcast(old) if _fits(seen) else old.hint("merge"), [*keys, "_w"])
    rank = F.coalesce(*[F.when(F.col("_w") == i, end(F.col("_n"))) for i, end in enumerate(ends)])
    hit = lambda f: _at(F.col("_cells"), rank, f)
    # A rank beyond the last row has no digit: its bracket stays as it is and counts as settled.
    span = F.struct(F.col("_w").alias("w"), F.coalesce(hit("lo"), "_old.lo").alias("lo"), F.coalesce(hit("hi"), "_old.hi").alias("hi"),
                    F.coalesce(hit("c"), F.lit(0)).alias("most"))
    spans = folded.select(*keys, span.alias("_one")).groupBy(*keys).agg(F.collect_list("_one").alias("_new"))
    return brackets.join(spans, keys).select(*keys, "_n", "_also", F.col("_new").alias("_s"))


def order_statistics(df: DataFrame, keys: list[str], value: str,
                     ranks: dict[str, tuple[float, Callable[[Column], Column]]],
                     margin: float = 0.001, accuracy: int = 20_000, also: dict[str, Callable[[Column], Column]] | None = None,
                     most: int = 20_000) -> DataFrame:
    """Values at the zero-based, possibly fractional ranks ``rank_of(n)`` of each group.

    ``ranks`` maps an output name to ``(near, rank_of)``; ``rank_of(n)`` must lie within two ranks
    of ``near * n``.  A rank beyond the last row gives NULL.  ``also`` adds plain aggregates of the
    value, taken in the sketch pass.

    A mergeable sketch brackets each rank: it errs by at most n/accuracy ranks, the bracket is ``margin`` of all ranks wide on
    both sides, and groups too small for that are one bracket.  Brackets that may hold more than ``most`` distinct values are
    narrowed by radix selection, a digit a round, until they hold no more (seven rounds at the very most, none for groups below
    ``most / (2 * margin)`` rows).  Then the distinct values in a bracket and one count of the rows below it give the result,
    so no task sees more than ``most`` values of a group at once, whatever the group's size.  The brackets, one row per group,
    are written once.
    """
    named = bool(keys)
    if not named:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    names = list(ranks)
    # Rows of equal value are told apart by their other numbers, so that they spread over tasks.
    rest = [f.name for f in df.schema.fields if f.name not in (*keys, value) and isinstance(f.dataType, T.NumericType)]
    src = (df.select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(value, *rest).alias("_h"))
           .filter("_v IS NOT NULL"))
    marks = [m for near, _ in ranks.values() for m in (max(near - margin, 0.0), min(near + margin, 1.0))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), F.lit(accuracy))
    sketched = src.groupBy(*keys).agg(sketch.alias("_b"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                      F.struct(F.lit(0), *[f(F.col("_v")).alias(a) for a, f in (also or {}).items()]).alias("_also"))
    small = F.col("_n") * (margin - 1.0 / accuracy) < 4
    held = F.when(small, F.col("_n")).otherwise(F.ceil(F.col("_n") * (2 * (margin + 1.0 / accuracy))) + 6)
    # Bracket 2i serves both ends of a fractional rank until it is narrowed; then 2i holds the lower end and 2i + 1 the upper.
    spans = F.array(*[F.struct(F.lit(2 * i).alias("w"), F.when(small, F.col("_min")).otherwise(F.col("_b")[2 * i]).alias("lo"),
                               F.when(small, F.col("_max")).otherwise(F.col("_b")[2 * i + 1]).alias("hi"), held.alias("most"))
                      for i in range(len(names))])
    ends = [lambda n, r=r, f=f: f(r(n)) for _, r in ranks.values() for f in (F.floor, F.ceil)]
    wide = F.exists("_s", lambda s: (s["most"] > most) & (place(s["hi"]) > place(s["lo"])))
    weight = F.sum(F.octet_length(F.concat_ws("", *[F.col(k).cast("string") for k in keys])) + 64 + 96 * len(names))
    held = F.aggregate("_s", F.lit(0).cast("long"), lambda a, s: a + s["most"].cast("long"))
    brackets = sketched.select(*keys, "_n", "_also", spans.alias("_s"))
    while True:
        look = Observation()
        brackets = durable(brackets.observe(look, weight.alias("bytes"), F.count_if(wide).alias("wide"), F.sum("_n").alias("rows"),
                                            F.sum(held).alias("kept"), F.count_if(F.col("_n") > HOT).alias("hot")), "brackets")
        seen = look.get
        if not seen["wide"]:
            break
        brackets = brackets.filter(~wide).unionByName(_narrowed(src, brackets.filter(wide), keys, ends, seen))

    wanted = _meet(src, brackets.select(*keys, "_n", "_s"), keys, seen).select(
        *keys, "_v", F.explode(F.filter("_s", lambda s: F.col("_v") <= s["hi"])).alias("_s"))
    slot = F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v"))
    counts = wanted.groupBy(*keys, F.col("_s.w").alias("_w"), slot.alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    cells = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_w", "_v", "c"))).alias("_cells"))
    facts = brackets.select(*keys, "_n", "_also")
    folded = cells.join(F.broadcast(facts) if _fits(seen) else facts.hint("merge"), keys)
    lost = F.raise_error("a quantile bracket missed its rank").cast("double")

    def end(w: int) -> Column:
        own = F.filter("_cells", lambda c: c["_w"] == w)
        cells = own if w % 2 == 0 else F.when(F.size(own) > 0, own).otherwise(F.filter("_cells", lambda c: c["_w"] == w - 1))
        rank = ends[w](F.col("_n"))
        found = _at(cells, rank, "_v")
        return F.when(found.isNull() & (rank < F.col("_n")), lost).otherwise(found)

    parts = [c for i, (_, rank_of) in enumerate(ranks.values()) for c in (
        end(2 * i).alias(f"_a{i}"), end(2 * i + 1).alias(f"_z{i}"), (rank_of(F.col("_n")) - F.floor(rank_of(F.col("_n")))).alias(f"_f{i}"))]
    picked = folded.select(*keys, "_also", *parts)
    return picked.select(*(keys if named else []), *[
        (F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)],
        *[F.col(f"_also.{a}").alias(a) for a in (also or {})])
