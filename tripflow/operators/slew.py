"""Slew-limited commands: each command moves toward its request by at most one step.

The move is monotone in the previous command, so a block of rows whose lowest and highest possible
start states end in the same command forgets its start.  Such blocks, nearly all of them, need no
predecessor.  A block that remembers its start is kept exactly, as the piecewise-linear map from
start to end, and is chained to the blocks before it back to the last one that forgets.  Chains are
composed in levels: maps of up to ``SPAN`` blocks become one map, so no task holds a whole chain.
Every step whose request lies inside the reach takes twice the step out of it, so a composed map
has at most 1 + (hi - lo) / (2 * step) rising pieces, however many rows it stands for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.operators.ordered import Series, attach, with_position
from tripflow.session import durable


SPAN, LEVELS = 512, 1


def _move(x, request, step):
    return np.clip(request, x - step, x + step)


def _matrix(requests) -> np.ndarray:
    """Requests of many blocks side by side; short blocks end in NaN, which moves nothing."""
    out = np.full((len(requests), max(len(r) for r in requests)), np.nan)
    for i, r in enumerate(requests):
        out[i, :len(r)] = r
    return out


def _step_all(x: np.ndarray, column: np.ndarray, step: float) -> np.ndarray:
    return np.where(np.isnan(column), x, _move(x, column, step))


def block_map(requests: np.ndarray, step: float, lo: float, hi: float) -> tuple[list[float], list[float]]:
    """Start-to-end map of a block on [lo, hi], as the corners of a line of slopes 0 and 1."""
    xs, ys = np.array([lo, hi]), np.array([lo, hi])
    for r in requests:
        for bend in (r - step, r + step):
            i = int(np.searchsorted(ys, bend))
            if 0 < i < len(ys) and ys[i - 1] < bend < ys[i]:
                x = xs[i - 1] + (bend - ys[i - 1])
                xs, ys = np.insert(xs, i, x), np.insert(ys, i, bend)
        ys = _move(ys, r, step)
        slope = np.diff(ys) > 0.5 * np.diff(xs)
        keep = np.ones(len(xs), bool)
        keep[1:-1] = slope[1:] != slope[:-1]
        xs, ys = xs[keep], ys[keep]
    return xs.tolist(), ys.tolist()


def _folder(step: float):
    def fold(requests: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        m = _matrix(requests.to_list())
        low, high = lo.to_numpy(float), hi.to_numpy(float)
        for j in range(m.shape[1]):
            low, high = _step_all(low, m[:, j], step), _step_all(high, m[:, j], step)
        base, starts, ends = low.copy(), [[]] * len(low), [[]] * len(low)
        for i in np.flatnonzero(low != high):
            xs, ys = block_map(np.asarray(requests.iloc[i], float), step, lo.iloc[i], hi.iloc[i])
            ramps = [(a, b) for a, b, rise in zip(xs, xs[1:], np.diff(ys)) if rise > 0.5 * (b - a)]
            base[i], starts[i], ends[i] = ys[0], [a for a, _ in ramps], [b for _, b in ramps]
        return pd.DataFrame({"base": base, "forgets": low == high, "ramp_from": starts, "ramp_to": ends})
    return F.pandas_udf(fold, "base double, forgets boolean, ramp_from array<double>, ramp_to array<double>")


def _map_state(block: Column, x: Column) -> Column:
    """End state of a block: its base plus how far the start reaches into each ramp."""
    ramps = F.arrays_zip(block["ramp_from"].alias("a"), block["ramp_to"].alias("b"))
    return F.aggregate(ramps, block["base"], lambda acc, r: acc + F.least(F.greatest(x, r["a"]), r["b"]) - r["a"])


def compose(first: tuple, second: tuple) -> tuple[float, np.ndarray, np.ndarray]:
    """The map that applies ``first`` and then ``second``; a map is (base, starts of its ramps, their ends)."""
    base, a, b = first
    at, c, d = second
    value = lambda x: at + float(np.sum(np.clip(x, c, d) - c))
    ends = base + np.cumsum(b - a)
    begins = np.concatenate([[base], ends[:-1]]) if len(a) else ends
    if not len(a) or not len(c):
        return value(base), a[:0], b[:0]
    marks = np.unique(np.clip(np.concatenate([begins, ends, c, d]), base, ends[-1]))
    low, high = marks[:-1], marks[1:]
    middle = low + (high - low) / 2
    i = np.clip(np.searchsorted(begins, middle, "right") - 1, 0, len(a) - 1)
    j = np.searchsorted(c, middle, "right") - 1
    rises = (j >= 0) & (middle < d[np.maximum(j, 0)])
    shift = (a - begins)[i]
    return value(base), (low + shift)[rises], (high + shift)[rises]


def _composer():
    def composed(base: pd.Series, ramp_from: pd.Series, ramp_to: pd.Series) -> pd.DataFrame:
        out = []
        for bases, starts, ends in zip(base, ramp_from, ramp_to):
            maps = [(float(z), np.asarray(a, float), np.asarray(b, float)) for z, a, b in zip(bases, starts, ends)]
            out.append(reduce(compose, maps))
        return pd.DataFrame({"base": [m[0] for m in out], "ramp_from": [m[1].tolist() for m in out], "ramp_to": [m[2].tolist() for m in out]})
    return F.pandas_udf(composed, "base double, ramp_from array<double>, ramp_to array<double>")


def _chain(maps: DataFrame, keys: list[str], at: str = "_at", span: int = SPAN, levels: int = LEVELS) -> DataFrame:
    """State before each map of a chain: ``maps`` has the place ``at`` in the chain and ``first``, the state before place 0."""
    member = F.struct(at, "base", "ramp_from", "ramp_to")
    if levels == 0:
        lists = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("m"), F.max("first").alias("s"))
    else:
        up = f"{at}u"
        lists = maps.groupBy(*keys, F.floor(F.col(at) / span).alias(up)).agg(F.sort_array(F.collect_list(member)).alias("m"), F.max("first").alias("first"))
        whole = lists.select(*keys, up, "first", _composer()("m.base", "m.ramp_from", "m.ramp_to").alias("w")).select(*keys, up, "first", "w.*")
        lists = lists.drop("first").join(_chain(whole, keys, up, span, levels - 1).withColumnRenamed("start", "s"), [*keys, up])
    begin = F.struct(F.col("s").alias("x"), F.array().cast("array<double>").alias("seen"))
    seen = F.aggregate("m", begin, lambda acc, r: F.struct(
        _map_state(r, acc["x"]).alias("x"), F.array_append(acc["seen"], acc["x"]).alias("seen")))["seen"]
    return (lists.select(*keys, F.explode(F.arrays_zip(F.col("m").alias("m"), seen.alias("s"))).alias("z"))
            .select(*keys, F.col(f"z.m.{at}").alias(at), F.col("z.s").alias("start")))


def _runner(step: float):
    def run(requests: pd.Series, start: pd.Series) -> pd.Series:
        m, x = _matrix(requests.to_list()), start.to_numpy(float)
        out = np.empty_like(m)
        for j in range(m.shape[1]):
            x = out[:, j] = _step_all(x, m[:, j], step)
        return pd.Series([out[i, :len(r)] for i, r in enumerate(requests)])
    return F.pandas_udf(run, "array<double>")


def slew(df: DataFrame, s: Series, request: str, step: float, out: str, carry: list[str],
         previous: str | None = None, bounds: tuple[float, float] | None = None, rows: int = 4096) -> DataFrame:
    """Command after every row of each key, and its ``pos``.

    The first row of a key passes and anchors, unless ``previous`` gives the command before it.
    Requests must be finite; ``bounds`` names limits they keep, else those are looked up per key.
    """
    keys = list(s.keys)
    before = F.col(previous) if previous else F.lit(None).cast("double")
    asked = df.withColumns({"_r": F.col(request), "_before": before})
    packed = F.sort_array(F.collect_list(F.struct("pos", "_r", "_before", *carry)))
    blocks = (with_position(asked, s).groupBy(*keys, F.floor(F.col("pos") / rows).alias("_b"))
              .agg(packed.alias("_rows")).withColumn("requests", F.col("_rows._r")))
    if bounds is None:
        span = asked.groupBy(*keys).agg(F.min(F.least("_r", "_before")).alias("lo"), F.max(F.greatest("_r", "_before")).alias("hi"))
        bounded = attach(blocks, span, keys, by=["_b"])
    else:
        bounded = blocks.withColumns({"lo": F.lit(float(bounds[0])), "hi": F.lit(float(bounds[1]))})
    anchor = F.coalesce(F.col("_rows")[0]["_before"], F.col("_rows")[0]["_r"])
    folded = bounded.select(*keys, "_b", anchor.alias("anchor"), _folder(step)("requests", "lo", "hi").alias("f"))
    w = Window.partitionBy(*keys).orderBy("_b")
    known = F.when(F.col("_b") == 0, F.col("anchor")).when(F.lag("f.forgets").over(w), F.lag("f.base").over(w))
    # A chain begins at the last block whose start is known.
    runs = (folded.select(*keys, "_b", "f.*", known.alias("first"))
            .withColumn("_run", F.max(F.when(F.col("first").isNotNull(), F.col("_b"))).over(w)).withColumn("_at", F.col("_b") - F.col("_run")))
    # One row per block, read by every level: written, or each level would run the rows again.
    starts = _chain(durable(runs, "slew-maps"), [*keys, "_run"]).select(*keys, (F.col("_run") + F.col("_at")).alias("_b"), "start")
    done = (blocks.join(starts, [*keys, "_b"])
            .select(*keys, "_rows", _runner(step)("requests", "start").alias("_applied")))
    zipped = F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_applied").alias("a"))).alias("_z")
    return done.select(*keys, zipped).select(
        *keys, F.col("_z.r.pos").alias("pos"), *[F.col(f"_z.r.{c}").alias(c) for c in carry], F.col("_z.a").alias(out))
