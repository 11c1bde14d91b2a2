"""Recurrences over a trip as prefix scans.

A clamped sum, a linear filter and a step of a finite automaton are maps of one state, and each kind is closed under
composition.  So a trip is cut into blocks of rows, every block is folded to one map, the maps are
chained over blocks (and over blocks of blocks), and each block then runs from its own start
state.  No task ever holds more than one block, and a long trip uses as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class MapKind:
    """A family of state maps: its numbers, how two follow each other, how one acts on a state."""

    fields: tuple[str, ...]
    identity: tuple[float, ...]
    compose: Callable[[Column, Column], tuple[Column, ...]]
    act: Callable[[Column, Column], Column]

    def pack(self, values: tuple[Column, ...]) -> Column:
        return F.struct(*[v.cast("double").alias(n) for n, v in zip(self.fields, values)])

    def unit(self) -> Column:
        return self.pack(tuple(F.lit(v) for v in self.identity))


def _inside(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


#: x -> x + shift kept inside [lo, hi]
CLAMPED_SUM = MapKind(("shift", "lo", "hi"), (0.0, -INF, INF),
                      lambda a, b: (a["shift"] + b["shift"],
                                    _inside(a["lo"] + b["shift"], b["lo"], b["hi"]),
                                    _inside(a["hi"] + b["shift"], b["lo"], b["hi"])),
                      lambda m, x: _inside(x + m["shift"], m["lo"], m["hi"]))
#: x -> gain * x + offset
LINEAR = MapKind(("gain", "offset"), (1.0, 0.0),
                 lambda a, b: (a["gain"] * b["gain"], b["gain"] * a["offset"] + b["offset"]),
                 lambda m, x: m["gain"] * x + m["offset"])


def automaton(states: int) -> MapKind:
    """Maps of the states 0 .. ``states`` - 1: one number per state, the state that follows it; composed by lookup."""
    names = tuple(f"s{i}" for i in range(states))
    at = lambda m, x: F.get(F.array(*[m[n] for n in names]), x.cast("int"))
    return MapKind(names, tuple(float(i) for i in range(states)), lambda a, b: tuple(at(b, a[n]) for n in names), at)


def _blocks(df: DataFrame, keys: list[str], pos: str, carry: list[str], rows: int, block: str) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_p"), F.col("_m"), *carry)))
    return df.groupBy(*keys, F.floor(F.col(pos) / rows).alias(block)).agg(packed.alias("_rows"))


def _spread(arrays: DataFrame, keys: list[str], kind: MapKind, carry: list[str], pos: str, out: str,
            inclusive: bool) -> DataFrame:
    """Rows of each block with the state before (or after) them, from the block's start state."""
    start = F.struct(F.col("_start").alias("x"), F.array().cast("array<double>").alias("seen"))

    def walk(acc: Column, row: Column) -> Column:
        after = kind.act(row["_m"], acc["x"])
        return F.struct(after.alias("x"), F.array_append(acc["seen"], after if inclusive else acc["x"]).alias("seen"))

    seen = F.aggregate("_rows", start, walk)["seen"]
    return (arrays.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("r"), seen.alias("s"))).alias("_z"))
            .select(*keys, F.col("_z.r._p").alias(pos), *[F.col(f"_z.r.{c}").alias(c) for c in carry],
                    F.col("_z.s").alias(out)))


def scan(df: DataFrame, keys: list[str], pos: str, kind: MapKind, maps: tuple[Column, ...], init: Column | float,
         out: str, carry: list[str], rows: int = 512, levels: int = 2, inclusive: bool = True) -> DataFrame:
    """State after (or before) every row of each key, starting from ``init``.

    ``maps`` gives the numbers of the row's map.  ``levels`` counts the block levels: two serve
    trips of some 10**8 rows, a third one some 10**11.  Columns in ``carry`` are kept.
    """
    init = init if isinstance(init, Column) else F.lit(float(init))
    named = df.select(*keys, pos, *carry, kind.pack(maps).alias("_m"))
    if levels == 0:
        flat = named.groupBy(*keys).agg(F.sort_array(F.collect_list(
            F.struct(F.col(pos).alias("_p"), F.col("_m"), *carry))).alias("_rows"))
        return _spread(flat.withColumn("_start", init), keys, kind, carry, pos, out, inclusive)
    block = f"_b{levels}"
    arrays = _blocks(named, keys, pos, carry, rows, block)
    whole = F.aggregate("_rows", kind.unit(), lambda a, r: kind.pack(kind.compose(a, r["_m"])))
    folded = arrays.select(*keys, block, whole.alias("_w"))
    starts = scan(folded, keys, block, kind, tuple(F.col(f"_w.{f}") for f in kind.fields), init, "_start",
                  [], rows, levels - 1, inclusive=False)
    return _spread(arrays.join(starts, [*keys, block]), keys, kind, carry, pos, out, inclusive)
