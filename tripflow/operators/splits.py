"""Sessions, leakage-free folds, hold-outs and group-wise splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.operators.ordered import Series, attach, with_last_valid, with_neighbours
from tripflow.operators.rank import ranked


def sessions(overview: DataFrame, by: tuple[str, ...] = (), trip: str = "trip", day: str = "day",
             warm: str = "warm_start", rows: int = 100_000) -> DataFrame:
    """Driving session of each trip: a run of warm starts on one day, in trip order.

    A session opens on the first trip, on a change of day (an unknown day always changes) and on a
    cold start.  Pass the vehicle columns as ``by`` to keep vehicles apart.  The trips of a vehicle
    are cut into blocks of ``rows`` by their place in order, so ids of any form spread alike.
    """
    placed = ranked(overview.select(*by, trip, day, warm), [trip], "_pos", tuple(by))
    s = Series(tuple(by), "_pos", block=F.floor(F.col("_pos") / rows))
    near = with_neighbours(placed, s, [day], following=False)
    opens = F.coalesce((F.col(f"prev_{day}") != F.col(day)) | ~F.col(warm), F.lit(True))
    label = F.when(opens, F.concat(F.coalesce(F.col(day), F.lit("None")), F.lit("#"), F.col(trip)))
    return with_last_valid(near.withColumn("_label", label), s, "_label", "session").select(*by, trip, day, "session")


def day_groups(overview: DataFrame, trip: str = "trip", day: str = "day") -> DataFrame:
    return overview.select(trip, F.col(day).alias("group"))


def checked_groups(trips: DataFrame, groups: DataFrame, trip: str = "trip", group: str = "group") -> DataFrame:
    """Group label of every trip; a trip without label or with two fails the job."""
    per_trip = groups.groupBy(trip).agg(F.count(F.lit(1)).alias("_n"), F.first(group).alias(group))
    joined = trips.join(per_trip, trip, "left")
    fault = (F.when(F.col("_n") > 1, F.concat(F.lit("duplicate trip in the group map: "), F.col(trip).cast("string")))
             .when(F.col(group).isNull(), F.concat(F.lit("no group label for trip "), F.col(trip).cast("string"))))
    return joined.withColumn(group, F.when(fault.isNull(), F.col(group)).otherwise(
        F.raise_error(fault).cast(joined.schema[group].dataType))).drop("_n")


def group_problems(trips: DataFrame, groups: DataFrame, trip: str = "trip") -> DataFrame:
    """The same check as a report: trips whose label is missing or doubled."""
    twice = groups.groupBy(trip).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(trip, F.lit("duplicate").alias("problem"))
    none = trips.join(groups, trip, "left_anti").select(trip, F.lit("missing").alias("problem"))
    return twice.unionByName(none)


def holdout(trips: DataFrame, held: DataFrame, trip: str = "trip") -> tuple[DataFrame, DataFrame]:
    """(development, hold-out) parts of a table by a list of trips."""
    return attach(trips, held, [trip], "left_anti"), attach(trips, held, [trip], "left_semi")


def cold_trips(trips: DataFrame, ambient: str, below: float = 0.0, trip: str = "trip") -> DataFrame:
    """The hold-out list by rule: trips that were ever colder than a threshold."""
    return trips.groupBy(trip).agg(F.min(ambient).alias("_lo")).filter(F.col("_lo") < below).select(trip)


def group_sizes(labels: DataFrame, group: str = "group") -> DataFrame:
    return labels.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def deal_folds(sizes: DataFrame, k: int, group: str = "group") -> DataFrame:
    """Groups dealt to ``k`` folds in a serpentine, largest first, ties by label."""
    placed = ranked(sizes.select(group, "size"), [-F.col("size"), group], "_r")
    lap, seat = F.floor(F.col("_r") / k), F.col("_r") % k
    return placed.select(group, "size", F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int").alias("fold"))


def greedy_steps(counts: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Where greedy balance puts the groups of each size: (size, place of the first, folds taken in turn from there).

    ``counts`` has the number of groups per size.  While groups of one size are placed, the next one dropped on a fold finds
    it at load + j * size for j = 0, 1, ...; the lightest fold first means these levels in ascending order, ties by fold.  So
    folds take turns in the order of load modulo size, and a heavier fold joins once the others have come up to it.
    """
    loads, steps = [0] * k, []
    for size, groups in sorted(counts, reverse=True):
        lap, placed = min(x // size for x in loads), 0
        taken = [0] * k
        while placed < groups:
            turn = sorted((f for f in range(k) if loads[f] // size <= lap), key=lambda f: (loads[f] % size, f))
            joins = min((loads[f] // size for f in range(k) if loads[f] // size > lap), default=None)
            n = groups - placed if joins is None else min(groups - placed, (joins - lap) * len(turn))
            steps.append((size, placed, turn))
            for at, f in enumerate(turn):
                taken[f] += n // len(turn) + (at < n % len(turn))
            placed, lap = placed + n, joins
        loads = [x + size * t for x, t in zip(loads, taken)]
    return steps


def balance_folds(sizes: DataFrame, k: int, group: str = "group") -> DataFrame:
    """Greedy balance: each group, largest first and by label, goes to the lightest fold (the lowest on ties).

    Exact for any number of groups.  Only the distinct sizes are walked one after the other (on the driver, at most about
    the square root of twice the rows); the groups of one size are placed by arithmetic on their rank.
    """
    counts = [(r["size"], r["count"]) for r in sizes.groupBy("size").count().toLocalIterator()]
    steps = sizes.sparkSession.createDataFrame(greedy_steps(counts, k), "_s long, _first long, _turn array<int>")
    until = F.lead("_first").over(Window.partitionBy("_s").orderBy("_first"))
    steps = steps.withColumn("_until", F.coalesce(until, F.lit(2 ** 62)))
    at = (F.col("size") == F.col("_s")) & (F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_until"))
    placed = ranked(sizes.select(group, "size"), [group], "_r", ("size",)).join(steps, at)
    return placed.select(group, "size", F.get("_turn", ((F.col("_r") - F.col("_first")) % F.size("_turn")).cast("int")).alias("fold"))


def fold_roles(labels: DataFrame, folds: DataFrame, k: int, trip: str = "trip", group: str = "group") -> DataFrame:
    """Long fold table (fold, trip, role): every trip is test in its own fold and train in the others."""
    home = labels.join(folds.select(group, F.col("fold").alias("_home")), group)
    every = home.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.select("fold", trip, group, F.when(F.col("fold") == F.col("_home"), "test").otherwise("train").alias("role"))


def overlap(roles: DataFrame, what: str) -> DataFrame:
    """Trips or groups that are both train and test in one fold; a sound fold table gives none."""
    both = roles.groupBy("fold", what).agg(F.bool_or(F.col("role") == "train").alias("_a"), F.bool_or(F.col("role") == "test").alias("_b"))
    return both.filter("_a AND _b").select("fold", what)


def random_group_split(groups: DataFrame, seed: int = 42, test: float = 0.30, final: float = 0.50,
                       group: str = "group") -> DataFrame:
    """Groups split into train/val/test in a seeded order; shares are rounded up, as 26/6/6 of 38.

    Groups are ordered by a hash of seed and label (equal hashes by label).
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")))
    placed = ranked(groups.select(group).distinct(), [h, group], "_r")
    placed = placed.join(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_all"))))     # one row
    held = F.ceil(F.col("_all") * test)
    last = F.ceil(held * final)
    return placed.select(group, F.when(F.col("_r") < last, "test").when(F.col("_r") < held, "val").otherwise("train").alias("split"))
