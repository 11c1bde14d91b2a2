"""N-gram Jaccard join with PartEnum signatures: all documents whose shingle sets have a Jaccard of 0.75 or more.

1. Documents become sets of 64-bit hashes of five-word shingles. Documents of equal sets form a class; classes are joined.
2. Exact filters first. Of two similar sets each misses at most a quarter of its elements in the other, so their first
   quarter and ``t`` elements in hash order share at least ``t`` of the smaller set: classes that share fewer with the rest
   of the corpus have no partner. For the others the same is counted over whole sets: 75 % must occur elsewhere.
3. PartEnum: sizes fall into bands of ratio 4/3; two similar sets lie in one band or in two adjacent ones, and for each such
   pair of bands their symmetric difference is at most k elements. The element domain is split by hash into n1 groups of
   three parts. As n1 is more than k / 2, at least one group differs in one part at most: for every group the three subsets
   of two parts are enumerated, and each projection's hash is a signature. Similar sets share one.
   Empty projections say nothing; a set leaves them out if so few of its groups are near empty that a shared
   signature that is not empty remains certain for every partner, and emits them otherwise.
4. Within a signature's bucket not all pairs are formed. The member with the largest shared part of its set is the hub, and
   members are checked against it. After the links are contracted to components, a similar pair that is still apart has a
   member outside its hub's component; those members are checked against all others of their buckets that share one of
   the rarest quarter of their elements, as similar sets do. Pairs inside a component are redundant, so no link between
   components is lost.

Elements that many documents of a slice of rows share are counted there and sent on as one row, so frequent shingles are
aggregated before they are shuffled; joins on classes and signatures have a table on either side, so AQE can split them.

Defined results: words are cut at ASCII white space after lower-casing A-Z; with fewer than five words the whole sequence
is the one shingle; a text without words (or null) has an empty set and is linked with nothing. Repeated rows and repeated
ids are fine: every row is a document. A component's id is the least document id in it; null ids are ignored for that, and
a component of null ids only has a null id. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm import sieve
from tripflow.llm.components import components
from tripflow.llm.memory import released
from tripflow.session import durable

WORDS = 5
MORE = 0.12  # of a set's size: elements beyond the first quarter that the first filter looks at
SLICE, SLICE_BYTES = 2048, 1 << 22  # rows, and bytes of their texts or sets, that a task works on at once
PARTS, PAIRS = 3, ((0, 1), (0, 2), (1, 2))
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, as signed 64-bit integers."""
    found = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, np.int64)
    h = mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64))
    n = min(len(h), words)
    at = len(h) - n + 1
    total = np.full(at, np.uint64(n))
    for k in range(n):
        total = total * ODD[k % len(ODD)] + mixed(h[k:k + at] + np.uint64(k))
    return np.unique(mixed(total).view(np.int64))


def more(size: int) -> int:
    return max(1, int(MORE * size))


def must_share(size: int) -> int:
    """Least number of shared elements in the first part of a set of this size that has a partner."""
    return more(-(-3 * size // 4))


@functools.lru_cache(maxsize=None)
def band_end(j: int) -> int:
    """Largest size of band j: a partner of a set in band j is at most in band j + 1."""
    return 1 if j == 0 else max(band_end(j - 1) + 1, 4 * band_end(j - 1) // 3)


def band_of(size: int) -> int:
    j = 0
    while band_end(j) < size:
        j += 1
    return j


def most_different(size: int, j: int) -> int:
    """Bound of the symmetric difference between a set of this size and any partner, for pairs whose smaller set is in band j.

    A Jaccard of 3/4 means a difference of at most a seventh of both sizes, and a partner of at most 4/3 the size.
    """
    return size // 3 if size <= band_end(j) else (size + band_end(j)) // 7


@functools.lru_cache(maxsize=None)
def n_groups(j: int) -> int:
    """Groups for band j: the fewest for which sets of its sizes are expected (by 3 standard deviations) to leave out empty
    projections; in bands too small for that, the number that comes closest."""
    sizes = {(band_end(j - 1) if j else 0) + 1, band_end(j), band_end(j) + 1, band_end(j + 1)}

    def margin(n: int) -> float:
        out = []
        for a in sizes:
            empty = np.exp(-a / (PARTS * n))
            weak = n * (3 * empty ** 2 * (1 - empty) + empty ** 3)
            out.append((n - most_different(a, j) // 2 - weak) / np.sqrt(weak + 1e-9))
        return min(out)

    least = max(most_different(a, j) for a in sizes) // 2 + 1
    choices = range(least, max(least, band_end(j + 1)) + 1)
    return next((n for n in choices if margin(n) >= 3), max(choices, key=margin))


def signatures(found: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set, for the bands in which it can be the smaller or the larger set of a pair."""
    elements, size, out = found.view(np.uint64), len(found), []
    own = band_of(size)
    for j in (own - 1, own):
        if j < 0 or max(most_different(band_end(j), j), most_different(band_end(j + 1), j)) == 0:
            continue  # only equal sets are that similar
        n = n_groups(j)
        seed = mixed(np.array([j + 1], np.uint64))[0]
        h = mixed(elements ^ seed)
        part = ((h >> np.uint64(32)) * np.uint64(PARTS * n) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(PARTS * n, np.uint64)
        np.add.at(total, part, mixed(h + seed))
        filled = np.bincount(part, minlength=PARTS * n).reshape(n, PARTS) > 0
        total = total.reshape(n, PARTS)
        weak = int((filled.sum(1) < 2).sum())
        sure = n - most_different(size, j) // 2 > weak
        for k, (a, b) in enumerate(PAIRS):
            place = mixed(seed + np.arange(n, dtype=np.uint64) * np.uint64(len(PAIRS)) + np.uint64(k))
            s = mixed(total[:, a] + total[:, b] + place)
            out.append(s[filled[:, a] | filled[:, b]] if sure else s)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > SLICE or part.nbytes > SLICE_BYTES):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def _sets(texts: DataFrame, whole: bool) -> DataFrame:
    """Column ``text`` replaced by ``size``, ``c`` (hash of the set, null if empty) and ``set``: all of it or its first part."""
    rest = [c for c in texts.columns if c != "text"]
    schema = ", ".join([*(f"{c} {t}" for c, t in texts.dtypes if c != "text"), "size bigint, c bigint, set array<bigint>"])
    texts = texts.select(*rest, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(len(rest))]
            c = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            kept = sets if whole else [s[:len(s) // 4 + more(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array([len(s) for s in sets], pa.int64()), pa.array(c, pa.int64()), _lists(kept)],
                                             names=[*rest, "size", "c", "set"])

    return texts.mapInArrow(released(run), schema)


def shared_counts(sets: DataFrame) -> DataFrame:
    """``c`` and ``n``: how many elements of its ``set`` occur under another row too (rows of the same c may count as others).

    An element that several rows of a slice hold is settled for them there; one row tells the rest of the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, lists = batch.column(0).to_numpy(), batch.column(1)
            _, first = np.unique(names, return_index=True)
            lists, names = lists.take(pa.array(first)), names[first]
            owner = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy())
            values, at, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            many = times[at] > 1
            here = np.bincount(owner[many], minlength=len(names))
            told, once = values[times > 1], ~many
            own = np.flatnonzero(here)
            h = np.concatenate([values[at[once]], told, names[own]])
            c = pa.array(np.concatenate([names[owner[once]], np.zeros(len(told), np.int64), names[own]]), mask=np.repeat([False, True, False], [once.sum(), len(told), len(own)]))
            n = np.concatenate([np.ones(once.sum(), np.int32), np.full(len(told), 2, np.int32), -here[own].astype(np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(h), c, pa.array(n)], names=["h", "c", "n"])

    rows = sets.filter("c IS NOT NULL").select("c", "set").mapInArrow(released(run), "h bigint, c bigint, n int")
    everywhere = F.sum(F.greatest("n", F.lit(0))).over(Window.partitionBy("h"))  # a batch's own count (below 0) is in its row
    rows = rows.withColumn("all", everywhere).filter("c IS NOT NULL AND (n < 0 OR all > 1)")
    return rows.groupBy("c").agg(F.sum(F.abs("n")).cast("bigint").alias("n"))


def _stars(sets: DataFrame) -> DataFrame:
    """Distinct candidate pairs (x, hub): the members of each signature's bucket with its hub, the member of least ``v``.

    A bucket with several members in one slice has a hub there, and only that hub goes on to the corpus-wide bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, lists = batch.column(0).to_numpy(), batch.column(1)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()  # offsets of a slice still count from the batch's start
            signed = [np.unique(signatures(values[a:b])) for a, b in zip(ends[:-1], ends[1:])]
            v, sig = np.repeat(names, [len(s) for s in signed]), np.concatenate([*signed, np.zeros(0, np.int64)])
            order = np.lexsort((v, sig))
            v, sig = v[order], sig[order]
            leads = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
            hub = v[leads][np.cumsum(leads) - 1]
            local = np.unique(np.stack([v[~leads], hub[~leads]], 1), axis=0)
            member = np.concatenate([v[leads], local[:, 0]])
            known = pa.array(np.concatenate([v[leads], local[:, 1]]), mask=np.arange(len(member)) < leads.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[leads], local[:, 0]])), pa.array(member), known], names=["sig", "x", "hub"])

    rows = sets.select("v", "set").mapInArrow(released(run), "sig bigint, x bigint, hub bigint")
    to_here = Window.partitionBy("sig", F.col("hub").isNull()).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("first", F.first("x").over(to_here))
    return rows.select("x", F.coalesce("hub", "first").alias("hub")).filter("x <> hub").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets have a Jaccard of 0.75 or more."""
    def side(col: str, *attributes: str) -> DataFrame:
        return sets.select(F.col("v").alias(col), *[F.col(a).alias(f"{col}_{a}") for a in attributes])

    # the intersection that the sizes ask for must fit into what either set shares with anything
    p = pairs.join(side("x", "size", "n"), "x").join(side("y", "size", "n"), "y")
    p = p.filter("3 * (x_size + y_size) <= 7 * least(x_n, y_n)").select("x", "y")
    p = p.join(side("x", "set"), "x").join(side("y", "set"), "y")
    both = F.size(F.array_intersect("x_set", "y_set"))
    either = F.size("x_set") + F.size("y_set") - both
    return p.withColumn("hit", 100 * both >= 75 * either).filter("hit").select("x", "y")


def _open(stars: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that are not in the component of their bucket's hub, and all members of such buckets (column v)."""
    comp = [label.select(F.col("v").alias(c), F.col("comp").alias(f"{c}_comp")) for c in ("x", "hub")]
    seen = stars.join(comp[0], "x", "left").join(comp[1], "hub", "left")
    seen = durable(seen.filter("coalesce(x_comp, x) <> coalesce(hub_comp, hub)").select("x", "hub"), "jaccard-open")

    def members(hubs: DataFrame) -> DataFrame:
        return stars.join(hubs.select(F.col("v").alias("hub")), "hub", "left_semi").select(F.col("x").alias("v"))

    apart = seen.select(F.col("x").alias("v")).distinct()
    # an open member may be a batch's hub, whose members then are open too
    apart = durable(apart.union(members(apart)).distinct(), "jaccard-apart")
    hubs = seen.select(F.col("hub").alias("v"))
    hubs = durable(hubs.union(stars.join(hubs.select(F.col("v").alias("x")), "x", "left_semi").select("hub")).distinct(), "jaccard-hubs")
    below = durable(members(hubs).union(hubs).distinct(), "jaccard-members")
    return apart, durable(below.union(members(below)).union(apart).distinct(), "jaccard-members")


def _rest(stars: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) still to check: one is open, they lie in different components and share one of the rarest quarter of
    their elements (by count among the members of open buckets), as similar sets do."""
    apart, among = _open(stars, label)
    e = sets.join(among, "v", "left_semi").select("v", "size", F.explode("set").alias("h"))
    often = e.groupBy("h").count().filter("count > 1")
    e = e.join(durable(often, "jaccard-often"), "h")
    mine = Window.partitionBy("v")
    place = F.row_number().over(mine.orderBy("count", "h")) + F.col("size") - F.count(F.lit(1)).over(mine)
    e = e.withColumn("place", place).filter(F.col("place") <= F.floor(F.col("size") / 4) + 1)
    e = e.join(label, "v", "left").select("h", "v", "size", "place", F.coalesce("comp", "v").alias("comp"))
    e = durable(e, "jaccard-rare")
    a, b = e.join(apart, "v", "left_semi").alias("a"), e.alias("b")
    # the rarest common element and what follows it must hold the intersection that the sizes ask for
    room = "3 * (a.size + b.size) <= 7 * (1 + least(a.size - a.place, b.size - b.place))"
    met = a.join(b, "h").filter(f"a.comp <> b.comp AND {room}")
    return met.select(F.least("a.v", "b.v").alias("x"), F.greatest("a.v", "b.v").alias("y")).distinct()


def similar(sets: DataFrame) -> DataFrame:
    """``v`` and ``comp``: the components of all sets that have a similar one. ``sets``: v, size, n (shared elements), set."""
    stars = durable(_stars(sets), "jaccard-stars")
    first = durable(_verified(stars.select("x", F.col("hub").alias("y")), sets), "jaccard-links")
    label = durable(components(first).select(F.col("node").alias("v"), F.col("root").alias("comp")), "jaccard-labels")
    tested = stars.select(F.least("x", "hub").alias("x"), F.greatest("x", "hub").alias("y"))
    rest = durable(_rest(stars, label, sets).join(tested, ["x", "y"], "left_anti"), "jaccard-rest")
    more_ = _verified(rest, sets)
    both = label.select(F.col("v").alias("x"), F.col("comp").alias("y")).unionByName(more_)
    return components(both).select(F.col("node").alias("v"), F.col("root").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``.

    ``keyed``: also ``key``, the hash of id and text, and ``first``, the least (id, key) of the component among rows with an
    id; null where there is none or the text has no shingles.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    heads = durable(_sets(rows, whole=False), "jaccard-heads")
    classes = heads.filter("c IS NOT NULL").groupBy("c").agg(F.max("size").alias("size"), F.min("key").alias("key"), F.min("id").alias("id"),
                                                            *[F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key"))).alias("first")] * keyed)
    also = ["first"] * keyed
    classes = durable(classes, "jaccard-classes")
    need = F.greatest(F.lit(1), F.floor(F.lit(MORE) * F.ceil(3 * F.col("size") / 4)))
    alive = durable(classes.join(shared_counts(heads), "c").filter(F.col("n") >= need).select("key"), "jaccard-alive")

    texts = sieve.only(rows.select("key", "text"), alive, "key").dropDuplicates(["key"])
    whole = durable(_sets(texts.select("text"), whole=True), "jaccard-sets")
    sets = whole.join(shared_counts(whole), "c").filter("4 * n >= 3 * size")
    # from here on sets go by a number whose order prefers those of which the largest part is shared: copies of them are near
    rank = F.floor((F.col("size") - F.col("n")) * 1000 / F.col("size")).cast("long")
    sets = durable(sets.withColumn("v", F.shiftleft(rank, 53) + F.monotonically_increasing_id()), "jaccard-sets")

    label = durable(similar(sets).join(sets.select("v", "c"), "v").join(classes.select("c", "id", *also), "c"), "jaccard-labels")
    least = durable(label.groupBy("comp").agg(F.min("id").alias("component_id"), *[F.min(c).alias(f"least_{c}") for c in also]), "jaccard-components")
    of_class = classes.join(label.join(least, "comp").select("c", "component_id", *[f"least_{c}" for c in also]), "c", "left")
    of_class = durable(of_class.select("c", F.coalesce("component_id", "id").alias("component_id"), *[F.coalesce(f"least_{c}", c).alias(c) for c in also]), "jaccard-components")
    linked = heads.filter("c IS NOT NULL").join(of_class, "c").select("id", F.col("size").alias("n_shingles"), "component_id", *["key", "first"] * keyed)
    empty = heads.filter("c IS NULL").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"), *["key"] * keyed)
    return linked.unionByName(empty, allowMissingColumns=keyed)
