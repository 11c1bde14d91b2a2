"""Exact top-k by integer inner product with a bit-sliced index.

Every component x becomes floor(scale * x). Rows are indexed in blocks where they lie: each attribute (vector component)
is quantised to at most ``SLICES`` bits above the block's minimum and stored as bitmaps over the block's rows, next to the
exact integers. A query is quantised to ``WEIGHT_BITS`` bits; its weighted sum over all attributes is formed for all rows of
a block at once by carry-save addition of bitmaps (attributes with a negative weight enter complemented). The k-th largest
sum is found from the most significant slice downward; rows whose sum is within the proven quantisation error of it are
the boundary, and their scores are computed exactly from the integers.

The query set meets the blocks in blocks: index blocks are dealt over ``groups`` and every block of queries is sent to each
group once. A task gives at most k rows per query and block, which are merged by a window with a map-side limit.

Defined results: vectors that are null or empty, or hold a null or a non-finite component, take no part. Only vectors of one
length are compared. A row never is its own candidate; rows of the query's id are not either. A query id that repeats is
asked once, with its smallest vector; a candidate row that repeats is listed as often as it occurs. Equal scores are ordered
by id. Rows with a null id take no part. Components beyond 2**61 and scores beyond a long are set to
the end of the range. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.session import durable

BLOCK_ROWS, QUERY_ROWS, SLICES, WEIGHT_BITS = 16384, 256, 7, 5
LONG = 1 << 63


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(vectors: pa.Array, dim: int, scale: float) -> np.ndarray:
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return np.clip(flat, -(2.0 ** 61), 2.0 ** 61).astype(np.int64).reshape(-1, dim)


def _blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows of (dim, n, ids, values): up to ``size`` vectors of one length each, made where the rows lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int, at_least: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(dim)
            ids, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            while len(ids) >= max(at_least, 1):
                yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(ids[:size])]), pa.array([ids[:size].tobytes()], pa.binary()),
                                                  pa.array([values[:size].tobytes()], pa.binary())], names=["dim", "n", "ids", "values"])
                ids, values = ids[size:], values[size:]
            if len(ids):
                held[dim] = [(ids, values)]

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                held.setdefault(dim, []).append((part.column(0).to_numpy(), integers(part.column(1), dim, scale)))
                if sum(len(p[0]) for p in held[dim]) >= size:
                    yield from flush(dim, size)
        for dim in list(held):
            yield from flush(dim, 1)

    return rows.mapInArrow(run, "dim bigint, n bigint, ids binary, values binary")


class Block:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, (n, dim) = ids, values, values.shape
        self.low = values.min(0)
        above = (values - self.low).astype(np.float64)
        self.shift = max(0, int(above.max()).bit_length() - SLICES)
        quant = ((values - self.low) >> self.shift).astype(np.uint8)
        self.n_slices = SLICES
        padded = np.zeros((dim, SLICES, -(-n // 64) * 64), np.uint8)
        for b in range(SLICES):
            padded[:, b, :n] = (quant.T >> b) & 1
        self.slices = np.packbits(padded, axis=2, bitorder="little").view(np.uint64).reshape(dim * SLICES, -1)
        valid = np.zeros(padded.shape[2], np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        # how far rows lie from the block's centre, and what quantising took from them: the two norms of the error bound
        rest = above - quant * 2.0 ** self.shift
        self.spread = float(np.sqrt(((above - above.mean(0)) ** 2).sum(1).max()))
        self.lost = float(np.sqrt(((rest - (2.0 ** self.shift - 1) / 2) ** 2).sum(1).max()))
        self.order = np.argsort(ids, kind="stable")

    def _sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the weighted sum over all attributes, least significant first."""
        levels: dict[int, list[np.ndarray]] = {}
        size, slice_ = np.abs(weights), np.arange(self.n_slices)
        for j in range(int(size.max()).bit_length()):
            dims = np.flatnonzero(size >> j & 1)
            flip = np.where(weights[dims] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
            for b in slice_ if len(dims) else ():
                levels.setdefault(j + int(b), []).append(self.slices[dims * self.n_slices + b] ^ flip)
        out, level = [], 0
        while level <= max(levels):
            x = np.concatenate(levels.get(level, [self.valid[None] & np.uint64(0)]))
            carries = []
            while len(x) > 1:
                k = len(x) // 3
                if k:
                    a, b, c = x[:k], x[k:2 * k], x[2 * k:3 * k]
                    ab = a ^ b
                    carries.append(a & b | c & ab)
                    x = np.concatenate([ab ^ c, x[3 * k:]])
                else:
                    carries.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            if carries:
                levels.setdefault(level + 1, []).extend(carries)
            out.append(x[0])
            level += 1
        return out

    def boundary(self, query: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Positions of all rows that can be among the k best, but for ``own``."""
        take = max(0, int(np.abs(query).max()).bit_length() - WEIGHT_BITS)
        weights = np.round(query / 2.0 ** take).astype(np.int64)
        alive = self.valid.copy()
        for p in own.tolist():
            alive[p // 64] &= ~(np.uint64(1) << np.uint64(p % 64))
        if not weights.any() or int(np.bitwise_count(alive).sum()) <= k:
            return _positions(alive)
        total = self._sum(weights)
        best, even, value = alive & np.uint64(0), alive, 0
        for i in range(len(total) - 1, -1, -1):
            more = best | even & total[i]
            n = int(np.bitwise_count(more).sum())
            if n >= k:  # the k-th row has this bit
                even, value = even & total[i], value | 1 << i
            else:
                best, even = more, even & ~total[i]
        kept = weights * 2.0 ** take
        error = np.linalg.norm(kept) * self.lost + np.linalg.norm(query - kept) * self.spread
        least = value - int(2 * error * (1 + 1e-9) / 2.0 ** (take + self.shift)) - 1
        return _positions(alive if least <= 0 else alive & _at_least(total, least))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows (fewer if there are fewer)."""
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1], sorter=self.order)
        at = self.boundary(query, k, self.order[lo:hi])
        score = _scores(self.values[at], query)
        first = np.lexsort((self.ids[at], -score))[:k] if score.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-score[i], self.ids[at[i]]))[:k], np.int64)
        return self.ids[at[first]], np.array([min(max(int(s), -LONG), LONG - 1) for s in score[first]], np.int64)


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _at_least(total: list[np.ndarray], least: int) -> np.ndarray:
    above, equal = total[0] & np.uint64(0), ~(total[0] & np.uint64(0))
    if least >> len(total):
        return above
    for i in range(len(total) - 1, -1, -1):
        if least >> i & 1:
            equal = equal & total[i]
        else:
            above, equal = above | equal & total[i], equal & ~total[i]
    return above | equal


def _scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles or longs where they hold every partial sum, else in whole numbers of any size."""
    if not len(values):
        return np.zeros(0, np.int64)
    bound = float(np.abs(values).max()) * float(np.abs(query.astype(np.float64)).sum())
    if bound < 2 ** 53:
        return (values.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return values @ query if bound < 2 ** 62 else values.astype(object) @ query.astype(object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for each row of ``queries`` against all of ``vectors``."""
    def slim(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))

    spark = vectors.sparkSession
    index = durable(_blocks(slim(vectors), BLOCK_ROWS, scale), "topk-index")
    asked = durable(_blocks(slim(queries).groupBy("id").agg(F.min("v").alias("v")), QUERY_ROWS, scale), "topk-queries")
    groups = max(1, min(index.count(), 4 * spark.sparkContext.defaultParallelism))
    index = index.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("q_group"))
    met = index.join(asked, (F.col("group") == F.col("q_group")) & (F.col("dim") == F.col("q_dim")))
    met = met.select("dim", "ids", "values", "q_ids", "q_values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for dim, ids, values, q_ids, q_values in zip(*[c for c in batch.columns]):
                dim, raw = dim.as_py(), ids.as_py()
                if raw != last:
                    last, block = raw, Block(np.frombuffer(raw, np.int64), np.frombuffer(values.as_py(), np.int64).reshape(-1, dim))
                names, asked_values = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(q_values.as_py(), np.int64).reshape(-1, dim)
                found = [block.top(int(q), v, k) for q, v in zip(names, asked_values)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])),
                                                  pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    some = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
