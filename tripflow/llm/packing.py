"""Cost-balanced packing of documents into sequences of a fixed token capacity.

A task walks its rows in blocks of at most ``block_tokens``. Whole capacities are cut off long documents first. What
remains has the estimated attention cost n + n**2 / capacity; in descending order each document goes to the sequence of
lowest cost that still has room. A block opens ceil(tokens / capacity) sequences; documents that fit nowhere whole are
cut into the gaps that are left, so a block pads less than one sequence. Nothing is shuffled, memory is one block (or one
document), and a task that runs again over the same input split makes the same sequences.

Defined results: a null or empty text is its end token alone; every document, repeated or with a null id, is packed;
an empty table has no pieces. Extra columns are ignored. Sequence ids carry the number of the input split in their upper
bits, so they are unique but not gapless. The number travels with the rows: a reader that coalesces the pieces puts several
splits into one task, which starts a new block with each.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm import bpe
from tripflow.llm.memory import released

CAPACITY, BLOCK_TOKENS, END_ID, LOCAL_BITS = 2048, 1 << 20, 1, 36


def cost(n: int, capacity: int = CAPACITY) -> float:
    return n + n * n / capacity


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one block, and its number of sequences."""
    pieces, rest, used = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        pieces += [(doc, k * capacity, capacity, used + k, 0) for k in range(whole)]
        used += whole
        if n % capacity:
            rest.append((n % capacity, doc, whole * capacity))
    if not rest:
        return pieces, used
    rest.sort(key=lambda r: (-cost(r[0], capacity), r[1]))
    m = -(-sum(r[0] for r in rest) // capacity)
    fill = [0] * m
    open_ = [(0.0, s) for s in range(m)]  # a heap: equal costs in order of sequence
    homeless = []
    for n, doc, start in rest:
        full = []
        while open_ and fill[open_[0][1]] + n > capacity:
            full.append(heapq.heappop(open_))
        if open_:
            c, s = open_[0]
            pieces.append((doc, start, n, used + s, fill[s]))
            fill[s] += n
            heapq.heapreplace(open_, (c + cost(n, capacity), s))
        else:
            homeless.append((n, doc, start))
        for x in full:
            if fill[x[1]] < capacity:
                heapq.heappush(open_, x)
    gaps = sorted(((capacity - f, s) for s, f in enumerate(fill) if f < capacity), reverse=True)
    for n, doc, start in homeless:
        while n:
            room, s = gaps.pop(0)
            take = min(n, room)
            pieces.append((doc, start, take, used + s, fill[s]))
            fill[s], n, start = fill[s] + take, n - take, start + take
            if take < room:
                gaps.insert(0, (room - take, s))
    return pieces, used + m


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY,
           block_tokens: int = BLOCK_TOKENS, keep_ids: bool = False, memo_entries: int = bpe.MEMO_ENTRIES,
           keep_vocabulary: bool = True) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked for, ``ids``.

    ``memo_entries`` trades a task's memory (about 200 bytes each) for time, and so does ``keep_vocabulary`` (the process reads
    it once, not once a task); neither changes the result.
    """
    kind = dict(docs.dtypes)[id_col]
    end = bpe.packed([END_ID])

    def flush(block: list, first: int, id_type: pa.DataType) -> tuple[pa.RecordBatch, int]:
        pieces, n = pack([len(ids) // 4 for _, ids in block], capacity)
        parts = [block[d][1][4 * s:4 * (s + k)] for d, s, k, _, _ in pieces]
        cols = [pa.array([block[p[0]][0] for p in pieces], id_type), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array([len(block[p[0]][1]) // 4 for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            cols, names = [*cols, pa.array([list(memoryview(x).cast("I")) for x in parts], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names=names), first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        encoder.memo_entries = memo_entries
        first, split, block, tokens, id_type = 0, None, [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            texts = encoder.encode_all(text.as_py() for text in batch.column(1))
            for key, ids, at in zip(batch.column(0), texts, batch.column(2).to_pylist()):
                ids += end
                if block and (at != split or tokens + len(ids) // 4 > block_tokens):
                    out, first = flush(block, first, id_type)
                    yield out
                    block, tokens = [], 0
                if at != split:
                    split, first = at, at << LOCAL_BITS
                block.append((key.as_py(), ids))
                tokens += len(ids) // 4
        if block:
            yield flush(block, first, id_type)[0]
        encoder.forget()  # the process serves other tasks
        if not keep_vocabulary:
            bpe.load.cache_clear()

    schema = (f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
              + (", ids array<int>" if keep_ids else ""))
    return docs.select(id_col, text_col, F.spark_partition_id()).mapInArrow(released(run), schema)
