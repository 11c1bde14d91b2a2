"""Periodic runs of words: seeds of guaranteed overlap, extended along their lag.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
``least`` words and ``times * q`` (``times`` from 2 on). At lag q its words match over a stretch of at least max(least, times * q) - q words.

1. Lags go in levels. The lags from q0 on have a guaranteed overlap of k words (the least of these lengths), and the level
   serves the lags up to k: q0 = 1, k = 5; q0 = 6, k = 18; q0 = 19, k = 57 and so on for the default limits.
2. The k-grams of a level are named exactly: a word is named by its first place in its document, a longer gram by the pair
   of the names of two grams that cover it. A gram that occurs once in its document is in no longer match and gets no name,
   so later levels only look at what is left.
3. The seeds of a level are the neighbouring occurrences of one gram in one document whose distance is a lag of the level.
   Neighbours are enough: a gram of k >= q words occurs in a run of smallest period q at every q-th word and nowhere between,
   and for the same reason the distance of neighbours that overlap or touch is the smallest period of what they span.
4. Each seed is extended to both sides word by word along its lag. A table holds per lag how far extension has come, so a
   stretch is extended once, however many seeds lie in it. (The lengths of all stretches add up to O(n log n).)

Words of different documents have different names, so a block of many documents is done at once and nothing crosses a
border. A document is one task's memory; nothing is shuffled.

Defined results: words are cut at ASCII white space, nothing is lower-cased; a null, empty or blank text has no words and no
runs; rows are independent, so repeated rows and ids or null ids do no harm; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.memory import released

LEAST, TIMES = 6, 4
BLOCK_WORDS = 1 << 18  # documents are done together up to so many words; a longer one on its own
STRIDE = 64  # words compared at first when a seed is extended; doubled each time

Run = tuple[int, int, int]  # start, length, period


def rewritten(text: Column, words_from: Column, period: Column) -> Column:
    """The words of ``text``, joined by a blank, with every word from ``words_from`` on repeating the first ``period`` of them."""
    words = F.array_remove(F.split(text, "[ \t-\r]+"), "")
    rest = F.size(words) - words_from
    copies = F.array_repeat(F.slice(words, words_from + 1, period), F.ceil(rest / period).cast("int"))
    return F.array_join(F.concat(F.slice(words, F.lit(1), words_from), F.slice(F.flatten(copies), F.lit(1), rest)), " ")


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per pair of names; -1 where a part has no name or the pair occurs once only."""
    out = np.full(len(left), -1, np.int64)
    at = np.flatnonzero((left >= 0) & (right >= 0))
    if len(at):
        _, name, times = np.unique(left[at] * (int(right.max()) + 1) + right[at], return_inverse=True, return_counts=True)
        out[at] = np.where(times[name] > 1, name, -1)
    return out


def _longer(names: np.ndarray, have: int, want: int) -> np.ndarray:
    """Names of the grams of ``want`` words from those of ``have`` words."""
    while have < want:
        step = min(have, want - have)
        right = np.full(len(names), -1, np.int64)
        right[:-step] = names[step:]
        names, have = _named(names, right), have + step
    return names


def guaranteed(first: int, least: int, times: int) -> int:
    """Words over which every run of a period from ``first`` on matches at its lag."""
    turn = least // times  # up to here the least length decides
    return min(max(least, times * q) - q for q in {first, max(first, turn), max(first, turn + 1)})


def _reach(words: np.ndarray, at: int, lag: int, way: int) -> int:
    """The first place from ``at`` on, going up (way 1) or down (-1), whose word does not equal the one ``lag`` words later."""
    end = len(words) - lag if way > 0 else -1
    stride = STRIDE
    while at != end:
        far = min(at + stride, end) if way > 0 else max(at - stride, end)
        a, b = (at, far) if way > 0 else (far + 1, at + 1)
        other = np.flatnonzero(words[a:b] != words[a + lag:b + lag])
        if len(other):
            return a + int(other[0 if way > 0 else -1])
        at, stride = far, 2 * stride
    return at


def runs_of(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> Iterator[Run]:
    """Runs of a block of documents. ``words``: the place of a word's first occurrence in its document; ``longest``: words of the longest document."""
    names, have, first = words, 1, 1
    while times * first <= longest and (names >= 0).any():
        overlap = guaranteed(first, least, times)
        names, have = _longer(names, have, overlap), overlap
        places = np.flatnonzero(names >= 0)
        places = places[np.argsort(names[places], kind="stable")]
        lag = np.diff(places)
        near = (np.diff(names[places]) == 0) & (lag >= first) & (lag <= overlap)
        seeds, lags = places[:-1][near], lag[near]
        order = np.argsort(seeds, kind="stable")
        covered: dict[int, int] = {}
        for i, q in zip(seeds[order].tolist(), lags[order].tolist()):
            if i < covered.get(q, 0):
                continue
            end = _reach(words, i + overlap, q, 1) if i + overlap + q < len(words) else i + overlap
            covered[q] = end
            start = _reach(words, i, q, -1) + 1
            if end + q - start >= max(least, times * q):
                yield start, end + q - start, q
        first = overlap + 1


def _block(texts: list[list[bytes]], least: int, times: int) -> list[tuple[list[Run], bytes]]:
    """Per document its runs, by start and period, and the words outside of repetitions."""
    codes: list[int] = []
    ends = [0]
    for words in texts:
        own: dict[bytes, int] = {}
        codes.extend(map(own.setdefault, words, count(len(codes))))
        ends.append(len(codes))
    block, borders = np.array(codes, np.int64), np.array(ends)
    found: dict[int, list[Run]] = {}
    gone = np.zeros(len(block) + 1, np.int64)
    for start, length, period in runs_of(block, max(map(len, texts), default=0), least, times):
        doc = int(np.searchsorted(borders, start, "right")) - 1
        found.setdefault(doc, []).append((start - ends[doc], length, period))
        gone[start + period] += 1
        gone[start + length] -= 1
    dropped = np.cumsum(gone) > 0
    out = []
    for k, words in enumerate(texts):
        runs = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
        if runs:
            lost = dropped[ends[k]:ends[k + 1]].tolist()
            words = [w for w, x in zip(words, lost) if not x]
        out.append((runs, b" ".join(words)))
    return out


def _strongest(runs: list[Run]) -> Run | tuple[None, None, None]:
    """The run of greatest exact length / period; ``runs`` are in order of start and period, the first of equals counts."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best or (None, None, None)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  block_words: int = BLOCK_WORDS, keep: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_runs``, the strongest run (``start``, ``length``, ``period``, ``exponent_milli``),
    ``runs_sha256``, ``collapsed_sha256`` and, if ``keep``, ``runs`` (all of them) and ``collapsed`` (the text without repetitions)."""
    kind = dict(docs.dtypes)[id_col]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def told(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        done = _block(texts, least, times)
        best = [_strongest(runs) for runs, _ in done]
        listed = ["".join(f"{s},{n},{p}\n" for s, n, p in runs).encode() for runs, _ in done]
        cols = [pa.concat_arrays(ids), pa.array([len(runs) for runs, _ in done], pa.int64()),
                *[pa.array([b[j] for b in best], pa.int64()) for j in range(3)],
                pa.array([b[1] and 1000 * b[1] // b[2] for b in best], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for _, x in done], pa.string())]
        names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        if keep:
            every = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs, _ in done]
            cols, names = [*cols, pa.array(every, run_type), pa.array([x for _, x in done], pa.binary()).cast(pa.string())], [*names, "runs", "collapsed"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, since = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()  # bytes are split at ASCII white space only
                if texts and size + len(words) > block_words:
                    yield told([batch.column(0).slice(since, k - since)], texts)
                    texts, size, since = [], 0, k
                texts.append(words)
                size += len(words)
            if texts:
                yield told([batch.column(0).slice(since)], texts)

    schema = (f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
              + (", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" if keep else ""))
    return docs.select(id_col, text_col).mapInArrow(released(work), schema)
