"""BPE with word ends, encoded and decoded without a tokenizer library.

A word keeps its parts and the ranks of adjacent pairs in one contiguous row: the minimum of the row is scanned for, its
boundary deleted and the two neighbouring ranks refreshed, until no pair of the row has a rank. Rows of words of one
length stand below each other in a matrix, so a step merges one pair in each of up to ``ROWS`` words at once. Words longer
than ``SHORT`` bytes use a heap over the same ranks, which makes the same merges without the quadratic scan. Words recur,
so each task keeps a bounded memo of encoded words and of the stretches between white space.

The vocabulary file is read from a path where the tasks run. It must be a BPE over byte letters with an end-of-word suffix
and the splitting rule below; anything else is refused.

Defined results: a null text has no tokens. The file's added tokens are taken out of the raw text first, exact case.
Decoding joins the tokens by blanks, as the file has no decoder.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

SHORT, ROWS, MEMO_ENTRIES, NO_RANK, ADDED = 64, 4096, 1 << 19, (1 << 31) - 1, "A"

# Fixed values of the file format: white space of the splitting rule, the rule itself, and the letters that stand for bytes.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The letter of every byte: itself where printable, else the next free code point from 256."""
    spare = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or split[0]["pattern"]["Regex"] != RULE or normal != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or len(model["vocab"]) >= 1 << 16:
            raise ValueError("this file needs another splitting or joining rule")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank = {a << 16 | b: rank for rank, (a, b, _) in enumerate(pairs)}
        self.made = np.array([c for _, _, c in pairs], np.uint32)  # by rank
        letters = byte_letters()
        self.inner = np.array([self.vocab[x] for x in letters], np.uint32)  # of a byte, within a word and at its end
        self.final = np.array([self.vocab[x + self.suffix] for x in letters], np.uint32)
        keys = np.fromiter(self.rank, np.uint32, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks_of = np.append(keys[order], np.uint32(0xFFFFFFFF)), np.append(order, NO_RANK).astype(np.int32)
        self.find = regex.compile(RULE.replace(r"\s", SPACE)).findall
        self.find_marked = regex.compile(RULE.replace(r"\s", SPACE) + "|\n").findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.memo: dict[str, bytes] = {}
        self.memo_entries = MEMO_ENTRIES

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks_of[at], np.int32(NO_RANK))

    def _equal_lengths(self, words: list[str], raw: bytes, n: int, out: dict[str, bytes]) -> None:
        """Encode words of ``n`` bytes each, whose bytes stand one after the other in ``raw``."""
        letters = np.frombuffer(raw, np.uint8).reshape(-1, n)
        ids = self.inner[letters]
        ids[:, -1] = self.final[letters[:, -1]]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        which = np.arange(len(words))
        while len(which):
            if ids.shape[1] > 1:
                at = ranks.argmin(1)
                low = ranks[np.arange(len(at)), at]
                done = low == NO_RANK
            else:
                done = np.ones(len(which), bool)
            if done.any():
                width, bytes_ = 4 * ids.shape[1], ids[done].astype("<u4").tobytes()
                for k, w in enumerate(which[done].tolist()):
                    out[words[w]] = bytes_[k * width:(k + 1) * width]
                go = ~done
                which, ids, ranks = which[go], ids[go], ranks[go]
                if not len(which):
                    return
                at, low = at[go], low[go]
            rows, n_ids = np.arange(len(which)), ids.shape[1]
            new = self.made[low]
            ids[rows, at] = new
            col = np.arange(n_ids - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, col[:-1] + (col[:-1] >= at[:, None]), 1)
            has = at > 0
            ranks[rows[has], at[has] - 1] = self._ranks(ids[rows[has], at[has] - 1], new[has])
            has = at < n_ids - 2
            ranks[rows[has], at[has]] = self._ranks(new[has], ids[rows[has], at[has] + 1])

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8")
            if len(raw) > SHORT:
                letters = np.frombuffer(raw, np.uint8)
                out[w] = packed(self._long([*self.inner[letters[:-1]].tolist(), int(self.final[letters[-1]])]))
            else:
                if (group := by_length.get(len(raw))) is None:
                    group = by_length[len(raw)] = [], []
                group[0].append(w)
                group[1].append(raw)
        for n, (group, raws) in by_length.items():
            for k in range(0, len(group), ROWS):
                self._equal_lengths(group[k:k + ROWS], b"".join(raws[k:k + ROWS]), n, out)
        return out

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or self.rank.get(ids[i] << 16 | ids[j]) != low:
                continue  # one of the two parts has been merged since
            ids[i], ids[j], right[i] = int(self.made[low]), -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := self.rank.get(ids[x] << 16 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [x for x in ids if x >= 0]

    def _parts(self, text: str) -> list[str]:
        """The text between added tokens, in normal form and lower case; added tokens are marked by a capital, which no such text has."""
        out = []
        for k, part in enumerate(self.cut(text) if self.cut and "<" in text else [text]):
            if k % 2:
                out.append(ADDED + part)
                continue
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            # letter by letter where the whole-string rule would look at a sigma's neighbours
            out.append("".join(map(str.lower, part)) if "Σ" in part else part.lower())
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers; texts are taken a few million characters at a time."""
        group, size = [], 0
        for text in texts:
            group.append(self._parts(text or ""))
            size += len(text or "")
            if size >= 4 * self.memo_entries:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        """Words never cross white space, so each different stretch between white space is encoded once."""
        parts = pa.array([*chain.from_iterable(group)], pa.string())
        stretches = pc.ascii_split_whitespace(parts)
        coded = stretches.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        memo = self.memo
        unknown = {c for c in chunks if c not in memo}
        plain = {c for c in unknown if c.isalpha()}  # one word of letters
        rest = [*(unknown - plain)]
        found = self.find_marked("\n".join([*rest, ""]))
        words, own, at = self._learn(plain.union(found) - {"\n"}), [], 0
        memo.update((c, words[c]) for c in plain)
        for w in found:
            if w != "\n":
                own.append(words[w])
                continue
            chunk = rest[at]
            memo[chunk] = packed([self.added[chunk[1:]]]) if chunk.startswith(ADDED) else own[0] if len(own) == 1 else b"".join(own)
            own, at = [], at + 1
        ids = [*map(memo.__getitem__, chunks)]
        # lay the ids of all stretches one after the other
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        order = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[order]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = pool[np.repeat(first[order] - ends[:-1], n) + np.arange(ends[-1])]
        of_part = ends[stretches.offsets.to_numpy()]
        at = 0
        for own_parts in group:
            yield flat[of_part[at]:of_part[at + len(own_parts)]].tobytes()
            at += len(own_parts)
        if len(self.memo) > self.memo_entries:
            self.forget()

    def forget(self) -> None:
        """Keep only what was met first, which is what is met most."""
        self.memo = dict(islice(self.memo.items(), self.memo_entries // 4))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def packed(ids: Iterable[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@functools.lru_cache(maxsize=4)
def load(path: str | None = None) -> WordBpe:
    """The encoder of this task's process, read once."""
    return WordBpe(path or default_path())


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` as array<int>."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, raw, said, all_ids = [], [], [], []
            for ids in bpe.encode_all(text.as_py() for text in batch.column(1)):
                numbers = np.frombuffer(ids, "<u4").tolist()
                n.append(len(numbers))
                raw.append(hashlib.sha256(ids).hexdigest())
                said.append(hashlib.sha256(bpe.decode(numbers).encode("utf-8")).hexdigest())
                if keep_ids:
                    all_ids.append(numbers)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.string()), pa.array(said, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        bpe.forget()  # the process serves other tasks

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
