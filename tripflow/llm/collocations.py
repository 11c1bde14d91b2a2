"""Phrases that stand together more often than their parts would: best-first growth behind admissible bounds.

A phrase of 2 to ``most_words`` words that occurs a >= ``least`` times scores floor(1000 * a * n / (l * r)) at its weakest cut into
a first part (l times) and a rest (r times), n words in the language. Since l and r are at least a, no phrase scores more
than 1000 * n over the count of its first word, nor of its last: counts of prefixes, and of suffixes alike, bound all growth.

1. Texts become blocks of word codes (one language and task each, with the block's own dictionary), written once. Marks that
   end a piece are a word of their own, of count 0, which no phrase contains.
2. The frontier opens in the order of the bound, so by ascending count of words: a round expands words until they make up the
   next of ``SHARES`` of all words of the language. Expanding grows phrases one word a pass from expanded first words to the
   right and from expanded last words to the left, and only where all words and the known shorter parts are frequent.
   Phrases whose both ends are expanded then have the counts of all their first parts, rests and one-word extensions.
3. A phrase inside a longer one of the same count is dropped. It is enough to look one word further: what lies between has
   the same count too.
4. A language is settled when its ``top``-th surviving score is above the bound of all that is not expanded (a tie is not
   enough), or when everything is expanded. Other languages go on.

What is frequent is passed to the tasks as bitmaps of 2**``bits`` bits, whatever the size of the corpus; they only prune: a
wrong hit costs work, is counted and falls below ``least``. Counts are exact sums over words and phrases as strings, made
per block and task before they are shuffled. Nothing is collected but these bitmaps and the number of open languages.

Defined results: A-Z are lower-cased; a null or empty text has no words; a null language is ``und``, together with a language
of that name; repeated rows count as often as they stand; a text of any length is in one block; an empty table gives an empty
result. Columns other than language and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripflow.llm.memory import released
from tripflow.llm.partenum import mixed
from tripflow.llm.sieve import PAGE
from tripflow.session import durable

LEAST, MOST_WORDS, TOP, UNKNOWN = 100, 5, 2000, "und"
SHARES = (1 / 16, 1 / 4, 1.0)
BLOCK_BYTES, BITS = 1 << 21, 25
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BIG = "decimal(38,0)"

# Marks that end a piece.
MARKS = ".,;:!?\n\x0b\x0c\r"
END = b"."
_SAME = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + MARKS.encode(), b"abcdefghijklmnopqrstuvwxyz " + END * len(MARKS))
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with ``END`` wherever a piece ends, and after the last."""
    return ((text or "").encode().translate(_SAME) + END).replace(END, b" . ").split(b" ")


def _blocks(docs: DataFrame, lang_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Rows of (lang, words, hashes, times, codes): a block's dictionary and its words as 32-bit codes. Code 0 is the end of a piece."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))

    def coded(lang: str, texts: list[str]) -> pa.RecordBatch:
        own: dict[bytes, int] = defaultdict(count().__next__)
        for w in (END, b""):  # codes 0 and 1; two blanks in a row make an empty word
            own[w]
        found = [np.fromiter(map(own.__getitem__, t), np.int32, len(t)) for t in map(tokens, texts)]
        codes = np.concatenate(found)
        codes = codes[codes != 1]
        codes = np.where(codes > 1, codes - 1, codes).astype(np.int32)
        words = [END, *list(own)[2:]]
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64).view(np.int64)
        times = np.bincount(codes, minlength=len(words))
        times[0] = 0
        lists = [pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([hashes], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), *lists, pa.array([codes.tobytes()], pa.binary())], names=["lang", "words", "hashes", "times", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    held.setdefault(lang.as_py(), []).append(text.as_py())
                    size += text.as_buffer().size
                if size >= block_bytes:
                    for lang_, texts in held.items():
                        yield coded(lang_, texts)
                    held, size = {}, 0
        for lang_, texts in held.items():
            yield coded(lang_, texts)

    schema = "lang string, words array<string>, hashes array<bigint>, times array<bigint>, codes binary"
    return rows.mapInArrow(released(run), schema)


def _within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes in column ``h``: at most 2**bits / 8 bytes."""
    slots = rows.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("s"))
    pages = (slots.groupBy(F.shiftright("s", PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit((1 << PAGE) - 1))).alias("bits")))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in pages.collect():
        at = r["page"] << (PAGE - 3)
        out[at:at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _grown(blocks: DataFrame, m: int, frequent, before, now, shorter) -> DataFrame:
    """Counted per block: phrases of ``m`` words that the words expanded ``now`` and not ``before`` begin or end (broadcast bitmaps)."""

    def block(lang: str, words: pa.Array, hashes: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
        often = _within(frequent.value, hashes)
        often[0] = False
        old, new = _within(before.value, hashes) & often, _within(now.value, hashes) & often
        if not (new & ~old).any():
            return None
        n = len(codes) - m + 1
        if n < 1:
            return None
        first, last = codes[:n], codes[m - 1:]
        wanted = (new[first] | new[last]) & ~(old[first] | old[last])
        for k in range(m):
            wanted &= often[codes[k:k + n]]
        at = np.flatnonzero(wanted)
        h = hashes[codes[at]]
        if m > 2:
            for side in (0, 1):  # the phrase without its last and without its first word
                part = hashes[codes[at + side]]
                for k in range(1, m - 1):
                    part = mixed(part * STEP + hashes[codes[at + side + k]])
                known = new[codes[at + side]] | new[codes[at + side + m - 2]]
                fits = ~known | _within(shorter.value, part)
                at = at[fits]
        if not len(at):
            return None
        h, name = hashes[codes[at]], codes[at].astype(np.int64)
        for k in range(1, m):
            h = mixed(h * STEP + hashes[codes[at + k]])
            _, name = np.unique(name * len(words) + codes[at + k], return_inverse=True)
        _, head, times = np.unique(name, return_index=True, return_counts=True)
        parts = [words.take(pa.array(codes[at[head] + k])) for k in range(m)]
        phrase = pc.binary_join_element_wise(*parts, " ")
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(head)), phrase, pa.array(h[head].view(np.int64)), pa.array(times.astype(np.int64))],
                                          names=["lang", "phrase", "h", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, hashes = batch.column(1)[i].values, batch.column(2)[i].values.to_numpy().view(np.uint64)
                codes = np.frombuffer(batch.column(3)[i].as_buffer(), np.int32)
                if (out := block(batch.column(0)[i].as_py(), words, hashes, codes)) is not None:
                    yield out

    rows = blocks.select("lang", "words", "hashes", "codes").mapInArrow(released(run), "lang string, phrase string, h bigint, times bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("times").alias("a"), F.first("h").alias("h"))


def _few_at_once(spark: SparkSession, work: Callable[[], DataFrame], rows: int = 2) -> DataFrame:
    """Run ``work`` with so many rows to an Arrow batch: a block is some MB, and the default would hold a whole task's blocks at once."""
    usual = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        return work()
    finally:
        spark.conf.set(BATCH, usual)


def _limits(words: DataFrame, totals: DataFrame) -> DataFrame:
    """Per language its words ``n`` and the counts up to which each round expands words (``c0``, ``c1`` ...)."""
    steps = words.groupBy("lang", F.floor(4 * F.log2("a")).alias("step")).agg(F.sum("a").alias("all"), F.max("a").alias("to"))
    upto = Window.partitionBy("lang").orderBy("step")
    steps = steps.withColumns({"upto": F.sum("all").over(upto), "whole": F.sum("all").over(Window.partitionBy("lang")), "least": F.min("to").over(Window.partitionBy("lang"))})
    ends = [F.max(F.when(F.col("upto") <= s * F.col("whole"), F.col("to")).otherwise(F.col("least"))).alias(f"c{i}") for i, s in enumerate(SHARES[:-1])]
    ends.append(F.max("to").alias(f"c{len(SHARES) - 1}"))
    return steps.groupBy("lang").agg(*ends).join(totals, "lang")


def _scored(phrases: DataFrame, words: DataFrame, open_: DataFrame, c: str) -> DataFrame:
    """Surviving phrases of the open languages with both ends expanded: lang, phrase, a, l, r, n, score, bound of the rest."""
    known = phrases.select("lang", "phrase", "a").unionByName(words.select("lang", "phrase", "a"))
    parts = F.split("phrase", " ")
    m = F.size(parts)
    cand = phrases.join(open_.select("lang", "n", F.col(c).alias("reach")), "lang")
    cuts = cand.select("lang", "phrase", "a", "n", "reach", (m - 1).alias("cuts"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    parts = F.split("phrase", " ")
    cuts = cuts.withColumns({"p1": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "p2": F.array_join(F.slice(parts, F.col("k") + 1, F.col("cuts") + 1 - F.col("k")), " ")})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("p1"), F.col("a").alias("l")), ["lang", "p1"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("p2"), F.col("a").alias("r")), ["lang", "p2"])
    score = F.expr(f"cast((cast(1000 as {BIG}) * cast(a as {BIG}) * cast(n as {BIG})) div (cast(l as {BIG}) * cast(r as {BIG})) as bigint)")
    cuts = cuts.withColumn("score", score)
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("w")
    ends = [F.count(F.lit(1)).alias("found"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("f1"), F.max(F.when(F.col("k") == F.col("cuts"), F.col("r"))).alias("f2")]
    best = cuts.groupBy("lang", "phrase", "a", "n", "reach", "cuts").agg(weakest, *ends).filter("found = cuts AND f1 <= reach AND f2 <= reach")
    # a longer candidate of the same count takes the phrase with it; one word more is enough to look at
    inner = phrases.filter(F.size(F.split("phrase", " ")) > 2)
    less = [F.expr("regexp_replace(phrase, ' [^ ]*$', '')"), F.expr("regexp_replace(phrase, '^[^ ]* ', '')")]
    inside = reduce(DataFrame.unionByName, [inner.select("lang", x.alias("phrase"), F.col("a").alias("longer")) for x in less])
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alive = best.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    return alive.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP,
                 block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> DataFrame:
    """``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first ``top`` surviving phrases."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    blocks = durable(_blocks(docs, lang_col, text_col, block_bytes), "phrase-blocks")
    entries = blocks.select("lang", F.explode(F.arrays_zip("words", "hashes", "times")).alias("e")).select("lang", "e.*").filter("times > 0")
    every = durable(entries.groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("times").alias("a"), F.first("hashes").alias("h")), "phrase-words")
    words = every.filter(F.col("a") >= least)
    open_ = durable(_limits(words, every.groupBy("lang").agg(F.sum("a").alias("n"))), "phrase-open")
    frequent = share(_bitmap(words, bits))
    expanded, shorter = np.zeros(1 << (bits - 3), np.uint8), {m: np.zeros(1 << (bits - 3), np.uint8) for m in range(2, most_words + 1)}
    tables: list[DataFrame] = []
    out = [spark.createDataFrame([], "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")]
    for i in range(len(SHARES)):
        if open_.isEmpty():
            break
        c = f"c{i}"
        more = words.join(open_.select("lang", F.col(c).alias("reach")), "lang").filter("a <= reach")
        before, expanded = share(expanded), expanded | _bitmap(more, bits)
        now = share(expanded)
        for m in range(2, most_words + 1):
            known = share(shorter[m - 1]) if m > 2 else None
            grown = _grown(blocks, m, frequent, before, now, known).filter(F.col("a") >= least)
            tables.append(_few_at_once(spark, lambda: durable(grown, f"phrase-{m}")))
            if known:
                known.destroy()
            shorter[m] |= _bitmap(tables[-1], bits)
            if not shorter[m].any():
                break
        before.destroy()
        now.destroy()
        phrases = reduce(DataFrame.unionByName, tables)
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        alive = _scored(phrases, words, open_, c).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        alive = durable(alive, "phrase-scores")
        # what is not expanded begins or ends with a word of more than ``reach`` occurrences
        last = alive.filter(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        bound = F.expr(f"(cast(1000 as {BIG}) * n) div ({c} + 1)")
        ended = F.col("last").isNotNull() & (F.col("last") > bound) | (F.col(c) >= F.col(f"c{len(SHARES) - 1}"))
        state = durable(open_.join(last, "lang", "left").withColumn("ended", ended), "phrase-state")
        out.append(alive.join(state.filter("ended").select("lang"), "lang", "left_semi").select(*out[0].columns))
        open_ = state.filter("NOT ended").drop("last", "ended")
    return reduce(DataFrame.unionByName, out)
