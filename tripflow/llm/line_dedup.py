"""Remove repeated passages by overlapping windows of three consecutive lines.

Lines are compared without blanks at their ends; blank lines belong to no window and always stay. Every window is hashed
(128 bits), repeated windows are found over all documents, and every occurrence but the first in order of (id, text hash,
line) covers its lines; covered lines go. A document of one or two lines has one window, all its lines, which equals only
the same lines of another short document.

Counting aggregates map-side, so a window that a third of all documents share is one small row per task. Occurrences of
repeated windows are picked by a fixed-size sieve inside the scan and meet the window table by a join that AQE can split.
Only documents that lose lines are shuffled with their text.

Defined results: a null text stays null; a text that loses no line is returned as it is. Within one document a run of one
repeated line, four or longer, shrinks to its first line. Rows that repeat both id and text count as one document and
stay alike. Null ids come first. A text can become empty; ``n_removed`` tells. Extra columns pass through; ``n_lines``
and ``n_removed`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm import sieve
from tripflow.llm.text import or_empty
from tripflow.session import durable

WIDTH = 3
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(or_empty(text), "\n")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """One row per document: ``id``, ``key``, ``at`` (indices of its lines with text), ``h1`` and ``h2`` (window hashes)."""
    lines = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("x")))
    d = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("key"), F.filter(lines, lambda s: s["x"] != "").alias("lines"))
    d = d.select("id", "key", F.transform("lines", lambda s: s["i"]).alias("at"), F.transform("lines", lambda s: F.xxhash64(s["x"])).alias("a"),
                 F.transform("lines", lambda s: F.xxhash64(F.lit("second"), s["x"])).alias("b"))
    n = F.size("at")

    def hashed(col: str) -> Column:
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(F.col(col), i + k) for k in range(width)]))
        return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(n, F.col(col)))).otherwise(F.array().cast("array<bigint>"))

    return d.select("id", "key", "at", hashed("a").alias("h1"), hashed("b").alias("h2"))


def later_lines(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """``key`` and ``gone``: the indices of the lines that later occurrences cover. Only documents that lose lines."""
    per_doc = durable(windows(docs, id_col, text_col, width), "line-windows")
    w = per_doc.select("id", "key", "at", F.posexplode(F.arrays_zip("h1", "h2")).alias("pos", "h")).select("id", "key", "at", "pos", "h.h1", "h.h2")
    slim = w.select("h1", "h2", F.struct("id", "key", "pos").alias("where"))
    first = slim.groupBy("h1", "h2").agg(F.min("where").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = durable(first.drop("n"), "line-repeats")
    hits = sieve.mark(w, sieve.build(first, "h1", "h2"), "hit", F.col("h1"), F.col("h2")).filter("hit")
    hits = hits.select("h1", "h2", F.struct("id", "key", "pos").alias("where"), F.slice("at", F.col("pos") + 1, width).alias("covers"))
    later = hits.join(first, ["h1", "h2"]).filter(~F.col("where").eqNullSafe(F.col("first")))
    return later.select("where.key", F.explode("covers").alias("line")).groupBy("key").agg(F.collect_set("line").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs`` with covered lines taken out of the text, and ``n_lines`` and ``n_removed``."""
    gone = durable(later_lines(docs, id_col, text_col, width), "line-gone")
    d = docs.drop("n_lines", "n_removed").withColumn("__key", _row_key(id_col, text_col))
    d = sieve.mark(d, sieve.build(gone, "key"), "__hit", F.col("__key"))
    n_lines = F.size(_lines(F.col(text_col)))
    whole = d.filter(~F.col("__hit")).withColumn("n_lines", n_lines).withColumn("n_removed", F.lit(0))
    cut = d.filter("__hit").join(gone.withColumnsRenamed({"key": "__key", "gone": "__gone"}), "__key", "left")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(_lines(F.col(text_col)), i)), "\n")
    cut = (cut.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")))
           .withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(text)).drop("__gone"))
    return whole.unionByName(cut).drop("__key", "__hit")
