"""Chat formatting from event logs: fold each message's events in sequence order, then render and mask.

An event is (conversation, message, seq, kind, role, text). Kinds: ``message`` (the whole text), ``delta`` (append),
``edit`` (replace the text), ``regenerate`` (discard the text; later deltas build the new one). The log is folded per
(conversation, message), so a long conversation is spread over many groups until its one output row is joined.
SQL functions only.

Template: ``<|im_start|>role<|sep|>text<|im_end|>`` per message. Inside roles and texts a backslash becomes ``\\b`` and
``<`` becomes ``\\l``, so no control string can occur in them and :func:`parsed` restores them exactly.

Defined results: null role and text count as empty, a null kind as ``message``, events of other kinds are ignored; null
seq and message numbers come first; events with equal seq are taken in the order of kind, then text. The role of a
message is the last one that an event states. Repeated ``message`` events leave the last. A conversation without any
message gives no row; null conversation ids form one conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.text import or_empty

START, SEP, END = "<|im_start|>", "<|sep|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate")
FIRST = -(1 << 63)


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    """Undo :func:`escape`: each backslash starts one of two pairs, so the order of the replacements is safe."""
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind",
         role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: ``conv``, ``message``, ``role``, ``text``."""
    e = events.select(
        F.col(conv).alias("conv"), F.col(message).alias("message"),
        F.struct(F.coalesce(F.col(seq).cast("long"), F.lit(FIRST)).alias("seq"), F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
                 or_empty(F.col(text)).alias("text"), F.col(role).alias("role")).alias("event"))
    e = e.filter(F.col("event.kind").isin(*KINDS))
    log = e.groupBy("conv", "message").agg(F.sort_array(F.collect_list("event")).alias("log"))
    reset = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    log = log.withColumn("live", F.slice("log", reset + 1, F.size("log")))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    return log.select("conv", "message", or_empty(F.try_element_at(roles, F.lit(-1))).alias("role"),
                      F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv``, ``formatted``, ``loss_spans``: where the texts of ``loss_role`` stand, in code points from 0."""
    body = escape(F.col("text"))
    m = messages.select("conv", "message", body.alias("body"), (F.col("role") == loss_role).alias("learn"),
                        F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), body, F.lit(END)).alias("piece"))
    to_here = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("body").cast("long")
    m = m.withColumn("start", F.sum(F.char_length("piece").cast("long")).over(to_here) - len(END) - size)
    turn = F.struct("message", "piece", "learn", "start", size.alias("length"))
    c = m.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return c.select("conv", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, END.replace("|", "\\|")), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, F.lit(len(START) + 1), F.char_length(p)), SEP.replace("|", "\\|")))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
