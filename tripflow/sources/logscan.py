"""One scan over delimited logs whose dialect, header and width differ from file to file.

Spark lists the files and cuts them into byte ranges; a task opens a range, reads the file's own header, and hands the fields
on under the names of the signals they carry.  So there is one plan whatever the number of headers, no list of paths on the
driver, and a large file is read by as many tasks as it has ranges.  Python only splits records into fields; numbers are parsed
and counted on Spark's side.

A record may hold line breaks inside quotes.  Where a range starts inside or outside quotes is known from the ranges before it:
each range is a map of two states (outside, inside), and the maps of a file are composed by window.  Only files longer than one
range are read for that.  A quote opens a field only at its start; a quote that is never closed runs to the end of its file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripflow.functions.headers import header_key_of
from tripflow.functions.scalars import lenient_double
from tripflow.session import durable
from tripflow.sources.delimited import HEAD_BYTES, SEPARATORS, decode, extra_class, is_placeholder, trip_key

RANGE_BYTES = 32 << 20
BATCH_ROWS = 16_384
_MORE = pa.struct([("signal", pa.string()), ("copy", pa.int32()), ("value", pa.string())])
_LOOSE = pa.struct([("position", pa.int32()), ("value", pa.string())])
_FIELD = pa.struct([("position", pa.int32()), ("header", pa.string()), ("signal", pa.string())])
# What every record of the scan carries besides its signals: ``layout`` is the places of its file's signals in the vocabulary;
# ``fields`` is there on the one row a file has for its header.
_NOTES = [("trip", pa.string()), ("path", pa.string()), ("sep", pa.string()), ("encoding", pa.string()), ("width", pa.int32()), ("layout", pa.string()),
          ("fields", pa.list_(_FIELD)), ("more", pa.list_(_MORE)), ("loose", pa.list_(_LOOSE))]
_NOTES_SQL = ("trip string, path string, sep string, encoding string, width int, layout string, fields array<struct<position:int,header:string,signal:string>>, "
              "more array<struct<signal:string,copy:int,value:string>>, loose array<struct<position:int,value:string>>")


# ---- bytes of one file -------------------------------------------------------------------------


def _open(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _span(f, start: int, stop: int) -> bytes:
    f.seek(start)
    return f.read(max(stop - start, 0))


def _turn(inside: bool, quotes: int, at_field_start: bool) -> bool:
    """State after a run of quotes: an odd run closes, an even one is escaped; outside, only a field's start opens."""
    if inside:
        return quotes % 2 == 0
    return at_field_start and quotes % 2 == 1


def _borders(sep: bytes) -> tuple[bytes, ...]:
    return (b"", sep, b"\n", b"\r")


def next_record(raw: bytes, at: int, inside: bool, sep: bytes, before: bytes = b"") -> int | None:
    """Place after the first line break outside quotes at or after ``at``; None where there is none.

    ``inside`` is the state at ``at``; quotes that begin there belong to the run of a quote before them.
    """
    if not inside and b'"' not in raw[at:]:
        end = raw.find(b"\n", at)
        return None if end < 0 else end + 1
    last = raw[at - 1:at] or before
    skipped = at + (len(raw) - at - len(raw[at:].lstrip(b'"')) if last == b'"' else 0)
    for token in re.compile(rb'"+|\n').finditer(raw, skipped):
        if token.group() == b"\n":
            if not inside:
                return token.end()
        else:
            inside = _turn(inside, token.end() - token.start(), (raw[token.start() - 1:token.start()] or before) in _borders(sep))
    return None


def quote_map(f, start: int, stop: int, sep: bytes) -> tuple[bool, bool]:
    """Is the end of a range inside quotes if its start is outside, and if its start is inside?

    A run of quotes belongs to the range it begins in.
    """
    before, raw = (_span(f, start - 1, start) if start else b""), _span(f, start, stop)
    tail = 0
    while raw.endswith(b'"') and (more := _span(f, stop + tail, stop + tail + 4096)):
        tail += len(more)
        raw += more[:len(more) - len(more.lstrip(b'"'))]
        if more.lstrip(b'"'):
            break
    skip = len(raw) - len(raw.lstrip(b'"')) if before == b'"' else 0
    ends = [False, True]
    for run in re.compile(rb'"+').finditer(raw, skip):
        opens = (raw[run.start() - 1:run.start()] or before) in _borders(sep)
        ends = [_turn(e, run.end() - run.start(), opens) for e in ends]
    return ends[0], ends[1]


@dataclass(frozen=True)
class Head:
    """Dialect and header of a file, and where its records begin."""

    sep: str | None
    encoding: str
    names: tuple[str, ...]
    body: int

    @property
    def usable(self) -> bool:
        return self.sep is not None


def read_head(f, header_lines: int = 1) -> Head:
    """The last of the header lines names the fields; a nameless field is called by its position."""
    raw, at, lines = b"", 0, []
    while len(lines) < header_lines:
        more = f.read(HEAD_BYTES)
        raw += more
        while len(lines) < header_lines:
            end = raw.find(b"\n", at)
            if end < 0 and (more or at >= len(raw)):
                break
            lines.append(raw[at:end + 1] if end >= 0 else raw[at:])
            at = end + 1 if end >= 0 else len(raw)
        if not more:
            break
    first = raw[:at]
    text, encoding = decode(first)
    said = text.splitlines()
    sep = next((s for s in SEPARATORS if len(said) >= header_lines and s in said[-1]), None)
    if sep is None:
        return Head(None, encoding, (), at)
    fields = [n.strip().strip('"') for n in next(csv.reader([said[-1]], delimiter=sep, skipinitialspace=True))]
    return Head(sep, encoding, tuple(n or f"Unnamed: {i}" for i, n in enumerate(fields)), at)


def records(f, head: Head, start: int, stop: int, inside: bool, ends_inside: bool) -> bytes:
    """Bytes of the records that begin in a range; the last one may end after it."""
    sep = head.sep.encode()
    begin = max(start, head.body)
    if begin >= stop:
        return b""
    if start < head.body:
        raw, at = _span(f, begin, stop), 0
    else:
        before, raw = _span(f, start - 1, start), _span(f, start, stop)
        at = 0 if before == b"\n" and not inside else next_record(raw, 0, inside, sep, before)
    if at is None or at >= len(raw):
        return b""
    if raw.endswith(b"\n") and not ends_inside:
        return raw[at:]
    end, size = len(raw), 1 << 20
    while more := f.read(size):
        raw += more
        if (cut := next_record(raw, end, ends_inside, sep)) is not None:
            return raw[at:cut]
        size *= 2
    return raw[at:]


# ---- records to Arrow --------------------------------------------------------------------------


def _split(body: bytes, head: Head) -> tuple[pa.Table | None, list[list[str]]]:
    """Fields of all records as wide as the header, and apart from them the records of another width."""
    if not body.isascii():
        body = (body.decode("utf-8", "replace") if head.encoding == "utf-8" else decode(body)[0]).encode()
    if not body.strip():
        return None, []
    odd: list[str] = []

    def other_width(row) -> str:
        odd.append(row.text)
        return "skip"

    names = [str(i) for i in range(len(head.names))]
    table = arrow_csv.read_csv(
        pa.BufferReader(body), read_options=arrow_csv.ReadOptions(column_names=names, use_threads=False, block_size=len(body) + 1),
        parse_options=arrow_csv.ParseOptions(delimiter=head.sep, newlines_in_values=True, invalid_row_handler=other_width),
        convert_options=arrow_csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True, null_values=[""],
                                                 check_utf8=False))
    fields = [row for text in odd if text.strip() for row in csv.reader([text], delimiter=head.sep)]
    return table, fields


def _listed(columns: list[pa.Array], labels: list[tuple], kind: pa.StructType, keep_null: bool) -> pa.Array:
    """Per row the list of (label.., value) of several columns."""
    n, k = len(columns[0]), len(columns)
    order = (np.arange(k)[None, :] * n + np.arange(n)[:, None]).ravel()
    values = pa.concat_arrays(columns).take(pa.array(order))
    held = np.ones(n * k, bool) if keep_null else values.is_valid().to_numpy(zero_copy_only=False)
    parts = [pa.array(np.tile(np.arange(k), n)[held]) for _ in labels[:1]]
    named = [pa.array([label[j] for label in labels], kind[j].type).take(parts[0]) for j in range(len(labels[0]))]
    offsets = np.concatenate([[0], np.cumsum(held.reshape(n, k).sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([*named, values.filter(pa.array(held))], fields=list(kind)))


@dataclass(frozen=True)
class Layout:
    """Which field of a header carries which signal, as its first, second .. copy."""

    first: dict[str, int]
    further: list[tuple[str, int, int]]
    loose: list[int]

    @staticmethod
    def of(names: tuple[str, ...], mapping: dict[str, str]) -> Layout:
        first, further, loose, seen = {}, [], [], {}
        for i, name in enumerate(names):
            signal = mapping.get(header_key_of(name))
            if signal is None:
                loose.append(i)
            elif signal not in first:
                first[signal], seen[signal] = i, 1
            else:
                further.append((signal, seen[signal], i))
                seen[signal] += 1
        return Layout(first, further, loose)


def _batch(n: int, given: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _batches(table: pa.Table | None, odd: list[list[str]], head: Head, layout: Layout, trip: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    width = len(head.names)
    signals = schema.names[len(_NOTES):]
    places = ",".join(str(i) for i, s in enumerate(signals) if s in layout.first)

    def notes(n: int) -> dict[str, pa.Array]:
        same = {"trip": (trip, pa.string()), "width": (width, pa.int32()), "layout": (places, pa.string())}
        return {k: pa.repeat(pa.scalar(v, t), n) for k, (v, t) in same.items()}

    for at in range(0, table.num_rows if table is not None else 0, BATCH_ROWS):
        part = table.slice(at, BATCH_ROWS)
        column = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in part.columns]
        given = notes(part.num_rows) | {s: column[i] for s, i in layout.first.items()}
        if layout.further:
            given["more"] = _listed([column[i] for _, _, i in layout.further], [(s, c) for s, c, _ in layout.further], _MORE, keep_null=True)
        if layout.loose:
            given["loose"] = _listed([column[i] for i in layout.loose], [(i,) for i in layout.loose], _LOOSE, keep_null=False)
        yield _batch(part.num_rows, given, schema)
    for at in range(0, len(odd), BATCH_ROWS):
        part = odd[at:at + BATCH_ROWS]
        field = lambda row, i: (row[i] or None) if i < len(row) else None
        given = notes(len(part)) | {s: pa.array([field(r, i) for r in part], pa.string()) for s, i in layout.first.items()}
        given["more"] = pa.array([[{"signal": s, "copy": c, "value": field(r, i)} for s, c, i in layout.further] for r in part], pa.list_(_MORE))
        given["loose"] = pa.array([[{"position": i, "value": r[i]} for i in (*layout.loose, *range(width, len(r))) if i < len(r) and r[i]]
                                   for r in part], pa.list_(_LOOSE))
        yield _batch(len(part), given, schema)


def _reader(mapping: dict[str, str], signals: list[str], header_lines: int):
    schema = pa.schema([*_NOTES, *((s, pa.string()) for s in signals)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    head = read_head(f, header_lines)
                    layout = Layout.of(head.names, mapping)
                    if r["start"] == 0:
                        fields = [(i, n, mapping.get(header_key_of(n))) for i, n in enumerate(head.names)]
                        said = {"trip": r["trip"], "path": r["path"], "sep": head.sep, "encoding": head.encoding, "width": len(head.names),
                                "fields": [dict(zip(("position", "header", "signal"), x)) for x in fields]}
                        yield _batch(1, {k: pa.array([v], schema.field(k).type) for k, v in said.items()}, schema)
                    if head.usable:
                        body = records(f, head, r["start"], r["stop"], r["inside"], r["ends_inside"])
                        yield from _batches(*_split(body, head), head, layout, r["trip"], schema)
    return read


# ---- ranges ------------------------------------------------------------------------------------


def _quote_reader(header_lines: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
                with _open(path) as f:
                    head = read_head(f, header_lines)
                    rows.append((path, start, *quote_map(f, start, stop, (head.sep or SEPARATORS[0]).encode())))
            yield pd.DataFrame(rows, columns=["path", "start", "from_outside", "from_inside"])
    return read


def quote_states(ranges: DataFrame, header_lines: int = 1) -> DataFrame:
    """Per range of a file: does it start, and end, inside quotes?

    Of the two-state maps only those that ignore their start fix the state; the others keep or swap it, so the state is that of
    the last fixing range, swapped as often as ranges since then swap.
    """
    maps = ranges.select("path", "start", "stop").mapInPandas(_quote_reader(header_lines), "path string, start long, from_outside boolean, from_inside boolean")
    w = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixes = F.col("from_outside") == F.col("from_inside")
    swaps = F.sum(F.col("from_outside").cast("int") * (~F.col("from_inside")).cast("int")).over(w)
    counted = maps.withColumn("_swaps", swaps)
    last = F.last(F.when(fixes, F.struct("from_outside", "_swaps")), ignorenulls=True).over(w)
    state = F.coalesce(last["from_outside"], F.lit(False)) != ((F.col("_swaps") - F.coalesce(last["_swaps"], F.lit(0))) % 2 == 1)
    ended = counted.withColumn("ends_inside", state)
    before = F.lag("ends_inside", 1, False).over(Window.partitionBy("path").orderBy("start"))
    return ended.select("path", "start", before.alias("inside"), "ends_inside")


def scan(spark: SparkSession, folder: str, pattern: str, mapping: dict[str, str], header_lines: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of a folder's files: ``trip``, one text column per signal of ``mapping``, ``more`` (further copies of signals), ``loose`` (fields
    without a signal), ``width`` of the header; and per file one row with its ``path``, dialect and header ``fields``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
             .select("path", "length", trip_key().alias("trip")))
    size = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.max("length").alias("longest")).first()
    if not size.n:
        raise FileNotFoundError(f"no {pattern} under {folder}")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    ranges = files.select("*", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + range_bytes, "length"))
    tasks = max(-(-size.bytes // range_bytes), min(size.n, spark.sparkContext.defaultParallelism))
    dealt = ranges.repartition(int(tasks))
    if size.longest > range_bytes:
        states = quote_states(dealt.filter(F.col("length") > range_bytes), header_lines)
        ranges = ranges.join(states, ["path", "start"], "left").fillna(False, ["inside", "ends_inside"])
        dealt = ranges.repartition(int(tasks))
    else:
        dealt = dealt.withColumns({"inside": F.lit(False), "ends_inside": F.lit(False)})
    signals = list(dict.fromkeys(mapping.values()))
    schema = ", ".join([_NOTES_SQL, *(f"`{s}` string" for s in signals)])
    return dealt.select("path", "trip", "start", "stop", "inside", "ends_inside").mapInArrow(_reader(mapping, signals, header_lines), schema)


# ---- what was read -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Logs:
    """A folder of logs, parsed once into a table that everything else reads."""

    table: DataFrame

    @property
    def heads(self) -> DataFrame:
        return self.table.filter("fields IS NOT NULL").select("trip", "path", "sep", "encoding", "width", "fields")

    @property
    def records(self) -> DataFrame:
        return self.table.filter("fields IS NULL")

    @cached_property
    def _found(self) -> list:
        """Per signal (NULL for all other fields) the most copies in a file, and the first path that could not be read."""
        fields = self.heads.select("path", "sep", F.inline_outer("fields")).groupBy("signal", "path", "sep").agg(F.count(F.lit(1)).alias("n"))
        return fields.groupBy("signal").agg(F.max("n").alias("n"), F.min(F.when(F.col("sep").isNull(), F.col("path"))).alias("bad")).collect()

    @property
    def unreadable(self) -> str | None:
        return next((r.bad for r in self._found if r.bad), None)

    @property
    def depth(self) -> dict[str, int]:
        """Signals that any file carries, with the greatest number of copies in a file; as large as the vocabulary."""
        found = {r.signal: r.n for r in self._found}
        return {c: found[c] for c in self.table.columns[len(_NOTES):] if c in found}

    @property
    def copies(self) -> dict[str, list[str]]:
        """Columns of :meth:`wide` that carry each signal, in file order."""
        return {s: [s, *(f"{s}__copy{i}" for i in range(1, n))] for s, n in self.depth.items()}

    def held(self, signal: str, level: int) -> Column:
        """Does the row's file have this further copy of the signal?"""
        return F.exists(F.coalesce("more", F.array().cast("array<struct<signal:string,copy:int,value:double>>")),
                        lambda m: (m["signal"] == signal) & (m["copy"] == level))

    def wide(self) -> DataFrame:
        """``trip``, ``n_raw_columns``, ``header_signals``, ``more`` and the signals, with a column for every further copy."""
        vocabulary = F.array(*[F.lit(c) for c in self.table.columns[len(_NOTES):]])
        known = F.transform(F.split("layout", ","), lambda i: F.get(vocabulary, i.try_cast("int")))
        def copy(signal: str, level: int) -> Column:
            return F.get(F.filter("more", lambda m: (m["signal"] == signal) & (m["copy"] == level)), 0)["value"]
        further = [copy(s, i).alias(f"{s}__copy{i}") for s, n in self.depth.items() for i in range(1, n)]
        return self.records.select("trip", F.col("width").alias("n_raw_columns"), F.array_compact(known).alias("header_signals"), "more", *self.depth, *further)

    def extra_fields(self) -> DataFrame:
        """Per file and field without a signal: how many numbers it holds and what that makes it."""
        rows = self.records.groupBy("trip").agg(F.count(F.lit(1)).alias("rows"))
        present = self.records.select("trip", F.inline("loose")).groupBy("trip", "position").agg(F.count("value").alias("present"))
        named = self.heads.select("trip", F.inline("fields")).filter("signal IS NULL").select("trip", "position", "header").distinct()
        both = named.join(present.filter("present > 0"), ["trip", "position"], "full").join(rows, "trip")
        header = F.coalesce("header", F.concat(F.lit("Unnamed: "), "position"))
        out = both.select("trip", "rows", header.alias("header"), "position", F.coalesce("present", F.lit(0).cast("long")).alias("present"))
        return out.withColumn("kind", extra_class(is_placeholder(F.col("header")), F.col("present"), F.col("rows")))


def read(spark: SparkSession, folder: str, pattern: str, mapping: dict[str, str], header_lines: int = 1, skip_unreadable: bool = False,
         range_bytes: int = RANGE_BYTES) -> Logs:
    """Parse every byte of a folder once; numbers that do not parse are NULL.  Files without a byte are no logs."""
    text = scan(spark, folder, pattern, mapping, header_lines, range_bytes)
    signals = list(dict.fromkeys(mapping.values()))
    number = lambda a: F.transform(a, lambda x: x.withField("value", lenient_double(x["value"])))
    parsed = text.withColumns({s: lenient_double(s) for s in signals} | {"more": number("more"), "loose": number("loose")})
    logs = Logs(durable(parsed, "logs"))
    if not skip_unreadable and logs.unreadable:
        raise ValueError(f"could not parse {logs.unreadable}")
    if not logs.depth:
        raise FileNotFoundError(f"no readable {pattern} under {folder}")
    return logs
