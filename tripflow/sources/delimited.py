"""Delimited sensor logs whose dialect and header differ from file to file."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators in the order they are tried; a header without a name.
SEPARATORS = (";", ",")
PLACEHOLDER = re.compile(r"\s*(unnamed:\s*\d+)?\s*", re.IGNORECASE)
HEAD_BYTES = 1 << 18


@dataclass(frozen=True)
class Variant:
    """Files that share a separator, an encoding and a header."""

    sep: str
    encoding: str
    heads: tuple[str, ...]
    paths: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        """Names of the last header line; a nameless field is called by its position."""
        fields = [f.strip().strip('"') for f in self.heads[-1].split(self.sep)]
        return [f or f"Unnamed: {i}" for i, f in enumerate(fields)]


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8 behind a byte-order mark, else cp1252, and ISO-8859-1 where a byte means nothing there."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace"), "utf-8"
    try:
        return raw.decode("cp1252"), "cp1252"
    except UnicodeDecodeError:
        return raw.decode("iso-8859-1"), "iso-8859-1"


def _read_heads(n_lines: int):
    def heads(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name) as f:
                    raw = b""
                    while raw.count(b"\n") < n_lines and (more := f.read(HEAD_BYTES)):
                        raw += more
                text, encoding = decode(b"".join(raw.splitlines(True)[:n_lines]))
                lines = text.splitlines()[:n_lines]
                sep = next((s for s in SEPARATORS if lines and s in lines[-1]), None)
                rows.append((path, sep, encoding, lines))
            yield pd.DataFrame(rows, columns=["path", "sep", "encoding", "heads"])
    return heads


def probe(spark: SparkSession, folder: str, pattern: str = "*.csv", header_lines: int = 1) -> DataFrame:
    """One row per file with its separator, encoding and header lines; only file heads are read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(folder).select("path"))
    return files.mapInPandas(_read_heads(header_lines),
                             "path string, sep string, encoding string, heads array<string>")


def variants(spark: SparkSession, folder: str, pattern: str = "*.csv", header_lines: int = 1,
             skip_unreadable: bool = False) -> list[Variant]:
    """Group the files of a folder by header; the file list is metadata, as in any Spark scan."""
    groups: dict[tuple, list[str]] = defaultdict(list)
    for r in probe(spark, folder, pattern, header_lines).toLocalIterator():
        if r.sep is None or len(r.heads) < header_lines:
            if skip_unreadable:
                continue
            raise ValueError(f"could not parse {r.path}")
        groups[(r.sep, r.encoding, tuple(r.heads))].append(r.path)
    if not groups:
        raise FileNotFoundError(f"no readable {pattern} under {folder}")
    return [Variant(*k, tuple(sorted(v))) for k, v in sorted(groups.items())]


def trip_key() -> Column:
    """The file stem; a part file that Spark wrote goes by the folder it is in (``name`` or ``column=name``)."""
    name = F.col("_metadata.file_name")
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    value = F.when(folder.contains("="), F.substring(folder, F.locate("=", folder) + 1, F.length(folder))).otherwise(folder)
    value = F.when(value.contains("%"), F.url_decode(value)).otherwise(value)
    stem = F.when(name.contains("."), F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)).otherwise(name)
    return F.when(name.startswith("part-"), value).otherwise(stem)


def file_stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)


def extra_class(header_is_placeholder: Column, present: Column, rows: Column) -> Column:
    """Class of a column without mapping: trailing_empty, stray (a few broken lines) or unmapped."""
    few = F.greatest(F.lit(1), F.floor(rows * 0.01))
    return (F.when(~header_is_placeholder, F.lit("unmapped"))
            .when(present == 0, F.lit("trailing_empty"))
            .when(present <= few, F.lit("stray")).otherwise(F.lit("unmapped")))


def is_placeholder(name: Column) -> Column:
    return name.rlike(r"(?i)^\s*(unnamed:\s*\d+)?\s*$")


def _name(path: Column) -> Column:
    """File name; a part file that Spark wrote with the folder it is in."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(name.rlike("^part-"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).otherwise(name)


def load_report(spark: SparkSession, folder: str, pattern: str = "*.csv", min_rows: int = 200) -> DataFrame:
    """Per file: separator, encoding, data rows (all-blank records are none), and why it is rejected (unreadable or too short)."""
    heads = probe(spark, folder, pattern).withColumn("file", _name(F.col("path")))
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
             .filter(F.regexp_replace("value", r'[\s;,"]', "") != "").groupBy(_name(F.col("_metadata.file_path")).alias("file"))
             .agg((F.count(F.lit(1)) - 1).alias("rows")))
    error = (F.when(F.col("sep").isNull(), F.lit("unreadable"))
             .when(F.coalesce("rows", F.lit(0)) < min_rows, F.lit("too few rows")))
    return (heads.join(lines, "file", "left")
            .select("file", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "sep", "encoding",
                    error.alias("error")))
