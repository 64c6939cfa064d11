"""CSV options under which any text, empty string and null survive a round trip, and reading by header.

A quoted field may span lines. Files are read by as many tasks as their size asks for, whatever
their fields hold: see ``blocks``.
"""

import csv
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.sources import blocks
from pairloom.sources.blocks import State

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
WRITE = _BASE
# The null mark keeps a quoted empty field apart from a bare one, which is null.
READ = {**_BASE, "multiLine": True, "nullValue": "\u0000", "emptyValue": ""}

# From within a quoted field to the quote that ends it, on one line.
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
# A quoted field; one with text behind its closing quote, or without one; a bare one.
_FIELD = re.compile(
    r'(?:"([^"]*+(?:""[^"]*+)*+)"(?=,|\Z)|("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)|"([^"]*+(?:""[^"]*+)*+)\Z|)(,|\Z)'
)


def split_fields(record: str) -> list[str | None]:
    """The fields of a record: quoted ones without their quotes, None for bare empty ones."""
    if '"' not in record:
        return [f or None for f in record.split(",")]
    out, at = [], 0
    while True:
        field = _FIELD.match(record, at)
        quoted, bare, open_, end = field.groups()
        text = bare if bare is not None else quoted if quoted is not None else open_
        out.append(text if bare is not None or text is None else text.replace('""', '"'))
        if not end:
            return out
        at = field.end()


class Csv(blocks.Format):
    """Lines; a line break between quotes belongs to its record."""

    separator = "\n"
    header = True

    def step(self, piece: str, state: State) -> State:
        if '"' not in piece:
            return state
        at, inside = 0, state.inside
        while True:
            if inside:
                closing = _CLOSING.match(piece, at)
                if not closing:
                    return State(True)
                at, inside = closing.end(), False
                # What follows a closing quote belongs to the field.
            elif piece.startswith('"', at):
                at, inside = at + 1, True
                continue
            at = piece.find(",", at) + 1
            if not at:
                return State(False)

    def closed(self, state: State, head: str | None) -> bool:
        return not state.inside

    def begin(self, piece: str, first: bool) -> str | None:
        piece = piece.lstrip("﻿") if first else piece
        return piece if piece.rstrip("\r") else None

    def head(self, pieces: list[str], state: State) -> str | None:
        if state.inside:
            return None
        text = "\n".join(pieces).lstrip("﻿\r\n")
        return text or None


def _by_header(needed: list[str]):
    """Fields by the names of a file's header; None for the records of a file that lacks one."""
    known: dict[str, list[int] | None] = {}

    def interpret(head: str | None, text: str) -> tuple | None:
        if head not in known:
            names = next(csv.reader([(head or "").rstrip("\r")], strict=False), [])
            places = {n: i for i, n in enumerate(names)}
            known.clear()
            known[head] = [places[n] for n in needed] if set(needed) <= set(places) else None
        places = known[head]
        if places is None:
            return None
        # The mark of a null in files written elsewhere.
        fields = [None if f == "\0" else f for f in split_fields(text.removesuffix("\r"))]
        return tuple(fields[i] if i < len(fields) else None for i in places)

    return interpret


def _headers_end(table: DataFrame) -> None:
    if not table.where("start = 0 and head is null and end_inside").isEmpty():
        raise ValueError("a header goes on beyond the first block of its file")


def read_by_header(spark: SparkSession, pattern: str, needed: T.StructType) -> DataFrame:
    """The ``needed`` columns of all matching files by the names in each file's own header, besides
    ``_path`` and ``_pos``, which orders the rows of a file.

    A task that reads a whole file finds the header in it; the header of a file that several tasks
    read has to end in its first block. Records end with a line feed, perhaps after a carriage
    return. A name that a header repeats means its last column. A file without a needed column
    contributes no rows, and no file at all gives an empty table. A text that is no value of its
    column's type is null.
    """
    if (large := blocks.any_large(spark, pattern)) is None:
        places = [T.StructField("_path", T.StringType()), T.StructField("_pos", T.LongType())]
        return spark.createDataFrame([], T.StructType([*needed, *places]))
    return by_header(spark.read.option("lineSep", Csv.separator).text(pattern), needed, large)


def by_header(text: DataFrame, needed: T.StructType, large: bool | None = None) -> DataFrame:
    """As ``read_by_header``, of lines that were read elsewhere, such as a stream's new files."""
    found = blocks.pieces(text)
    if large is None:
        large = not found.where(F.col("size") > blocks.large_files(text.sparkSession)).isEmpty()
    fields = [(f"f{i}", pa.string(), "string") for i in range(len(needed))]
    rows = blocks.records(found, large, Csv(), _by_header(needed.names), fields, _headers_end)
    typed = [F.col(f"f{i}") if isinstance(f.dataType, T.StringType) else F.col(f"f{i}").try_cast(f.dataType) for i, f in enumerate(needed)]
    return rows.select(*[c.alias(f.name) for c, f in zip(typed, needed, strict=True)], F.col("path").alias("_path"), F.col("pos").alias("_pos"))
