"""Files that hold one JSON array of objects, read by as many tasks as their size asks for.

Pieces end at closing braces, so that no piece is longer than the text between two of them. Strings
and brackets tell which brace ends an element: see ``blocks``.
"""

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources import blocks
from pairloom.sources.blocks import State

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESCAPED = re.compile(r"\\.", re.S)
_BEFORE_FIRST = re.compile(r"\s*\[?\s*")
_BETWEEN = re.compile(r"\s*,\s*")
_AFTER_LAST = re.compile(r"\s*\]?\s*")


class JsonArray(blocks.Format):
    """Objects of an array, or the one object of a file."""

    separator = "}"
    header = False

    def step(self, piece: str, state: State) -> State:
        parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        depth, inside = state.depth, state.inside ^ (len(parts) % 2 == 0)
        for part in parts[1 if state.inside else 0 :: 2]:
            depth += part.count("{") + part.count("[") - part.count("]")
        return State(inside, depth if inside else depth - 1)

    def closed(self, state: State, head: str | None) -> bool:
        return not state.inside and state.depth <= (1 if head == "[" else 0)

    def begin(self, piece: str, first: bool) -> str | None:
        brace = piece.find("{")
        before = (piece if brace < 0 else piece[:brace]).lstrip("﻿" if first else "")
        wanted = [_BEFORE_FIRST] if first else [_BETWEEN]
        if brace < 0:
            wanted = [_BEFORE_FIRST, _AFTER_LAST] if first else [_AFTER_LAST]
        rest = before
        for pattern in wanted:
            rest = rest[pattern.match(rest).end() :] if pattern.match(rest) else rest
        if rest or (brace >= 0 and not first and "," not in before):
            raise ValueError(f"MALFORMED: no array of objects, found {before[:80]!r}")
        return piece[brace:] if brace >= 0 else None

    def head(self, pieces: list[str], state: State) -> str | None:
        text = "".join(pieces).lstrip("﻿ \t\r\n")
        return text[:1] or None


def _ended(table: DataFrame) -> None:
    """Fail where a file's last bracket or string is open.

    The piece after an array's last element has no brace behind it but is counted as if it had one.
    """
    last = table.groupBy("path").agg(F.max_by(F.struct("head", "end_inside", "end_depth"), "start").alias("e")).select("e.*")
    depth = F.when(F.col("head") == "[", F.col("end_depth") == -1).otherwise(F.col("end_depth").isin(0, -1))
    if not last.where(F.col("end_inside") | ~depth).isEmpty():
        raise ValueError("MALFORMED: a file ends within its array")


def read_elements(spark: SparkSession, pattern: str) -> DataFrame | None:
    """``path``, ``pos``, ``element`` (JSON text) of the files that may be dealt in blocks; None without files."""

    def whole(head: str | None, text: str) -> tuple:
        return (text + "}",)

    fields = [("element", pa.string(), "string")]
    return blocks.read_records(spark, pattern, JsonArray(), whole, fields, _ended, only_large=True)
