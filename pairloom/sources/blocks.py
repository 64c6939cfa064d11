"""Records of files of which Spark deals blocks to several tasks.

Blocks are cut by bytes, without regard to quotes and brackets, so one may begin in the middle of a
record. Files are read as pieces between separators. First a task tells, for either way a quote may
stand at the start of its block, how it stands at the end; composed over the blocks of a file that
gives the true state at each start. Then every block is cut into records on its own, and the parts
of records that cross blocks are joined by key.

Files too small to be dealt in blocks are read once and need only the second step.
"""

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.joins import fits_broadcast
from pairloom.storage import materialise

# Tasks get the code with the function, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, OPENS, GOES_ON = 0, 1, 2


@dataclass(frozen=True)
class State:
    """Whether a quote is open, and how many brackets are."""

    inside: bool = False
    depth: int = 0


class Format:
    """How the records of a file format are told apart."""

    separator: str
    # Whether a file's first record is its header and no data.
    header: bool

    def step(self, piece: str, state: State) -> State:
        """The state after a piece and the separator behind it."""
        raise NotImplementedError

    def closed(self, state: State, head: str | None) -> bool:
        """Whether no record is open."""
        raise NotImplementedError

    def begin(self, piece: str, first: bool) -> str | None:
        """The text of a record that begins in a piece, None where none does; ``first`` in the file."""
        raise NotImplementedError

    def head(self, pieces: list[str], state: State) -> str | None:
        """What all blocks have to know, from a file's first pieces; None while they do not tell."""
        raise NotImplementedError


def _scan(form: Format):
    """Tasks that give, for every block, the end state for either start, and the head of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def block() -> pa.RecordBatch:
            row = {"path": key[0], "start": key[1], "head": head}
            for name, s in zip(("out", "in"), states, strict=True):
                row |= {f"{name}_inside": s.inside, f"{name}_depth": s.depth}
            return pa.RecordBatch.from_pylist([row], schema=_SCANNED)

        for batch in batches:
            for path, start, piece in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "value")), strict=True):
                if (path, start) != key:
                    if key:
                        yield block()
                    key, states, first, head = (path, start), [State(False), State(True)], [], None
                states = [form.step(piece, s) for s in states]
                if start == 0 and head is None:
                    first.append(piece)
                    head = form.head(first, states[0])
        if key:
            yield block()

    return run


_SCANNED = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("head", pa.string())]
    + [(f"{s}_{n}", t) for s in ("out", "in") for n, t in (("inside", pa.bool_()), ("depth", pa.int64()))]
)


def _blocks(pieces: DataFrame, form: Format) -> DataFrame:
    """``path``, ``start``, ``inside``, ``depth``, ``head``, ``end_inside``, ``end_depth`` of every block."""
    scanned = materialise(
        pieces.mapInArrow(
            _scan(form), "path string, start long, head string, out_inside boolean, out_depth long, in_inside boolean, in_depth long"
        )
    )
    order = Window.partitionBy("path").orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A block that ends alike from either start sets the state anew; any other keeps it or turns it over.
    fixed = F.col("out_inside") == F.col("in_inside")
    turned = (~fixed & F.col("out_inside")).cast("int")
    runs = scanned.withColumn("run", F.sum(fixed.cast("int")).over(upto))
    within = Window.partitionBy("path", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.max(F.when(fixed, F.col("out_inside").cast("int"))).over(within)
    ended = runs.withColumn("end_inside", (F.coalesce(begun, F.lit(0)) + F.sum(turned).over(within)) % 2 == 1)
    started = ended.withColumn("inside", F.coalesce(F.lag("end_inside").over(order), F.lit(False)))
    change = F.when(F.col("inside"), F.col("in_depth")).otherwise(F.col("out_depth"))
    summed = started.withColumn("end_depth", F.sum(change).over(upto)).withColumn("head", F.first("head", ignorenulls=True).over(upto))
    return materialise(
        summed.select("path", "start", "inside", (F.col("end_depth") - change).alias("depth"), "head", "end_inside", "end_depth")
    )


def _cut(form: Format, interpret: Callable[[str | None, str], tuple | None], schema: pa.Schema, whole_files: bool):
    """Tasks that turn blocks with a known start into interpreted records and parts of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = opened = None
        out: list[list] = [[] for _ in schema.names]

        def put(part: int) -> None:
            text = form.separator.join(buffer)
            if part == WHOLE:
                fields = interpret(head, text)
                if fields is None:
                    return
                row = (key[0], pos, part, None, None, *fields)
            else:
                row = (key[0], pos, part, head, text, *[None] * (len(schema.names) - 5))
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(out, schema.types, strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("path", "start", "value", "inside", "depth", "head")]
            for path, start, piece, inside, depth, given in zip(*columns, strict=True):
                if (path, start) != key:
                    if opened is not None:
                        put(WHOLE if whole_files else opened)
                    key, state, head, pos, count = (path, start), State(inside, depth), given, start, 0
                    opened, buffer = (None, []) if form.closed(state, head) else (GOES_ON, [])
                    headed = start > 0 or not form.header
                place, count = start + count, count + 1
                if opened is None:
                    begun = form.begin(piece, place == 0)
                    if begun is not None:
                        opened, pos, buffer = OPENS, place, [begun]
                else:
                    buffer.append(piece)
                state = form.step(piece, state)
                if opened is None or not form.closed(state, head):
                    continue
                if headed:
                    put(WHOLE if opened == OPENS else GOES_ON)
                else:
                    headed, head = True, form.separator.join(buffer)
                opened, buffer = None, []
            yield flush()
        if opened is not None and headed:
            put(WHOLE if whole_files else opened)
            yield flush()

    return run


def _joined(interpret: Callable[[str | None, str], tuple | None], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, pos, head, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields = interpret(head, text)
                if fields is not None:
                    rows.append((path, pos, WHOLE, None, None, *fields))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return run


def _with_states(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces, in their order, with the state and head at the start of their block."""
    known = blocks.select("path", "start", "inside", "depth", "head")
    if fits_broadcast(known):
        met = pieces.join(F.broadcast(known), ["path", "start"], "left")
    else:
        numbered = pieces.withColumn("seq", F.monotonically_increasing_id())
        met = numbered.join(known.hint("merge"), ["path", "start"], "left").sortWithinPartitions("path", "start", "seq")
    unknown = F.raise_error(F.lit("files were dealt in other blocks than before: read them again"))
    return met.withColumn("inside", F.coalesce("inside", unknown.cast("boolean")))


def large_files(spark: SparkSession) -> int:
    """Files of more bytes may be dealt in blocks."""
    return spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()


def any_large(spark: SparkSession, pattern: str) -> bool | None:
    """Whether a file may be dealt in blocks, None where there is no file. Contents are not read."""
    try:
        sizes = spark.read.format("binaryFile").load(pattern).agg(F.max("length").alias("most"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (sizes.first()["most"] or 0) > large_files(spark)


def pieces(text: DataFrame) -> DataFrame:
    """What ``records`` needs of text that was read with a format's separator as ``lineSep``."""
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def read_records(spark: SparkSession, pattern: str, form: Format, *args, **options) -> DataFrame | None:
    """``records`` of all matching files; None where there is no file."""
    large = any_large(spark, pattern)
    if large is None:
        return None
    text = spark.read.option("lineSep", form.separator).text(pattern)
    return records(pieces(text), large, form, *args, **options)


def records(
    text: DataFrame,
    large: bool,
    form: Format,
    interpret: Callable[[str | None, str], tuple | None],
    fields: list[tuple[str, pa.DataType, str]],
    checked: Callable[[DataFrame], None] | None = None,
    only_large: bool = False,
) -> DataFrame:
    """``path``, ``pos`` (rising within a file) and the interpreted fields of every record.

    ``interpret`` takes the file's head and a record's text and gives the fields, or None for no
    row. ``large`` says whether a file may be dealt in blocks. ``checked`` may look at the table of
    blocks. Small files are left out with ``only_large``.
    """
    spark = text.sparkSession
    arrow = pa.schema(
        [("path", pa.string()), ("pos", pa.int64()), ("part", pa.int32()), ("head", pa.string()), ("text", pa.string())]
        + [(n, t) for n, t, _ in fields]
    )
    ddl = ", ".join(["path string, pos long, part int, head string, text string", *(f"`{n}` {d}" for n, _, d in fields)])
    names = ["path", "pos", *(n for n, _, _ in fields)]
    parts = []
    if not only_large:
        # The list of files is pruned by size, so what is read twice below is not read here.
        small = text.where(F.col("size") <= large_files(spark)) if large else text
        none = small.select("path", "start", "value", F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("head"))
        parts.append(none.mapInArrow(_cut(form, interpret, arrow, True), ddl).select(*names))
    if large:
        dealt = text.where(F.col("size") > large_files(spark)).select("path", "start", "value")
        blocks = _blocks(dealt, form)
        if checked:
            checked(blocks)
        cut = _with_states(dealt, blocks).mapInArrow(_cut(form, interpret, arrow, False), ddl)
        if blocks.where("end_inside or end_depth <> 0").isEmpty():
            parts.append(cut.select(*names))
        else:
            cut = materialise(cut)
            # Parts are a few per block: a record's first one begins a group, the others follow it.
            chain = F.count_if(F.col("part") == OPENS).over(Window.partitionBy("path").orderBy("pos", "part"))
            grouped = cut.where(F.col("part") != WHOLE).withColumn("chain", chain).groupBy("path", "chain")
            whole = grouped.agg(
                F.min("pos").alias("pos"),
                F.max("head").alias("head"),
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), form.separator).alias("text"),
            )
            crossing = whole.select("path", "pos", "head", "text").mapInArrow(_joined(interpret, arrow), ddl)
            parts += [cut.where(F.col("part") == WHOLE).select(*names), crossing.select(*names)]
    found = parts[0] if parts else None
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
