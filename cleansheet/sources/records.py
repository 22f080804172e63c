"""CSV records that span lines, put together from lines that tasks read apart.

A task that reads a part of a file cannot know whether its first line begins a
record or lies inside a quoted cell. So every line says what it does to either
case: it leaves things as they are (no quotes, or only whole quoted cells), it
changes from one to the other, or it ends in a known state whatever came
before (a stray quote). Such effects can be chained in any grouping: running
sums chain them inside each part of a file, the parts' effects are chained per
file (one small row per part), and both together give the state before every
line. A line that begins and ends a record is one; the others are joined from
the line that opens a record to the line that closes it. Only these are
grouped, by record, so no file and no part of one has to fit into a task; a
record has to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleansheet.session import materialize

# One cell: quoted text with whatever follows up to the comma, or text that does not begin with a quote.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+)'
_CELLS = rf"{_CELL}(?:,{_CELL})*+"
_CLOSED = rf"\A{_CELLS}\z"
_BROADCAST_PARTS = 200_000
_CLOSING = rf'\A[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_CELL})*+\z'


def leaves_open(line: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell."""
    return line.contains('"') & ~line.rlike(_CLOSED)


def _stays_open(line: Column) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one."""
    return ~(line.contains('"') & line.rlike(_CLOSING))


def readable_path(uri: Column) -> Column:
    """The path of a file, as listings write it (the metadata column has it as a URI)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def file_of_line() -> Column:
    """The path of the file that a row was read from."""
    return readable_path(F.col("_metadata.file_path"))


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, at, value): lines as they stand between line feeds, with the part of the file they were read in.

    `at` orders the lines of a part, and is unique among all.
    """
    return spark.read.option("lineSep", "\n").text(paths).select(
        file_of_line().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def without_ending(record: Column) -> Column:
    return F.when(record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record)


def is_blank(record: Column) -> Column:
    return F.btrim(record, F.lit(" \t\r\n")) == ""


def assemble(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (path, block, at, record) of `raw_lines`, blank ones left out, and the paths that end inside a cell."""
    begun, inside = leaves_open(F.col("value")).cast("int"), _stays_open(F.col("value")).cast("int")
    turn = F.when((F.col("begun") == 1) & (F.col("inside") == 0), 1).otherwise(0)
    part = Window.partitionBy("path", "block").orderBy("at")
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.select("*", begun.alias("begun"), inside.alias("inside")).withColumn("turn", turn)
    marked = marked.withColumn("turns", F.sum("turn").over(so_far))
    known = F.when(F.col("begun") == F.col("inside"), (F.col("begun") + F.col("turns")) % 2)
    marked = marked.withColumn("known", F.last(known, True).over(so_far))
    marked = marked.withColumn("known_before", F.lag("known").over(part))
    # For either state that the part may be entered in: whether a line is a record, else the line that opens its record.
    # So lines travel once to be marked, and those of longer records once more to be joined.
    for entered in (0, 1):
        before = (F.coalesce("known_before", F.lit(entered)) + F.col("turns") - F.col("turn")) % 2
        after = F.when(before == 0, F.col("begun")).otherwise(F.col("inside"))
        whole = (before == 0) & (after == 0)
        marked = marked.withColumn(f"whole{entered}", whole)
        marked = marked.withColumn(f"start{entered}", F.last(F.when((before == 0) & ~whole, F.col("at")), True).over(so_far))
    held = materialize(marked.drop("known_before", "begun", "inside", "turn"), "lines")

    in_file = Window.partitionBy("path").orderBy("block")
    to_here = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = held.groupBy("path", "block").agg(
        F.max("at").alias("at"), F.max("start0").alias("start0"), F.max("start1").alias("start1"))
    blocks = held.select("at", "turns", "known").join(blocks, "at").withColumn("total", F.sum("turns").over(to_here))
    known = F.when(F.col("known").isNotNull(), (F.col("known") + F.col("turns") + F.col("total")) % 2)
    blocks = blocks.withColumn("left_open", (F.coalesce(F.last(known, True).over(to_here), F.lit(0)) + F.col("total")) % 2)
    blocks = blocks.withColumn("entered", F.lag("left_open", 1, 0).over(in_file)).withColumn(
        "last", F.when(F.col("entered") == 0, F.col("start0")).otherwise(F.col("start1")))
    blocks = materialize(blocks.select(
        "path", "block", "entered", "left_open",
        F.last("last", True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried")), "blocks")
    unclosed = blocks.groupBy("path").agg(F.max_by("left_open", "block").alias("open")).where("open = 1").select("path")

    def picked(name: str) -> Column:
        return F.when(F.col("entered") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    parts = blocks.select("path", "block", "entered", "carried")
    if blocks.count() <= _BROADCAST_PARTS:  # some hundred bytes a part
        parts = F.broadcast(parts)
    state = held.join(parts, ["path", "block"])
    singles = state.where(picked("whole")).select("path", "block", "at", F.col("value").alias("record"))
    pieces = state.where(~picked("whole")).select(
        "path", "block", "at", "value", F.coalesce(picked("start"), F.col("carried")).alias("start"))
    lines_of = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    joined = pieces.groupBy("path", "start").agg(lines_of.alias("lines")).select(
        "path", F.get("lines", F.lit(0))["block"].alias("block"), F.col("start").alias("at"),
        F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    records = singles.unionByName(joined).withColumn("record", without_ending(F.col("record")))
    return records.where(~is_blank(F.col("record"))), unclosed
