"""Tab-separated files with quoted line breaks, read by byte ranges.

Spark's line reader cuts a file into ranges and gives each its lines; what it can't know is whether a range
begins inside a quoted field.  Two passes over the lines settle it:

1. A line maps the state before it (outside or inside quotes) to the state after it.  The maps of a range's lines
   are composed while they stream by, so a range becomes one map, in one row; a running composition over a
   file's ranges gives the state each one begins with.
2. Each range is read again from its known state.  Records that begin and end in it are cut into fields at once;
   the first lines that belong to a record begun earlier, and the last record if it goes on, leave as pieces.
   The pieces of a record, two a range at most, meet in the range that owns it: the one in which it begins.

Records end in a line feed, or carriage return and line feed.  A quote opens a field only as its first
character, a doubled quote inside stands for one, and what follows a closing quote up to the tab is added as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.session import bounded_batches, is_small, write_through

ORIGIN = ("file", "block")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, given whether one is open before it."""
    at, n = 0, len(line)
    while True:
        if inside:
            close = line.find('"', at)
            while 0 <= close and line.startswith('"', close + 1):
                close = line.find('"', close + 2)
            if close < 0:
                return True
            at, inside = close + 1, False
        elif at < n and line[at] == '"':
            at, inside = at + 1, True
            continue
        tab = line.find("\t", at)
        if tab < 0:
            return False
        at = tab + 1


def fields_of(record: str) -> list[str]:
    """The fields of one whole record, unquoted."""
    if record.endswith("\r"):
        record = record[:-1]
    if '"' not in record:
        return record.split("\t")
    out, at, n = [], 0, len(record)
    while True:
        text = ""
        if at < n and record[at] == '"':
            close = record.find('"', at + 1)
            while 0 <= close and record.startswith('"', close + 1):
                close = record.find('"', close + 2)
            if close < 0:
                return [*out, record[at + 1 :].replace('""', '"')]
            text, at = record[at + 1 : close].replace('""', '"'), close + 1
        tab = record.find("\t", at)
        if tab < 0:
            return [*out, text + record[at:]]
        out.append(text + record[at:tab])
        at = tab + 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of a batch, whose rows come in the order of the scan."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or blocks[i] != blocks[start] or files[i] != files[start]:
            yield files[start], blocks[start], batch.column("value").slice(start, i - start)
            start = i


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, seen, from_outside, from_inside): the map of each range."""
    found: dict[tuple, list[bool]] = {}
    for batch in batches:
        for file, block, lines in _runs(batch):
            state = found.setdefault((file, block), [False, True])
            quoted = lines.filter(pc.match_substring(lines, '"'))
            for line in quoted.to_pylist():
                state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
        + [pa.array([found[k][i] for k in keys], pa.bool_()) for i in (0, 1)],
        ["file", "block", "from_outside", "from_inside"],
    )


def starting_states(maps: DataFrame) -> DataFrame:
    """(file, block, inside): the state before each range.

    A map that doesn't depend on the state before it sets the state; the others keep or turn it.  So the state is
    that of the last setting map, turned as often as turning maps follow.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_outside") == F.col("from_inside")
    turns = (~sets & F.col("from_outside")).cast("int")
    marked = maps.withColumn("turned", F.sum(turns).over(order) % 2 == 1).withColumn(
        "anchor", F.when(sets, F.col("from_outside") != F.col("turned"))
    )
    last = F.coalesce(F.last("anchor", ignorenulls=True).over(before), F.lit(False))
    turned = F.coalesce(F.last("turned").over(before), F.lit(False))
    return marked.select("file", "block", (last != turned).alias("inside"))


def _read(width: int):
    """Records that begin and end in one range, with their fields, and the pieces of the others.

    ``k`` numbers the records that begin in a range.  A piece has no fields: ``opens`` where a record begins with it,
    which is then the last of its range; the others go on with a record begun earlier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, k, inside, waiting, opens = None, 0, False, [], True

        def piece():
            return ([here[0]], [here[1]], [k if opens else -1], [None], ["\n".join(waiting)], [opens])

        for batch in batches:
            inside_column = batch.column("inside").to_pylist()
            out: list[tuple] = []
            start = 0
            for file, block, lines in _runs(batch):
                if (file, block) != here:
                    if waiting:
                        out.append(piece())
                    here, k, waiting = (file, block), 0, []
                    inside = inside_column[start]
                    opens = not inside
                start += len(lines)
                if not inside and not waiting and not pc.any(pc.match_substring(lines, '"')).as_py():
                    kept = lines.filter(pc.invert(pc.match_substring_regex(lines, "^\r?$")))
                    n = len(kept)
                    out.append(([file] * n, [block] * n, range(k, k + n), [fields_of(x) for x in kept.to_pylist()], [None] * n, [True] * n))
                    k += n
                    continue
                for line in lines.to_pylist():
                    was, inside = inside, ends_inside(line, inside)
                    if not was:
                        opens = True
                        if line in ("", "\r"):
                            continue
                        if not inside:
                            out.append(([file], [block], [k], [fields_of(line)], [None], [True]))
                            k += 1
                            continue
                    waiting.append(line)
                    if was and not inside:
                        if opens:
                            out.append(([file], [block], [k], [fields_of("\n".join(waiting))], [None], [True]))
                            k += 1
                        else:
                            out.append(piece())
                        waiting = []
            if out:
                yield _records(out, width)
        if waiting:
            yield _records([piece()], width)

    return run


def _records(parts: list[tuple], width: int) -> pa.RecordBatch:
    file, block, k, fields, text, opens = (list(chain.from_iterable(x)) for x in zip(*parts))
    fields = [None if f is None else (f + [None] * (width - len(f)))[:width] for f in fields]
    kinds = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip((file, block, k, fields, text, opens), kinds)], ["file", "block", "k", "fields", "piece", "opens"]
    )


def _assemble(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [(f + [None] * (width - len(f)))[:width] for f in map(fields_of, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("file", "block", "k")] + [pa.array(fields, pa.list_(pa.string()))], ["file", "block", "k", "fields"]
            )

    return run


def read_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, block, k, fields) of all records of the files under ``path``, the headers included.

    ``block`` is the first byte of the range a record begins in, ``k`` its number there from 0, and ``fields`` has
    ``width`` values: missing ones are null, further ones are dropped.  Blank lines outside quotes are no records.
    """
    lines = bounded_batches(spark.read.option("lineSep", "\n").text(path)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    maps = lines.mapInArrow(_maps, "file string, block long, from_outside boolean, from_inside boolean")
    # One row per byte range.
    states = write_through(starting_states(write_through(maps, "range-maps")), "range-states")
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    if is_small(states):  # lines stay in the order of the scan
        known = lines.join(F.broadcast(states), list(ORIGIN))
    else:
        known = lines.join(states, list(ORIGIN)).repartition(*ORIGIN).sortWithinPartitions(*ORIGIN, "at")
    schema = "file string, block long, k long, fields array<string>, piece string, opens boolean"
    found = write_through(known.select("value", *ORIGIN, "inside").mapInArrow(_read(width), schema), "tsv-records")
    # The ranges from the one in which a record opens to the one in which it closes form one group.
    pieces = found.where("fields is null").withColumn(
        "record", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("block", "opens").rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = pieces.groupBy("file", "record").agg(
        F.min("block").alias("block"), F.max("k").alias("k"), F.array_join(F.array_sort(F.collect_list(F.struct("block", "piece")))["piece"], "\n").alias("text")
    )
    spanning = whole.select("file", "block", "k", "text").mapInArrow(_assemble(width), "file string, block long, k long, fields array<string>")
    return found.where("fields is not null").select("file", "block", "k", "fields").unionByName(spanning)
