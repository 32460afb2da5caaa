"""CSV records that run over line ends, read from split files.

A file's blocks are read by different tasks, and a block may begin inside a
quoted field. Whether it does is found as for a prefix sum: a line maps the state
it begins in (outside or inside quotes) to the one it ends in, a block's map is
the composition of its lines' maps, and composing the maps of a file's blocks in
order gives every block's first state. A second pass then joins the lines of
each record; a third, over the blocks that begin or end inside quotes alone,
shuffles the pieces of records that cross block borders. The fields are parsed by
``from_csv``. Tasks handle lines in Arrow batches; one by one only those that
hold quotes.

A quote opens a field only at its beginning, as readers of CSV have it, so a
stray quote inside a plain field changes no state.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A quoted text without its end; a whole field and the comma after it.
_OPEN = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_OPEN}"[^,]*+|[^",][^,]*+|),)*+'
_STAYS_OUTSIDE = re.compile(rf'{_FIELDS}"{_OPEN}\Z', re.S)
_LEAVES = re.compile(rf'{_OPEN}"[^,]*+(?:,|\Z)', re.S)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line, begun outside or inside of quotes, ends inside."""
    if inside:
        m = _LEAVES.match(line)
        if m is None:
            return True
        line = line[m.end():]
    return _STAYS_OUTSIDE.match(line) is not None


def lines(spark: SparkSession, paths) -> DataFrame:
    """``(file, block, line)``: lines by line feeds, in order within a block."""
    return spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))


def has_quotes(spark: SparkSession, paths) -> bool:
    """Whether any line has a quote; stops at the first."""
    return not spark.read.text(paths).where(F.contains("value", F.lit('"'))).isEmpty()


def _runs(file: pa.Array, block: pa.Array):
    """``(file, block, begin, end)`` of the rows of a batch that share a block."""
    at, ends = 0, pc.run_end_encode(block).run_ends.to_pylist()
    texts = pc.run_end_encode(file).run_ends.to_pylist()
    for end in sorted({*ends, *texts}):
        yield file[at].as_py(), block[at].as_py(), at, end
        at = end


def block_maps(spark: SparkSession, paths) -> list:
    """Rows ``(file, block, outside, inside, spans, bare)`` of every block, in
    order: the states it ends in for either first state, whether some line begun
    outside ends inside, and whether it holds quotes and a carriage return alone. As many rows
    as the read has splits, which the driver holds anyway."""
    def run(batches):
        key, state, spans, bare, quoted = None, [False, True], False, False, False

        def row():
            return pa.RecordBatch.from_pydict({
                "file": [key[0]], "block": pa.array([key[1]], pa.int64()), "outside": [state[0]], "inside": [state[1]],
                "spans": [spans], "bare": [bare and quoted]})

        for b in batches:
            for file, block, at, end in _runs(b.column(0), b.column(1)):
                if (file, block) != key:
                    if key is not None:
                        yield row()
                    key, state, spans, bare, quoted = (file, block), [False, True], False, False, False
                bare = bare or bool(pc.any(b.column(3).slice(at, end - at)).as_py())
                for line in b.column(2).slice(at, end - at).drop_null().to_pylist():
                    quoted = True
                    from_outside, from_inside = ends_inside(line, False), ends_inside(line, True)
                    spans = spans or from_outside
                    state = [from_inside if s else from_outside for s in state]
        if key is not None:
            yield row()

    # Lines without quotes change nothing and are not sent.
    quoted = lines(spark, paths).select(
        "file", "block", F.when(F.contains("line", F.lit('"')), F.regexp_replace("line", "\r$", "")).alias("line"),
        F.coalesce(F.contains("line", F.lit("\r")) & F.col("line").rlike("\r."), F.lit(False)).alias("bare"))
    found = quoted.mapInArrow(run, "file string, block long, outside boolean, inside boolean, spans boolean, bare boolean")
    return sorted(found.collect(), key=lambda r: (r["file"], r["block"]))


def first_states(maps) -> dict:
    """``{(file, block): whether it begins inside quotes}``."""
    out, file, state = {}, None, False
    for r in maps:
        if r["file"] != file:
            file, state = r["file"], False
        out[r["file"], r["block"]] = state
        state = r["inside"] if state else r["outside"]
    return out


def _open_after(line: pa.Array, inside: bool) -> np.ndarray:
    """Whether each line ends inside quotes, the first begun as told. Only lines
    that hold quotes change the state."""
    places = np.flatnonzero(pc.match_substring(line, '"').to_numpy(zero_copy_only=False))
    states = [inside]
    for text in line.take(pa.array(places)).to_pylist():
        states.append(ends_inside(text[:-1] if text.endswith("\r") else text, states[-1]))
    return np.array(states)[np.searchsorted(places, np.arange(len(line)), "right")]


def _joined(line: pa.Array, ends: np.ndarray) -> pa.Array:
    """The records that end before the given lines, those that are blank left out."""
    text = line
    if len(ends) < len(line):
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), line), "\n")
    if pc.any(pc.ends_with(text, "\r")).as_py():
        text = pc.replace_substring_regex(text, "\r$", "")
    return text.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0))


def _walk(begins, whole: bool):
    """A task's pass over its lines: if ``whole`` the records that lie in one block,
    as ``(record, head)``, else the pieces of the others, as ``(file, block, part,
    record, head)``."""
    def run(batches):
        key, inside, held, piece, first = None, False, [], 0, False

        def closed(last: bool):
            """The lines held so far: a record, or a piece of one that goes on or
            has come from the block before."""
            nonlocal held, piece, first
            if last and piece > 0:
                text, part = _joined(pa.array(["\n".join(held)], pa.string()), np.array([1])), None
            else:  # piece 0 is a block's beginning inside a record, 1 its open end
                text, part = pa.array(["\n".join(held)], pa.string()), (0 if piece == 0 else 2) + (1 if last else 0)
            held, piece = [], 1
            yield from found(text, part)

        def found(text: pa.Array, part=None):
            nonlocal first
            if len(text) and whole and part is None:
                yield pa.RecordBatch.from_arrays([text, pa.array([first] + [False] * (len(text) - 1))],
                                                 names=["record", "head"])
            elif not whole and part is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([part], pa.int32()), text,
                     pa.array([first])], names=["file", "block", "part", "record", "head"])
            first = first and (part is not None or not len(text))

        for b in batches:
            for file, block, at, end in _runs(b.column(0), b.column(1)):
                if (file, block) != key:
                    if held:
                        yield from closed(False)
                    key = (file, block)
                    if key not in begins.value:
                        raise RuntimeError(f"{file} was split in another way when it was read again.")
                    inside = begins.value[key]
                    piece, first = 0 if inside else 1, block == 0
                line = b.column(2).slice(at, end - at)
                after = _open_after(line, inside)
                inside = bool(after[-1])
                ends = np.flatnonzero(~after) + 1
                done = 0
                if len(ends) and (held or piece == 0):
                    done = int(ends[0])
                    held += line.slice(0, done).to_pylist()
                    yield from closed(True)
                    ends = ends[1:]
                if len(ends):
                    if whole or first:
                        yield from found(_joined(line.slice(done, int(ends[-1]) - done), ends - done))
                    done = int(ends[-1])
                held += line.slice(done).to_pylist()
        if held:
            yield from closed(False)

    return run


def records(spark: SparkSession, paths, maps) -> DataFrame:
    """``(record, head)``: every record that is not blank as its text, line
    breaks included; ``head`` is true for a file's first."""
    states = first_states(maps)
    begins = spark.sparkContext.broadcast(states)
    rows = lines(spark, paths)
    whole = rows.mapInArrow(_walk(begins, True), "record string, head boolean")
    # Only blocks that begin or end inside quotes hold pieces.
    crossed = [(r["file"], r["block"]) for r in maps
               if states[r["file"], r["block"]] or r["inside" if states[r["file"], r["block"]] else "outside"]]
    if not crossed:
        return whole
    rows = rows.join(F.broadcast(spark.createDataFrame(crossed, "file string, block long")), ["file", "block"], "left_semi")
    # Pieces: 2 opens a record at a block's end, 0 goes through a block, 1 closes it.
    pieces = rows.mapInArrow(_walk(begins, False), "file string, block long, part int, record string, head boolean")
    number = F.sum((F.col("part") == 2).cast("int")).over(_in_order())
    # (an ended piece 0 is part 1; a record's own block is that of its opening)
    joined = (pieces.withColumn("of", number).groupBy("file", "of")
              .agg(F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("p"),
                   F.max("head").alias("head"))
              .select(F.expr("array_join(transform(p, x -> x.record), '\n')").alias("record"), "head"))
    joined = joined.select(F.regexp_replace("record", "\r$", "").alias("record"), "head")
    return whole.unionByName(joined.where(F.length(F.btrim("record")) > 0))


def _in_order():
    from pyspark.sql import Window
    # part 1 (a closing) of a block stands before part 2 (an opening) of the same
    return Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
