"""Records of text files read in splits, where a record may hold its own delimiter.

Spark cuts a large text file into byte ranges and gives each split the delimited chunks that start in it. Whether the end of a
chunk ends a record depends on all text before it: a ``}`` or a line break may stand inside quotes. So a file is read this way:

1. Every split is scanned once from each state it could begin in (inside or outside quotes) and says where each of them
   leads and how many records end on the way. That is one short row per split.
2. These rows, in file order, are folded into the state and the record number at the start of each split.
3. Every split is scanned from its true state. Records inside it are complete; the pieces at its two ends carry the number of
   their record, and only they are shuffled, to be put together.

No task reads a whole file, no text but the end pieces moves, and record numbers need no sort. The table of step 2 holds
a few numbers for each split, as Spark's own list of splits does. A record of any length is one row in the end.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches

# The functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTINUES, ENDS, NOTHING = 0, 1, 2
_ESCAPED = re.compile(r"\\.", re.S)
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')  # up to the quote that ends a cell


@dataclass(frozen=True)
class JsonObjects:
    """Top-level objects of a file: one array of them, or objects after each other. A state is ``(in a string, open braces)``."""

    delimiter: str = "}"
    keeps_delimiter: bool = True
    header: bool = False
    begin: tuple[bool, int] = (False, 0)
    drops_mark: bool = True

    def _read(self, inside: bool, parts: list[str]) -> tuple[bool, int]:
        """Whether a chunk ends in a string, and the braces it opens; ``parts`` is the chunk, cut at its quotes."""
        return inside ^ (len(parts) % 2 == 0), sum(p.count("{") for p in parts[inside::2])

    def _parts(self, chunk: str) -> list[str]:
        return (_ESCAPED.sub("", chunk) if "\\" in chunk else chunk).split('"')

    def step(self, state: tuple[bool, int], chunk: str) -> tuple[tuple[bool, int], int]:
        """State after a chunk and its closing brace, and whether a record ends there.

        With nothing open there is nothing to close: that is the rest of a file behind its last object.
        """
        inside, opened = self._read(state[0], self._parts(chunk))
        depth = state[1] + opened
        if inside:
            return (True, depth), CONTINUES
        return (False, max(0, depth - 1)), NOTHING if depth == 0 else ENDS if depth == 1 else CONTINUES

    def summaries(self, chunks: Iterator[str]) -> list[tuple[int, int, int, int]]:
        """Where a split leads from outside and from inside a string: in a string or not, braces opened before the last
        chunk's closing brace, the least of them at an earlier closing brace, and how often that is met.

        The braces open at the start are not known yet. Records end where none is open, which is the least.
        """
        ways = [[False, 0, 1 << 40, 0, False], [True, 0, 1 << 40, 0, False]]
        for chunk in chunks:
            parts = self._parts(chunk)
            for way in ways:
                inside, depth, least, met, closes = way
                if closes:
                    depth -= 1
                    met = 1 if depth < least else met + (depth == least)
                    least = min(least, depth)
                inside, opened = self._read(inside, parts)
                way[:] = inside, depth + opened, least, met, not inside
        return [(int(inside), depth, least, met) for inside, depth, least, met, _ in ways]

    def after(self, state: tuple[bool, int], summary: tuple[int, int, int, int]) -> tuple[tuple[bool, int], int]:
        """State after a split and the records that end in it."""
        inside, opened, least, met = summary
        depth, ended = state[1] + opened, met if state[1] + least == 0 else 0
        if inside or depth == 0:
            return (bool(inside), depth), ended
        return (False, depth - 1), ended + (depth == 1)

    def clean(self, value: Column) -> Column:
        return F.substring(value, F.instr(value, "{"), F.length(value))

    def is_record(self, value: Column) -> Column:
        return F.contains(value, F.lit("{"))


@dataclass(frozen=True)
class QuotedLines:
    """Lines of a delimited file whose quoted cells may hold line breaks. A state is ``(in quotes,)``; empty lines count for nothing."""

    separator: str = ","
    header: bool = True
    delimiter: str = "\n"
    keeps_delimiter: bool = False
    begin: tuple[bool] = (False,)
    drops_mark: bool = True

    def step(self, state: tuple[bool], line: str) -> tuple[tuple[bool], int]:
        inside = state[0]
        if '"' not in line:
            return state, CONTINUES if inside else ENDS if line.rstrip("\r") else NOTHING
        at, opens = 0, self.separator + '"'
        if not inside and line[0] == '"':
            inside, at = True, 1
        while True:
            if inside:
                at = _QUOTED.match(line, at).end()
                if at == len(line):
                    return (True,), CONTINUES
                inside, at = False, at + 1
            at = line.find(opens, at)  # only a cell that begins with a quote is quoted
            if at < 0:
                return (False,), ENDS
            inside, at = True, at + len(opens)

    def summaries(self, lines: Iterator[str]) -> list[tuple[int, int, int, int]]:
        """Where a split leads from outside and from inside quotes, and how many records end."""
        ways = [[(False,), 0], [(True,), 0]]
        for line in lines:
            for way in ways:
                way[0], kind = self.step(way[0], line)
                way[1] += kind == ENDS
        return [(int(state[0]), 0, 0, met) for state, met in ways]

    def after(self, state: tuple[bool], summary: tuple[int, int, int, int]) -> tuple[tuple[bool], int]:
        return (bool(summary[0]),), summary[3]

    def clean(self, value: Column) -> Column:
        return F.when(F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)

    def is_record(self, value: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class TabLines:
    """Runs of lines that hold a tab; a line without a tab (and without stray line end characters) ends one. A state is ``(in a run,)``.

    The last run of a file may lack its end; with ``strict_tail`` it is then no record.
    """

    delimiter: str = "\n"
    strict_tail: bool = False
    keeps_delimiter: bool = False
    header: bool = False
    begin: tuple[bool] = (False,)
    drops_mark: bool = False

    def _kinds(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which lines hold a tab, and which end a run."""
        has = lambda c: pc.match_substring(lines, c).to_numpy(zero_copy_only=False)
        tab = has("\t")
        return tab, ~(tab | has("\r") | has("\n"))

    def summaries(self, arrays: Iterator[pa.Array]) -> list[tuple[int, int, int, int]]:
        """Where a split leads from outside and from inside a run, and how many runs end; the ways differ up to the first line that counts."""
        inside, met, lead = False, 0, None
        for lines in arrays:
            tab, ends = self._kinds(lines)
            counts = np.flatnonzero(tab | ends)
            if len(counts) == 0:
                continue
            if lead is None:
                lead = int(ends[counts[0]])
            before = np.concatenate([[inside], tab[counts[:-1]]])
            met += int((ends[counts] & before).sum())
            inside = bool(tab[counts[-1]])
        return [(int(inside), 0, 0, met), (int(inside or lead is None), 0, 0, met + (lead or 0))]

    def complete(self, arrays: Iterator[pa.Array], inside: list[bool], held: list[str]) -> Iterator[pa.Array]:
        """Arrays of the runs that end here, their lines joined; ``held`` is left with the lines of the last one, if it is open."""
        begun = inside[0]
        for lines in arrays:
            tab, ends = self._kinds(lines)
            at = np.flatnonzero(ends)
            kept = lines.filter(pa.array(tab))
            upto = np.concatenate([[0], np.cumsum(tab)[at]])  # lines with a tab before each end
            if len(at) == 0:
                held += kept.to_pylist()
                begun |= len(kept) > 0
                continue
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), kept), self.delimiter)
            full = np.diff(upto) > 0
            if begun:
                first = pa.array([self.delimiter.join(held + kept.slice(0, int(upto[1])).to_pylist())], texts.type)
                texts, full[0] = pa.concat_arrays([first, texts.slice(1)]), True
            if full.any():
                yield texts.filter(pa.array(full))
            held[:] = kept.slice(int(upto[-1])).to_pylist()
            begun = len(held) > 0

    def after(self, state: tuple[bool], summary: tuple[int, int, int, int]) -> tuple[tuple[bool], int]:
        return (bool(summary[0]),), summary[3]

    def clean(self, value: Column) -> Column:
        return value

    def is_record(self, value: Column) -> Column:
        return F.contains(value, F.lit("\t"))


Syntax = JsonObjects | QuotedLines | TabLines


def _splits(batches: Iterator[pa.RecordBatch], drops_mark: bool = True) -> Iterator[tuple[tuple, Iterator[pa.Array]]]:
    """``((file, start), arrays of chunks)`` for every split in a task; the arrays must be used up before the next split."""

    def runs() -> Iterator[tuple[tuple, pa.Array]]:
        for b in batches:
            file, start = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
            ends = [0, *cuts.tolist(), len(file)] if len(file) else []
            for at, end in zip(ends, ends[1:]):
                yield (int(file[at]), int(start[at])), b.column(0).slice(at, end - at)

    found = runs()
    ahead = next(found, None)

    def arrays(key: tuple) -> Iterator[pa.Array]:
        nonlocal ahead
        first = drops_mark and key[1] == 0
        while ahead is not None and ahead[0] == key:
            values = ahead[1]
            if first and values[0].as_py().startswith("\ufeff"):
                values = pa.concat_arrays([pa.array([values[0].as_py()[1:]], values.type), values.slice(1)])
            yield values
            first, ahead = False, next(found, None)

    while ahead is not None:
        key = ahead[0]
        yield key, arrays(key)


def _each(arrays: Iterator[pa.Array]) -> Iterator[str]:
    return (chunk for values in arrays for chunk in values.to_pylist())


def _chunks(spark: SparkSession, path: str, syntax: Syntax) -> DataFrame:
    lines = spark.read.option("lineSep", syntax.delimiter).text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _summaries(spark: SparkSession, path: str, syntax: Syntax) -> list:
    """One row per split, in file order, with the first record of a file that has a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), arrays in _splits(batches, syntax.drops_mark):
            chunks = arrays if isinstance(syntax, TabLines) else _each(arrays)
            record: list[str] = []
            state, kind = syntax.begin, CONTINUES

            def watched() -> Iterator[str]:
                nonlocal state, kind
                for chunk in chunks:
                    if syntax.header and start == 0 and kind != ENDS:
                        state, kind = syntax.step(state, chunk)
                        if kind != NOTHING:
                            record.append(chunk)
                    yield chunk

            ways = [n for way in syntax.summaries(chunks if isinstance(syntax, TabLines) else watched()) for n in way]
            yield pa.RecordBatch.from_pydict(
                {"file": [file], "start": [start], "ways": [ways], "record": [syntax.delimiter.join(record) if record else None]},
                schema=pa.schema([("file", pa.int64()), ("start", pa.int64()), ("ways", pa.list_(pa.int64())), ("record", pa.string())]),
            )

    found = _chunks(spark, path, syntax).mapInArrow(run, "file bigint, start bigint, ways array<bigint>, record string")
    # One row per file, without its content.
    name = F.col("_metadata.file_path")
    paths = dict(spark.read.format("binaryFile").load(path).select(F.xxhash64(name), name).collect())
    return sorted(found.collect(), key=lambda r: (paths[r.file], r.start))


def read_records(spark: SparkSession, path: str, syntax: Syntax) -> tuple[DataFrame, str | None]:
    """``(id, value)``: the text of every record with its number from 0 over all files; and the first file's header record.

    Headers are no records. Steps 1 and 2 run at once, the rest when the result is used.
    """
    known: dict[tuple[int, int], tuple] = {}
    bound_batches(spark)
    tails: set[tuple[int, int]] = set()  # of a file's records, the last one that has no end and is left out
    header, file, state, here, total = None, None, syntax.begin, 0, 0

    def close() -> int:
        """Records of the file so far, with one that has no end."""
        if not isinstance(syntax, TabLines) or state == syntax.begin:
            return here
        if syntax.strict_tail:
            tails.add((file, here))
        return here + (not syntax.strict_tail)

    for row in _summaries(spark, path, syntax):
        if row.file != file:
            here = close()
            file, state, here, total = row.file, syntax.begin, 0, total + max(0, here - syntax.header)
        header = header if header is not None else row.record
        known[row.file, row.start] = state, here, total
        four = row.ways[4:] if state[0] else row.ways[:4]
        state, ended = syntax.after(state, tuple(four))
        here += ended
    close()
    shared = spark.sparkContext.broadcast((known, tails))
    skip = int(syntax.header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("value", pa.string())])
        out: list[tuple] = []
        size = 0
        known, tails = shared.value
        for (file, start), arrays in _splits(batches, syntax.drops_mark):
            if (file, start) not in known:
                raise RuntimeError("the files or their splits changed between planning and reading")
            state, number, base = known[file, start]
            held, opened = [], state != syntax.begin
            if isinstance(syntax, TabLines):
                opened = [opened]
                for complete in syntax.complete(arrays, opened, held):
                    first = [start if opened[0] else None]
                    opened[0] = False
                    n = len(complete)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, file)), pa.array(np.arange(n) + base + number),
                        pa.array(first + [None] * (n - 1), pa.int64()), complete.cast(pa.string()),
                    ], schema=schema)
                    number += n
                arrays = iter(())
            for chunk in _each(arrays):
                state, kind = syntax.step(state, chunk)
                if kind == NOTHING:
                    continue
                held.append(chunk)
                if kind == ENDS:
                    text = syntax.delimiter.join(held) + syntax.delimiter * syntax.keeps_delimiter
                    if number >= skip:
                        out.append((file, base + number - skip, start if opened else None, text))
                        size += len(text)
                    held, opened, number = [], False, number + 1
                    if len(out) >= 2000 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
            if held and number >= skip and (file, number) not in tails:
                out.append((file, base + number - skip, start, "".join(c + syntax.delimiter for c in held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    pieces = _chunks(spark, path, syntax).mapInArrow(run, "file bigint, id bigint, start bigint, value string")
    whole = pieces.where("start is null").select("id", "value")
    ends = F.sort_array(F.collect_list(F.struct("start", "value")))
    put_together = pieces.where("start is not null").groupBy("file", "id").agg(ends.alias("p")).select(
        "id", F.array_join(F.transform("p", lambda p: p["value"]), "").alias("value")
    )
    value = F.col("value")
    rows = whole.unionByName(put_together.where(syntax.is_record(value))).select("id", syntax.clean(value).alias("value"))
    return rows, header
