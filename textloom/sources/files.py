"""Row numbers of text files without collecting a file in one task."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import bound_batches

# The functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATH, START = "_path", "_start"


def mark_position(df: DataFrame) -> DataFrame:
    """Remember file and split of every row; call it right after the read."""
    return df.withColumns({PATH: F.col("_metadata.file_path"), START: F.col("_metadata.file_block_start")})


def _before_in_split(weights: int):
    """Struct of the sums of ``weights`` columns over the rows before in the same split, which come in file order."""
    names = [f"n{k}" for k in range(weights)]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        split, totals = None, [0] * weights
        for path, start, *values in batches:
            size = len(path)
            if not size:
                yield pa.StructArray.from_arrays([pa.array([], pa.int64())] * weights, names)
                continue
            code, at = path.dictionary_encode().indices.to_numpy(), start.to_numpy()
            first = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(at) != 0)) + 1])
            here = np.repeat(np.arange(len(first)), np.diff(np.append(first, size)))
            carried = (path[0].as_py(), start[0].as_py()) == split
            out = []
            for k, v in enumerate(values):
                upto = np.cumsum(v.fill_null(0).to_numpy())
                begun = np.concatenate([[0], upto[first[1:] - 1]])  # the sum before each split
                begun[0] -= totals[k] if carried else 0
                out.append(pa.array(np.concatenate([[0], upto[:-1]]) - begun[here]))
                totals[k] = int(upto[-1] - begun[-1])
            split = path[-1].as_py(), start[-1].as_py()
            yield pa.StructArray.from_arrays(out, names)

    return F.arrow_udf(run, StructType([StructField(n, LongType()) for n in names])).asNondeterministic()


def number_rows(marked: DataFrame, out: str = "line", **counts: Column) -> DataFrame:
    """Dense row number from 0 over all files, in order of path and place; keeps ``_path``.

    Each of ``counts`` adds a number that goes up only by its column (0 or 1) per row. ``marked`` must be as read, before any
    shuffle: rows of one split are in one task in file order and are counted there, so only the sums of the splits have to be
    added up and no row moves.
    """
    bound_batches(marked.sparkSession)
    weights = {out: F.lit(1), **counts}
    # One row per split of the input.
    before = Window.orderBy(PATH, START).rowsBetween(Window.unboundedPreceding, -1)
    per_split = marked.groupBy(PATH, START).agg(*[F.sum(w.cast("bigint")).alias(f"_n_{n}") for n, w in weights.items()])
    offsets = per_split.select(
        PATH, START, *[F.coalesce(F.sum(f"_n_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in weights]
    )
    inside = _before_in_split(len(weights))(PATH, START, *[w.cast("bigint") for w in weights.values()])
    numbered = marked.withColumn("_i", inside).join(F.broadcast(offsets), [PATH, START])
    return numbered.withColumns(
        {n: F.col(f"_b_{n}") + F.col(f"_i.n{k}") for k, n in enumerate(weights)}
    ).drop(START, "_i", *[f"_b_{n}" for n in weights])
