"""Ordered positions and running values without one task holding a whole group.

A plain window over a table or a large group sends it to one task. Here rows are sorted by ranges of their order, which Spark
cuts by a sample of the keys; a position is the sum over earlier ranges plus the place in the row's own. Inside groups, the
group is cut into blocks along its order and the totals of earlier blocks are added back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialise, shuffle_partitions, written

PLACE_BITS = 33  # of a monotonically increasing id, below the partition's number
RANGES_PER_NODE = 1024


def _summed(rows: DataFrame, weight: str) -> DataFrame:
    """``rows`` with ``_inside``: the sum of ``weight`` over the rows before in the same partition."""
    at = rows.columns.index(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            values = b.column(at).fill_null(0).to_numpy()
            upto = total + np.cumsum(values)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - values)], names=[*b.schema.names, "_inside"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_inside", LongType())]))


def running_sum(
    df: DataFrame, order: Sequence[str], weight: str | None = None, out: str = "ix", ranges: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` over all rows before this one in ``order`` (the row index if no weight).

    Rows are sorted by range and written once, so later steps see the same ranges; rows that are equal in ``order`` follow the
    order of the input, and many of them spread over ranges too. The offsets are a tree of two levels over the ranges, one row
    each. The plan is the same for any number of rows; ``ranges`` are the shuffle partitions by default.
    """
    keys = [*order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    if weight:
        rows = rows.withColumn("_weight", F.col(weight).cast("bigint"))
    rows = rows.repartitionByRange(ranges or shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie")
    rows = (_summed(rows, "_weight") if weight else rows).withColumn("_place", F.monotonically_increasing_id())
    placed = written(rows, "placed").withColumn("_range", F.shiftright("_place", PLACE_BITS))
    if weight:
        size = F.sum("_weight")
    else:
        placed = placed.withColumn("_inside", F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
        size = F.count(F.lit(1))
    leaves = placed.groupBy("_range").agg(size.alias("_size")).withColumn("_node", F.expr(f"_range div {RANGES_PER_NODE}"))
    before = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = leaves.groupBy("_node").agg(F.sum("_size").alias("_size")).select("_node", before(Window.orderBy("_node")).alias("_first"))
    inner = leaves.select("_range", "_node", before(Window.partitionBy("_node").orderBy("_range")).alias("_before"))
    offsets = inner.join(F.broadcast(nodes), "_node").select("_range", (F.col("_first") + F.col("_before")).alias("_offset"))
    # One row for each shuffle partition.
    return placed.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(out))


def _with_blocks(df: DataFrame, by: Sequence[str], block: Column, totals: Sequence[Column],
                 before: Sequence[Column]) -> DataFrame:
    """Join ``before`` (window values over the earlier blocks' ``totals``) to every row."""
    blocked = df.withColumn("_block", block)
    per_block = blocked.groupBy(*by, "_block").agg(*totals)
    return blocked.join(per_block.select(*by, "_block", *before), [*by, "_block"])


def _earlier_blocks(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def group_row_number(
    df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, out: str = "rn"
) -> DataFrame:
    """Row number from 0 within ``by``, for groups of any size.

    ``block`` must not decrease along ``order`` inside a group and should hold a bounded number
    of rows, for example ``turn div 4096``. Only rows of one block meet in one task.
    """
    rows = _with_blocks(
        df, by, block, [F.count(F.lit(1)).alias("_n")],
        [F.coalesce(F.sum("_n").over(_earlier_blocks(by)), F.lit(0)).alias("_before")],
    )
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    return rows.withColumn(
        out, F.row_number().over(inside) - 1 + F.col("_before")
    ).drop("_block", "_before")


def group_running_max(
    df: DataFrame, by: Sequence[str], position: str, value: str, out: str,
    include_current: bool, block_rows: int = 65_536,
) -> DataFrame:
    """Running maximum of ``value`` along the dense ``position`` of each group."""
    rows = _with_blocks(
        df, by, F.floor(F.col(position) / block_rows), [F.max(value).alias("_m")],
        [F.max("_m").over(_earlier_blocks(by)).alias("_before")],
    )
    inside = (
        Window.partitionBy(*by, "_block").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return rows.withColumn(
        out, F.greatest(F.max(value).over(inside), F.col("_before"))
    ).drop("_block", "_before")


def seeded_order(df: DataFrame, id_col: str, seed: int, out: str = "shuffle_key") -> DataFrame:
    """Sort key of a reproducible shuffle: 60 bits of an MD5 digest of the seed and the id, whatever the partitions or the engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return df.withColumn(out, F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], ranges: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per probability ``(p, quantile)``.

    Equal values are counted first, so a value shared by most rows is one weighted row, and the
    ranks come from :func:`running_sum`.
    """
    counts = materialise(
        df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_sum(counts, [value], "n", "lo", ranges)
    total = counts.agg(F.sum("n").alias("total"))
    wanted = total.select(
        "total", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    ).withColumn("at", F.col("p") * (F.col("total") - 1))
    bounds = F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"),
            F.floor(F.lit(float(p)) * (F.col("total") - 1)).alias("first"),
            F.ceil(F.lit(float(p)) * (F.col("total") - 1)).alias("last"),
        )
        for p in probabilities
    ])
    # One-row total; each ranked row keeps only the probabilities whose ranks it covers.
    covers = F.filter(
        "bounds",
        lambda b: ((b["first"] >= F.col("lo")) & (b["first"] < F.col("lo") + F.col("n")))
        | ((b["last"] >= F.col("lo")) & (b["last"] < F.col("lo") + F.col("n"))),
    )
    hits = (
        ranked.withColumn("total", total.scalar())
        .withColumn("bounds", bounds)
        .select(F.col(value).cast("double").alias("v"), "lo", "n", F.explode(covers).alias("b"))
    )
    has = lambda f: (F.col(f"b.{f}") >= F.col("lo")) & (F.col(f"b.{f}") < F.col("lo") + F.col("n"))
    ends = hits.groupBy(F.col("b.p").alias("p")).agg(
        F.max(F.when(has("first"), F.col("v"))).alias("low"),
        F.max(F.when(has("last"), F.col("v"))).alias("high"),
    )
    return ends.join(F.broadcast(wanted), "p").select(
        "p",
        (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("quantile"),
    )
